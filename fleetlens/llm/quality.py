"""Quality rules: plain counts, and how far a text is from its language.

A document's histogram of character classes, and its histogram of its language's
commonest short words, are compared with those of all documents of the language by the
Jensen-Shannon distance (base 2, 0 to 1). Short texts are not judged by a distance:
each has a least length, below which it passes.

The references are sums over every document of the language with enough words; their
size is one row per language. Null texts have no words; null languages form a language
of their own. Every row is judged by itself, so repeated rows have equal results; an
empty table gives none.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.text import SPACES, let, whole, words
from fleetlens.operators.sizes import broadcast_if_small
from fleetlens.session import ensure_checkpoint_dir

LEAST_WORDS = 50
REPEATED_PERCENT = 50
WINDOW = 3
# Characters other than a-z and spaces, told apart in this order.
CLASSES = {
    "upper": "A-Z",
    "stop": r".,;:!?'\"()\-",
    "digit": "0-9",
    "symbol": "#*$%&|<>",
    "ascii": r"\x00-\x7F",
}
N_CLASSES = len(CLASSES) + 3
COMMON_WORDS = 20
COMMON_LENGTH = 5
LEAST_CHARS = 200
LEAST_COMMON = 100
FAR_CHARS = 0.33
FAR_WORDS = 0.31
LANGUAGES_BROADCAST = 10_000


def repeated_words(found: Column) -> Column:
    """How many words are in a window of three that the text has twice or more.

    Windows are compared by 64-bit hashes; only texts in which one occurs twice are
    sorted.
    """
    def of(hashes: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def positions(ordered: Column) -> Column:
            def twice(pair: Column, n: Column) -> Column:
                before, after = F.get(ordered, n - 1)["h"], F.get(ordered, n + 1)["h"]
                return (F.coalesce(before == pair["h"], F.lit(False))) | (F.coalesce(after == pair["h"], F.lit(False)))

            held = F.filter(ordered, twice)
            each = F.transform(held, lambda p: F.array(*[p["i"] + j for j in range(WINDOW)]))
            return F.size(F.array_distinct(F.flatten(each)))

        once = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(once, F.lit(0)).otherwise(let(F.sort_array(at), positions))

    def counted_in(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - WINDOW)
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(WINDOW)]))
        return F.when(F.size(own) < WINDOW, F.lit(0)).otherwise(let(hashed, of))

    # Bound here, as the optimizer may put the words' expression in place of their column.
    return let(found, counted_in)


def duplicate_lines(text: str | Column) -> Column:
    """Lines with a word that equal an earlier one."""
    worded = F.filter(F.split(whole(text), "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(worded, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def short_words(found: Column) -> Column:
    """Words of at most five characters, their letters in lower case, as ' one  two '."""
    short = F.filter(found, lambda w: F.char_length(w) <= COMMON_LENGTH)
    joined = F.lower(F.array_join(short, "  "))
    return F.concat(F.lit(" "), F.regexp_replace(joined, r"[^\p{L} ]+", ""), F.lit(" "))


def counted(docs: DataFrame, *carried: str) -> DataFrame:
    """What the rules need of each row of `docs` (lang, text), in one pass.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; classes, the numbers of
    characters of each class, and short, the words a language is known by.
    """
    row = docs.select("lang", *carried, whole("text").alias("_text"), words("text").alias("_words"))
    rest = row.withColumn("_rest", F.regexp_replace("_text", r"[a-z\x20\x09-\x0D]+", ""))
    cut, made = rest, []
    for name, members in CLASSES.items():
        cut = cut.withColumn("_next", F.regexp_replace("_rest", f"[{members}]+", ""))
        cut = cut.withColumn(f"_{name}", (F.char_length("_rest") - F.char_length("_next")).cast("long"))
        cut = cut.drop("_rest").withColumnRenamed("_next", "_rest")
        made.append(F.col(f"_{name}"))
    lower = F.col("word_chars") - F.char_length("_rest")
    for column in made:
        lower = lower - column
    measured = cut.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.col("_symbol").alias("n_symbols"),
        duplicate_lines("_text").cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        short_words(F.col("_words")).alias("short"),
        F.char_length("_text").cast("long").alias("_n_chars"),
    )
    spaces = F.col("_n_chars") - F.col("word_chars")
    classes = F.array(lower, spaces, *made, F.char_length("_rest").cast("long"))
    return measured.select(
        "lang", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "short", classes.alias("classes")
    )


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms (base 2); null where one is empty."""

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n)

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    def of(x: Column, y: Column, n: Column, m: Column) -> Column:
        terms = F.zip_with(x, y, lambda i, j: part(i / n, j / m) + part(j / m, i / n))
        found = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2
        return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(found, F.lit(0.0))))

    return let(a, lambda x: let(b, lambda y: let(total(x), lambda n: let(total(y), lambda m: of(x, y, n, m)))))


def references(rows: DataFrame) -> DataFrame:
    """(_lang, class_counts, common, common_counts) from `counted` rows, one per language.

    Sums over all rows with enough words. common_counts has one entry per common word
    and a last one for all other words.
    """
    long = F.lit(None).cast("long")
    fixed = [F.struct(F.lit(i).alias("class"), F.lit("").alias("word"), F.get("classes", F.lit(i)).alias("n")) for i in range(N_CLASSES)]
    total = F.struct(F.lit(-1).alias("class"), F.lit("").alias("word"), F.col("n_words").alias("n"))
    named = F.filter(F.split("short", " +"), lambda w: w != "")
    short = F.transform(named, lambda w: F.struct(F.lit(-2).alias("class"), w.alias("word"), F.lit(1).cast("long").alias("n")))
    sums = (
        rows.filter(F.col("n_words") >= LEAST_WORDS)
        .select("lang", F.inline(F.concat(F.array(*fixed, total), short)))
        .groupBy("lang", "class", "word")
        .agg(F.sum("n").alias("n"))
    )
    place = Window.partitionBy("lang", "class").orderBy(F.desc("n"), "word")
    ranked = sums.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= COMMON_WORDS)
    is_word = F.col("class") == -2
    by_lang = ranked.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.when(F.col("class") >= 0, F.struct("class", "n")))).alias("_classes"),
        F.sort_array(F.collect_list(F.when(is_word, F.struct("place", "word", "n")))).alias("_common"),
        F.sum(F.when(F.col("class") == -1, F.col("n")).otherwise(long)).alias("_words"),
    )
    held = F.aggregate(F.col("_common"), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return by_lang.select(
        F.col("lang").alias("_lang"),
        F.col("_classes.n").alias("class_counts"),
        F.col("_common.word").alias("common"),
        F.concat(F.col("_common.n"), F.array(F.col("_words") - held)).alias("common_counts"),
    )


def common_counts(short: Column, n_words: Column, common: Column) -> Column:
    """How often a text has each common word, and last how many other words."""

    def counts(own: Column) -> Column:
        def times(word: Column) -> Column:
            left = F.replace(own, F.concat(F.lit(" "), word, F.lit(" ")), F.lit(""))
            return ((F.octet_length(own) - F.octet_length(left)) / (F.octet_length(word) + 2)).cast("long")

        return F.transform(common, times)

    def closed(each: Column) -> Column:
        return F.concat(each, F.array(n_words - F.aggregate(each, F.lit(0).cast("long"), lambda s, n: s + n)))

    return let(let(short, counts), closed)


def verdicts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`counted` rows with char_distance, word_distance, base_failed and kept."""
    joined = rows.join(broadcast_if_small(known, LANGUAGES_BROADCAST), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    n_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, n: s + n)
    common = common_counts(F.col("short"), F.col("n_words"), F.col("common"))
    compared = joined.select(
        "*",
        F.when(n_chars >= LEAST_CHARS, distance(F.col("classes"), F.col("class_counts"))).alias("char_distance"),
        F.when(F.col("n_words") >= LEAST_COMMON, distance(common, F.col("common_counts"))).alias("word_distance"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > FAR_CHARS) | (F.coalesce("word_distance", F.lit(0.0)) > FAR_WORDS)
    return (
        compared.withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~far)
        .drop("short", "classes", "class_counts", "common", "common_counts", "_lang")
    )


def judged(docs: DataFrame, *carried: str) -> DataFrame:
    """The counts, distances and verdict of every row of `docs`, with the columns to carry.

    The counts are made in one pass and written to the checkpoint folder, so that the
    references and the verdicts don't read the texts again.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = counted(docs, *carried).checkpoint()
    return verdicts(rows, references(rows).checkpoint())


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns they have.

    The counts are made once and written with the rows, in the shared folder; references
    and verdicts are read from there.
    """
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/quality-{uuid4().hex}"
    whole_row = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    counted(whole_row, "_row").write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    good = verdicts(rows, references(rows.drop("_row")).checkpoint()).filter("kept")
    return good.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
