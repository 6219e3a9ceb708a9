"""Audit how filters interact: what each removes, in every order of applying them.

Every filter's failing documents are stored as an id table of their own. What a step of
an order removes depends on the set of filters before it only, so each id is tested
once for every such set: a left anti join against the tables of the set leaves what the
step removes, a left semi join finds what was removed before. Both joins are dealt by
document, and the sets are unfolded after the shuffle, so each id is moved once. The
orders are put together from the counts by part, filter and set, which are few.

A document's failures follow from its id and text, so rows are joined by a 128-bit hash
of both and rows that repeat an id and a text are summed before they are shuffled. A
null text is empty, a null part the empty string. A null id has no labels and is no
smaller than any other, so nothing is a copy of it. Of repeated labels of an id the
largest counts. Rows that share id and text are no copies of each other. An empty table
gives no rows. Texts with many copies are met through a broadcast of at most HOT_KEYS
rows, all others by a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.text import partitions, whole, words
from fleetlens.session import ensure_checkpoint_dir

# A key with over 1 / HOT_KEYS of all rows is hot; there are fewer than HOT_KEYS of them.
HOT_KEYS = 10_000

Rule = Callable[[Column, Column], Column]

# By letter: whether a text with these words fails.
RULES: dict[str, Rule] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPIES = "E"
STORED = "doc_id long, k1 long, k2 long, part string, n long, good long, toxic long, filter string"


def judged(docs: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(doc_id, part, h1, h2, fails) of each row; h1 and h2 hash the text, fails lists letters."""
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), whole("text").alias("text"))
    worded = texts.withColumn("words", words("text"))
    found = [F.when(rule(F.col("text"), F.col("words")), F.lit(letter)) for letter, rule in rules.items()]
    return worded.select(
        "doc_id",
        "part",
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit("second"), "text").alias("h2"),
        F.array_compact(F.array(*found)).alias("fails"),
    )


def met(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with groups, one row (on, n, ...) for each key with n rows."""
    is_hot = F.col("n") * HOT_KEYS > total
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    light = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return light.unionByName(rows.join(F.broadcast(hot), on))


def copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller id has."""
    named = rows.filter(F.col("doc_id").isNotNull())
    groups = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    shared = groups.filter("least < most").drop("most").checkpoint()
    return met(named, shared, ["h1", "h2"], named.count()).filter("doc_id > least").select(rows.columns)


def failing_tables(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """The stored id tables, with the filter as a column; and the documents of each part.

    A row stands for n rows of equal id and text in a part, of which good and toxic are
    labelled so.
    """
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/audit-{uuid4().hex}"
    rows = judged(docs, rules).checkpoint()
    alone = rows.select("*", F.explode("fails").alias("filter"))
    every = alone.unionByName(copies(rows).withColumn("filter", F.lit(COPIES)))
    key = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("h1"), F.col("h2")]
    summed = (
        every.withColumn("k1", F.xxhash64(*key))
        .withColumn("k2", F.xxhash64(F.lit("second"), *key))
        .groupBy("doc_id", "k1", "k2", "part", "filter")
        .agg(F.count("*").alias("n"))
    )
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    named = summed.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left")
    nameless = summed.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    counted = named.unionByName(nameless).withColumns(
        {c: F.col("n") * F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}
    )
    counted.write.partitionBy("filter").parquet(folder)
    stored = docs.sparkSession.read.schema(STORED).parquet(folder)
    return stored, rows.groupBy("part").agg(F.count("*").alias("total"))


def bit_of(letters: list[str]) -> Column:
    """The bit that stands for a row's filter in a set of filters."""
    return reduce(lambda rest, i: F.when(F.col("filter") == letters[i], F.lit(1 << i)).otherwise(rest), range(len(letters)), F.lit(0))


def sets_without(bit: Column, letters: list[str]) -> Column:
    every = F.sequence(F.lit(0), F.lit(2 ** len(letters) - 1))
    return F.filter(every, lambda s: s.bitwiseAND(bit) == 0)


def by_prefix(failing: DataFrame, letters: list[str]) -> tuple[DataFrame, DataFrame]:
    """By part, filter and set of filters before it: what the step removes, and what was
    removed before though it fails the filter too."""
    n = partitions(failing)
    marked = failing.withColumn("bit", bit_of(letters))
    asked = marked.repartition(n, "k1", "k2").withColumn("prefix", F.explode(sets_without(F.col("bit"), letters)))
    tables = marked.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("bit").alias("table")).repartition(n, "t1", "t2")
    before = (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")) & (F.col("prefix").bitwiseAND(F.col("table")) != 0)
    keys = ["part", "filter", "prefix"]
    removed = asked.join(tables, before, "left_anti").groupBy(*keys).agg(
        F.sum("n").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")
    )
    return removed, asked.join(tables, before, "left_semi").groupBy(*keys).agg(F.sum("n").alias("redundant"))


def steps(letters: list[str]) -> list[tuple[str, int, str, int]]:
    """(order, step, filter, prefix) of every step of every order."""
    at = {letter: 1 << i for i, letter in enumerate(letters)}
    return [
        ("".join(order), i + 1, letter, sum(at[x] for x in order[:i]))
        for order in permutations(letters)
        for i, letter in enumerate(order)
    ]


def audited(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """A row for each part (source), order of the filters and step, zeros included.

    labels are (doc_id, quality, toxic). Orders grow with the factorial of the filters.
    """
    letters = [*rules, COPIES]
    full = 2 ** len(letters) - 1
    failing, parts = failing_tables(docs, labels, rules)
    removed, redundant = by_prefix(failing, letters)
    filters = parts.select("*", F.explode(F.array(*map(F.lit, letters))).alias("filter")).withColumn("bit", bit_of(letters))
    grid = filters.withColumn("prefix", F.explode(sets_without(F.col("bit"), letters)))
    keys = ["part", "filter", "prefix"]
    counts = grid.join(removed, keys, "left").join(redundant, keys, "left").na.fill(0)
    own = Window.partitionBy("part", "filter")
    # The orders in which a set comes before a filter and the rest after it.
    orders = F.array(*[F.lit(factorial(i) * factorial(len(letters) - 1 - i)) for i in range(len(letters))])
    weight = F.get(orders, F.bit_count("prefix"))
    counts = counts.withColumn("shapley", F.sum(F.col("removed") * weight).over(own)).withColumn(
        "unique_fails", F.max(F.when(F.col("prefix") + F.col("bit") == full, F.col("removed"))).over(own)
    )
    listed = docs.sparkSession.createDataFrame(steps(letters), "filter_order string, step int, filter string, prefix int")
    placed = counts.join(F.broadcast(listed), ["filter", "prefix"])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return placed.withColumn("kept", F.col("total") - F.sum("removed").over(so_far)).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter"
    )
