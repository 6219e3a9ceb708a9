"""Drop lines that many documents share.

A line's key is the line without spaces at both ends and with A-Z in lower case; a key
stands as two 64-bit hashes. Occurrences are range-partitioned by key and a share of
the documents, and sorted by document and position, so each run of a key streams past
once: where the document changes, a first occurrence is counted. A key that fills a
third of all rows is spread over as many shares as there are partitions; the shares'
counts are added up afterwards, and its occurrences meet it through a broadcast. Lines
are hashed once and written to the checkpoint folder. Documents get back a sparse bitmap
of what they lose, 64 lines to a word, words without a dropped line left out; no text is
moved but to meet its bitmap.

A null text is an empty line. Empty keys are never dropped. Rows that repeat an id
count as one document; each row loses its own lines. Null is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.filter_audit import met
from fleetlens.llm.text import SPACES, let, lower_ascii, partitions, whole
from fleetlens.session import ensure_checkpoint_dir

DOCUMENTS = 10
CODE_POINTS = 1
WORD_BITS = 64


def lines_of(text: str = "text") -> Column:
    return F.split(whole(text), "\n")


def key_of(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def occurrences(docs: DataFrame, code_points: int = CODE_POINTS) -> DataFrame:
    """(doc_id, version, pos, h1, h2) for each line with a key; version tells repeated ids apart."""
    located = docs.select(
        "doc_id", F.xxhash64(whole("text")).alias("version"), F.posexplode(lines_of()).alias("pos", "line")
    )
    keyed = located.withColumn("key", key_of(F.col("line"))).filter(F.char_length("key") >= code_points)
    return keyed.select(
        "doc_id",
        "version",
        "pos",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second"), "key").alias("h2"),
    )


def shared_keys(ranged: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(h1, h2, n, n_documents) of the keys found in at least so many documents, n times."""
    run = Window.partitionBy("h1", "h2", "share").orderBy("doc_id", "version", "pos")
    before = F.lag(F.struct("doc_id")).over(run)
    first = before.isNull() | ~before["doc_id"].eqNullSafe(F.col("doc_id"))
    streamed = ranged.withColumn("first", first.cast("long"))
    by_share = streamed.groupBy("h1", "h2", "share").agg(F.count("*").alias("n"), F.sum("first").alias("n_documents"))
    totals = by_share.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("n_documents").alias("n_documents"))
    return totals.filter(F.col("n_documents") >= documents)


def drop_bitmaps(docs: DataFrame, documents: int = DOCUMENTS, code_points: int = CODE_POINTS) -> DataFrame:
    """(doc_id, version, n_dropped, bitmap) of the documents that lose a line.

    bitmap: array of (word, bits), ascending; bit i of word w stands for line 64 w + i,
    and is set if the line goes. What it doesn't name is kept.
    """
    n = partitions(docs)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    ensure_checkpoint_dir(docs.sparkSession)
    found = occurrences(docs, code_points).checkpoint()
    ranged = found.withColumn("share", share).repartitionByRange(n, "h1", "h2", "share")
    dropped = met(found, shared_keys(ranged, documents).checkpoint(), ["h1", "h2"], found.count())
    bit = F.expr("shiftleft(1L, pos % 64)")
    by_word = (
        dropped.groupBy("doc_id", "version", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    return by_word.groupBy("doc_id", "version").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"),
    )


def kept_text(lines: Column, bitmap: Column) -> Column:
    """The lines a bitmap keeps, joined by \\n."""
    at = F.map_from_entries(bitmap)
    last = F.element_at(bitmap, -1)["word"]
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(at, w), F.lit(0)))

    def kept(bits: Column) -> Column:
        def stays(line: Column, i: Column) -> Column:
            word = F.coalesce(F.get(bits, F.floor(i / WORD_BITS).cast("int")), F.lit(0))
            return F.getbit(word, F.pmod(i, F.lit(WORD_BITS))) == 0

        return F.array_join(F.filter(lines, stays), "\n")

    return let(dense, kept)


def deduped(docs: DataFrame, documents: int = DOCUMENTS, code_points: int = CODE_POINTS) -> DataFrame:
    """`docs` with n_lines, n_dropped and kept_text; columns of these names give way."""
    made = ("n_lines", "n_dropped", "kept_text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col("doc_id").alias("id"), whole("text").alias("text"))
    keyed = keyed.withColumn("text_version", F.xxhash64("text"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_version") == F.col("version"))
    joined = keyed.join(drop_bitmaps(docs, documents, code_points), same, "left")
    kept = F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(kept_text(lines_of(), F.col("bitmap")))
    return joined.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in made],
        F.size(lines_of()).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        kept.alias("kept_text"),
    )
