"""Mix sources to target weights with thresholds on a hash.

Every document has a draw, a 60-bit hash of its id. A source whose target is r times
its size is taken floor(r) times whole, and once more for the documents whose draw is
below the source's threshold. The threshold comes from histograms: sizes are summed by
source and leading digit of the draw, the digit in which the budget runs out is found,
and only that bucket is refined by the next digit. No document is sorted, and documents
meet no other rows than one per source.

Null or empty texts have size 0. Documents without a source form a source of their own.
Rows with equal ids (null is an id) have the same draw and are taken alike. Targets are
met to within half of the row (or rows of equal id) at the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.text import word_count
from fleetlens.operators.sizes import broadcast_if_small
from fleetlens.session import ensure_checkpoint_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
DIGITS = 5
DIGIT_BITS = 12
DIGIT = 1 << DIGIT_BITS


def draw(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; of the empty string for null."""
    head = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(head, 16, 10).cast("long")


def digit(number: Column, level: int) -> Column:
    """The digit at a level, the leading one at level 0."""
    return F.shiftright(number, DIGIT_BITS * (DIGITS - 1 - level)).bitwiseAND(DIGIT - 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, have the weights in turn. They share
    `share` of all sizes by weight; none gets over `most` times its size, and what it
    can't take goes to the others. Filling in order of size over weight finds the level
    at which no more source is full. The windows run over one row per source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    whole = F.lit(share) * F.sum("source_size").over(everything)
    filled = F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = (whole - filled) / F.sum("weight").over(after)
    fits = level * F.col("weight") <= F.lit(float(most)) * F.col("source_size")
    found = weighed.select("*", level.alias("level"), fits.alias("fits"), F.row_number().over(Window.orderBy(*order)).alias("nth"))
    lowest = F.min_by("level", F.when(F.col("fits"), F.col("nth"))).over(everything)
    full = F.lit(float(most)) * F.col("source_size")
    aim = F.least(full, F.coalesce(lowest * F.col("weight"), full))
    return found.select("source", "source_size", aim.alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, threshold): draws below it are taken once more."""
    ratio = F.col("target") / F.col("source_size")
    passes = F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long")
    bounds = aims.withColumn("passes", passes).select(
        "*",
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("threshold"),
    )
    for level in range(DIGITS):
        near = sized
        if level:
            shift = DIGIT_BITS * (DIGITS - level)
            prefix = F.shiftright("draw", shift) == F.shiftright("threshold", shift)
            open_ones = bounds.select(F.col("source").alias("_s"), "threshold")
            near = sized.join(open_ones, F.col("source").eqNullSafe(F.col("_s")) & prefix).drop("_s", "threshold")
        sums = near.groupBy("source", digit(F.col("draw"), level).alias("digit")).agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        running = sums.withColumn("up_to", F.sum("words").over(up_to)).withColumnRenamed("source", "_s")
        beyond = running.join(bounds.select("source", "left"), F.col("_s").eqNullSafe(F.col("source")))
        first = (
            beyond.filter(F.col("up_to") > F.col("left"))
            .groupBy("source")
            .agg(F.min_by(F.struct("digit", "words", "up_to"), "digit").alias("at"))
            .withColumnRenamed("source", "_s")
        )
        step = F.lit(1 << (DIGIT_BITS * (DIGITS - 1 - level))).cast("long")
        last = level == DIGITS - 1
        left = F.col("left") - (F.col("at.up_to") - F.col("at.words"))
        # The last bucket is a single draw; it is taken if that comes nearer to the target.
        nearer = F.when(left * 2 > F.col("at.words"), F.col("at.digit") + 1).otherwise(F.col("at.digit"))
        found = F.coalesce(nearer if last else F.col("at.digit"), F.lit(0))
        bounds = bounds.join(first, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source",
            "source_size",
            "target",
            "passes",
            F.coalesce(left, F.lit(0.0)).alias("left"),
            (F.col("threshold") + found * step).alias("threshold"),
        )
        if not last:
            bounds = bounds.checkpoint()
    return bounds.drop("left")


def _near(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """`rows` with the columns of their source's bounds, which are broadcast if few."""
    small = broadcast_if_small(bounds.withColumnRenamed("source", "_s"))
    return rows.join(small, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def bounds_of(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, draw) of `docs`, and per source its target and threshold.

    Both are written to the checkpoint folder, so texts are read once for all levels.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    sized = docs.select(
        "doc_id", "source", word_count("text").alias("size"), draw(F.col("doc_id")).alias("draw")
    ).checkpoint()
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, thresholds(sized, targets(sizes, weights, share, most).checkpoint()).checkpoint()


def copies() -> Column:
    return F.col("passes") + (F.col("draw") < F.col("threshold")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of `docs`.

    `docs` has doc_id, text and source; other columns are ignored. An empty table gives
    an empty result.
    """
    sized, bounds = bounds_of(docs, weights, share, most)
    return (
        _near(sized, bounds)
        .withColumn("copies", copies())
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of `docs` the mix takes, each as often as it takes them."""
    _, bounds = bounds_of(docs, weights, share, most)
    kept = bounds.select("source", "passes", "threshold")
    drawn = _near(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", draw(F.col("doc_id")).alias("draw")), kept)
    taken = drawn.withColumn("copies", copies()).filter(F.col("copies") > 0)
    again = taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return again.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
