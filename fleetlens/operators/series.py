"""Per-series windows that stay balanced when one series dominates the data.

A series is one metric of one device. Row-frame windows need every row of a window
partition in one task, so a series holding a third of all readings would pin a third
of the work on one core. Series above `max_rows` readings are therefore cut into time
slices, and each slice is given copies of the few readings that precede it. A frame of
"the last 20 readings" then sees exactly the rows it would have seen in the uncut
series, and results are bit-identical. Series below the limit, normally all of them,
keep the plain single-shuffle window plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from fleetlens.functions.expressions import seconds_between
from fleetlens.session import ensure_checkpoint_dir

SERIES = ("device", "metric")

# Readings a single window partition may hold before its series is cut: about a
# quarter of a gigabyte of sorted rows per task.
MAX_ROWS = 4_000_000

# Hot-series lists up to this length (a few tens of bytes each) are broadcast.
BROADCAST_SERIES = 100_000

_MINUTE = 60_000_000
_SLICE = "_slice"
_COPY = "_copy"


def by_time(partition: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy("sampled_at")


def newest_first(partition: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(F.col("sampled_at").desc())


def rows_to_check(readings: DataFrame, max_rows: int | None) -> int | None:
    """`max_rows`, or None when even all readings together stay within it.

    None tells the functions below that no series can be too large. Counting a plain
    scan reads file footers only, so this is asked before filters and joins.
    """
    return None if max_rows is None or readings.count() <= max_rows else max_rows


def hot_series(readings: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame | None:
    """Series above `max_rows` readings with a slice width for each, or None.

    The width is a whole number of minutes such that even the busiest minute repeated
    throughout a slice stays within `max_rows`. Counting is pre-aggregated in the scan
    tasks, so the check does not suffer from the skew it looks for. The list is
    checkpointed: it is small, used several times, and must not change between uses.
    """
    if rows_to_check(readings, max_rows) is None:
        return None
    n = F.count(F.lit(1)).alias("_n")
    hot = readings.groupBy(*SERIES).agg(n).filter(F.col("_n") > max_rows).drop("_n")
    minute = F.floor(F.unix_micros("sampled_at") / F.lit(_MINUTE)).alias("_minute")
    busiest = F.max("_n")
    minutes = F.greatest(F.lit(1), F.floor(F.lit(max_rows) / busiest))
    widths = (
        readings.join(hot, list(SERIES), "left_semi")
        .groupBy(*SERIES, minute)
        .agg(n)
        .groupBy(*SERIES)
        .agg((minutes * F.lit(_MINUTE)).alias("_width"))
    )
    if hot.isEmpty():
        return None
    ensure_checkpoint_dir(readings.sparkSession)
    widths = widths.checkpoint()
    return F.broadcast(widths) if widths.count() <= BROADCAST_SERIES else widths


def _number_slices(readings: DataFrame, hot: DataFrame) -> DataFrame:
    """Number the time slice of each reading of a hot series; null for all others."""
    number = F.floor(F.unix_micros("sampled_at") / F.col("_width"))
    return readings.join(hot, list(SERIES), "left").select(*readings.columns, number.alias(_SLICE))


def _copies_before_slices(sliced: DataFrame, lookback: int) -> DataFrame:
    """For each slice of a hot series, its last `lookback` readings from earlier slices.

    Every slice is condensed to its own newest `lookback` readings. No slice is empty,
    so the `lookback` slices before it hold enough of them. Both lists are bounded by
    the lookback, whatever the size of the series.
    """
    others = [name for name in sliced.columns if name not in (_SLICE, "sampled_at")]
    ends = (
        sliced.filter(F.col(_SLICE).isNotNull())
        .withColumn("_rank", F.row_number().over(newest_first([*SERIES, _SLICE])))
        .filter(F.col("_rank") <= lookback)
        .groupBy(*SERIES, _SLICE)
        .agg(F.collect_list(F.struct("sampled_at", *others)).alias("_end"))
    )
    earlier = Window.partitionBy(*SERIES).orderBy(_SLICE).rowsBetween(-lookback, -1)
    before = ends.withColumn("_before", F.flatten(F.collect_list("_end").over(earlier)))
    kept = F.slice(F.sort_array("_before", asc=False), 1, lookback)
    return before.select(_SLICE, F.explode(kept).alias("_row")).select("_row.*", _SLICE)


def over_series(
    readings: DataFrame,
    lookback: int,
    add_columns: Callable[[DataFrame, list[str]], DataFrame],
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Apply windows that look back at most `lookback` readings, series by series.

    `add_columns(frame, partition)` adds window columns partitioned by `partition`,
    ordered by `sampled_at`. Slices of a hot series become separate partitions.
    """
    hot = hot_series(readings, max_rows)
    if hot is None:
        return add_columns(readings, list(SERIES))
    sliced = _number_slices(readings, hot)
    own = sliced.withColumn(_COPY, F.lit(False))
    copies = _copies_before_slices(sliced, lookback).withColumn(_COPY, F.lit(True))
    result = add_columns(own.unionByName(copies), [*SERIES, _SLICE])
    return result.filter(~F.col(_COPY)).drop(_SLICE, _COPY)


def rolling_stats(readings: DataFrame, window: int = 20, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Mean and population deviation over the reading itself and the `window` before it."""

    def stats(frame: DataFrame, partition: list[str]) -> DataFrame:
        frame_of = by_time(partition).rowsBetween(-window, 0)
        return frame.withColumns(
            {
                "mean": F.avg("value").over(frame_of),
                "std": F.coalesce(F.stddev_pop("value").over(frame_of), F.lit(0.0)),
            }
        )

    return over_series(readings, window, stats, max_rows)


def rolling_mean(
    readings: DataFrame, rows: int = 10, name: str = "rolling_mean_10", max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Trailing mean over `rows` readings of the whole history, the current one included."""

    def mean(frame: DataFrame, partition: list[str]) -> DataFrame:
        return frame.withColumn(
            name, F.avg("value").over(by_time(partition).rowsBetween(1 - rows, 0))
        )

    return over_series(readings, rows - 1, mean, max_rows)


def gaps(readings: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Seconds since the previous reading of the series; null on the first one."""

    def gap(frame: DataFrame, partition: list[str]) -> DataFrame:
        before = F.lag("sampled_at").over(by_time(partition))
        return frame.withColumn("gap_seconds", seconds_between(before, "sampled_at"))

    return over_series(readings, 1, gap, max_rows)


def newest(readings: DataFrame, n: int, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """The newest `n` readings of every series, with `rank` 1 for the newest.

    Spark limits the groups in the scan tasks already, so a task ships at most `n`
    readings per series. A hot series is in nearly every scan task; its survivors are
    limited slice by slice before they meet in one place.
    """
    hot = hot_series(readings, max_rows)
    rank = "rank"
    if hot is not None:
        readings = (
            _number_slices(readings, hot)
            .withColumn(rank, F.row_number().over(newest_first([*SERIES, _SLICE])))
            .filter(F.col(rank) <= n)
            .drop(rank, _SLICE)
        )
    ranked = readings.withColumn(rank, F.row_number().over(newest_first(SERIES)))
    return ranked.filter(F.col(rank) <= n)


def anchors(
    readings: DataFrame, checkpoints: DataFrame, window: int = 20, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Per series the time of the reading `window` places before the checkpoint.

    A scan from there carries a full window for the first reading after the
    checkpoint. Null when the series has too few readings up to its checkpoint.
    """
    bounds = checkpoints.select(*SERIES, "last_sampled_at")
    up_to = readings.select(*SERIES, "sampled_at").join(bounds, list(SERIES))
    up_to = up_to.filter(F.col("sampled_at") <= F.col("last_sampled_at"))
    place = newest(up_to.drop("last_sampled_at"), window + 1, max_rows)
    full = F.when(F.col("rank") == window + 1, F.col("sampled_at"))
    return place.groupBy(*SERIES).agg(F.max(full).alias("anchor"))


def latest_per_series(readings: DataFrame, carry: Sequence[str] = ("value",)) -> DataFrame:
    """The newest reading of every (device, metric, unit).

    Carried columns of primitive type keep this a hash aggregate with a map-side
    combine: no sort, and one row per series leaves each scan task.
    """
    keys = [*SERIES, *(["unit"] if "unit" in readings.columns else [])]
    picks = [F.max_by(name, "sampled_at").alias(name) for name in carry]
    latest = readings.groupBy(*keys).agg(F.max("sampled_at").alias("sampled_at"), *picks)
    if len(keys) == len(SERIES):
        return latest
    # the unit is a property of the metric; should a series change its unit, the
    # newest reading decides
    rest = F.struct("sampled_at", "unit", *carry)
    return latest.groupBy(*SERIES).agg(F.max_by(rest, "sampled_at").alias("_r")).select(
        *SERIES, "_r.*"
    )


def latest_per_device(readings: DataFrame, carry: Sequence[str] = ("value",)) -> DataFrame:
    """The newest reading of every device across its metrics.

    Two metrics sampled at the same instant: the alphabetically last one is shown.
    """
    latest = latest_per_series(readings, carry)
    rest = [name for name in latest.columns if name != "device"]
    pick = F.max_by(F.struct(*rest), F.struct("sampled_at", "metric")).alias("_r")
    return latest.groupBy("device").agg(pick).select("device", "_r.*")
