"""Pipeline quality: rates, ingest lag, consumer lag, alert conditions.

All of it works on counters per minute. Trailing windows are formed by letting each
minute contribute to the few minutes whose window covers it, a bounded fan-out on
already aggregated rows, instead of a window function over one global sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.expressions import (
    LAG_BOUNDS_SECONDS,
    bucket_counts,
    bucket_name,
    clamp_zero,
    histogram_quantile,
    ingest_lag,
)
from fleetlens.operators.rollup import time_spine

# Alert limits and how long a condition must hold, in minutes.
STALL_WINDOW, STALL_HOLD = 2, 2
LAG_LIMIT, LAG_HOLD = 500, 1
SLOW_WINDOW, SLOW_HOLD, SLOW_SECONDS = 5, 2, 30.0
STALLED, BEHIND, SLOW = "no_readings_ingested", "high_consumer_lag", "high_ingest_lag"


def event_rate(rows: DataFrame, time: str, minutes: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Events per second in tumbling windows, optionally per group."""
    window = F.window(F.col(time), f"{minutes} minutes")
    return (
        rows.groupBy(window.alias("_w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("_w.start").alias("window_start"),
            *by,
            "n",
            (F.col("n") / F.lit(minutes * 60.0)).alias("per_second"),
        )
    )


def duplicate_rate(stats: DataFrame, minutes: int = 1) -> DataFrame:
    """Repeated messages per second in tumbling windows, from the counts of ingest batches."""
    window = F.window(F.col("at"), f"{minutes} minutes")
    summed = stats.groupBy(window["start"].alias("window_start")).agg(
        F.sum("arrived").alias("arrived"), F.sum("duplicates").alias("duplicates")
    )
    return summed.withColumn("per_second", F.col("duplicates") / F.lit(minutes * 60.0))


def with_lag(readings: DataFrame) -> DataFrame:
    """Add the ingest lag in seconds, never negative."""
    return readings.withColumn("lag_seconds", ingest_lag(F.col("sampled_at"), F.col("ingested_at")))


def lag_buckets(rows: DataFrame, by: tuple[str, ...] = (), lag: str = "lag_seconds") -> DataFrame:
    """Cumulative lag counts per bound with the median and the 95th percentile."""
    counted = rows.groupBy(*by).agg(
        F.count(lag).alias("n"), *bucket_counts(F.col(lag), LAG_BOUNDS_SECONDS)
    )
    return counted.withColumns(
        {name: _quantile(q) for name, q in (("p50", 0.5), ("p95", 0.95))}
    )


def _quantile(q: float) -> Column:
    return histogram_quantile(q, "n", LAG_BOUNDS_SECONDS)


def consumer_lag(offsets: DataFrame, ends: DataFrame) -> DataFrame:
    """Messages not consumed yet per partition; `ends` holds each next free offset."""
    behind = F.col("end_offset") - (F.col("last_offset") + 1)
    return offsets.join(ends, ["topic", "partition"]).select(
        "consumer",
        "topic",
        "partition",
        "last_offset",
        "end_offset",
        F.greatest(F.lit(0).cast("long"), behind).alias("lag"),
    )


def total_lag(lags: DataFrame) -> DataFrame:
    return lags.groupBy("consumer").agg(F.sum("lag").alias("lag"))


def _trailing(rows: DataFrame, minutes: int) -> DataFrame:
    """Let each minute count towards itself and the `minutes` - 1 minutes after it."""
    last = F.col("minute") + F.expr(f"INTERVAL {minutes - 1} MINUTES")
    reach = F.sequence("minute", last, F.expr("INTERVAL 1 MINUTE"))
    return rows.withColumn("minute", F.explode(reach))


def held(flags: DataFrame, minutes: int) -> DataFrame:
    """Minutes at whose end a condition was true for `minutes` minutes in a row."""
    votes = _trailing(flags.select("minute"), minutes)
    return votes.groupBy("minute").count().filter(F.col("count") == minutes).select("minute")


def _minute(time: str) -> Column:
    return F.date_trunc("minute", F.col(time)).alias("minute")


def _alert(minutes: DataFrame, name: str) -> DataFrame:
    return minutes.select(F.lit(name).alias("alert"), "minute")


def stalled_minutes(readings: DataFrame, start, end, time: str = "ingested_at") -> DataFrame:
    """Minutes at which nothing had been ingested for the stall window, long enough."""
    spark = readings.sparkSession
    spine = time_spine(spark.range(1), start, end, "1 MINUTE", "minute").select("minute")
    busy = _trailing(readings.select(_minute(time)).distinct(), STALL_WINDOW).distinct()
    return _alert(held(spine.join(busy, "minute", "left_anti"), STALL_HOLD), STALLED)


def slow_minutes(
    readings: DataFrame, lag: str = "lag_seconds", time: str = "ingested_at"
) -> DataFrame:
    """Minutes at which the 95th percentile of the ingest lag was above its limit."""
    names = ["n", *[bucket_name(bound) for bound in LAG_BOUNDS_SECONDS]]
    per_minute = readings.groupBy(_minute(time)).agg(
        F.count(lag).alias("n"), *bucket_counts(clamp_zero(F.col(lag)), LAG_BOUNDS_SECONDS)
    )
    window = _trailing(per_minute, SLOW_WINDOW).groupBy("minute")
    summed = window.agg(*[F.sum(name).alias(name) for name in names])
    slow = summed.filter(_quantile(0.95) > F.lit(SLOW_SECONDS))
    return _alert(held(slow, SLOW_HOLD), SLOW)


def in_flight(readings: DataFrame) -> DataFrame:
    """Per minute the messages sampled before its start and ingested after it.

    The total consumer lag as seen from the stored readings. Each late message is one
    step up and one step down, added up per minute before anything is shuffled; the
    running sum goes day by day, on top of what the days before have left. How late a
    message was costs nothing, only the minutes of the answer are spread out.
    """
    minute = F.expr("INTERVAL 1 MINUTE")
    first = F.date_trunc("minute", F.col("sampled_at")) + minute
    last = F.date_trunc("minute", F.col("ingested_at"))
    up = F.struct(first.alias("minute"), F.lit(1).cast("long").alias("step"))
    down = F.struct((last + minute).alias("minute"), F.lit(-1).cast("long").alias("step"))
    steps = readings.filter(first <= last).select(F.inline(F.array(up, down)))
    summed = steps.groupBy("minute").agg(F.sum("step").alias("step")).withColumn("day", F.to_date("minute"))
    days = summed.groupBy("day").agg(F.sum("step").alias("rest"), F.min("minute").alias("opens"))
    in_order = Window.orderBy("day")  # one row per day
    days = days.select(
        "day",
        F.coalesce(F.sum("rest").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("opens").over(in_order).alias("following"),
    )
    in_day = Window.partitionBy("day").orderBy("minute")
    running = summed.select(
        "day", "minute", F.sum("step").over(in_day).alias("lag"), F.lead("minute").over(in_day).alias("until")
    ).join(days, "day")
    level = running.select("minute", F.coalesce("until", "following").alias("until"), (F.col("lag") + F.col("before")).alias("lag"))
    spans = level.filter((F.col("lag") > 0) & F.col("until").isNotNull())
    return spans.select(F.explode(F.sequence("minute", F.col("until") - minute, minute)).alias("minute"), "lag")


def behind_minutes(lag_per_minute: DataFrame, limit: int = LAG_LIMIT) -> DataFrame:
    """Minutes at which the summed consumer lag was above its limit."""
    summed = lag_per_minute.groupBy("minute").agg(F.sum("lag").alias("lag"))
    return _alert(held(summed.filter(F.col("lag") > limit), LAG_HOLD), BEHIND)


def alerts(*conditions: DataFrame) -> DataFrame:
    """All firing alerts as (alert, minute) rows."""
    first, *rest = conditions
    for other in rest:
        first = first.unionByName(other)
    return first
