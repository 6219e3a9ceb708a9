"""Hourly rollups and the regular time grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.expressions import timestamp_at

ROLLUP_KEY = ("device", "metric", "hour")


def hourly(readings: DataFrame) -> DataFrame:
    """Average, extremes and count per series and hour.

    The sum is kept next to the count so that partial hours add up.
    """
    value = F.col("value")
    hour = F.date_trunc("hour", F.col("sampled_at")).alias("hour")
    grouped = readings.groupBy("device", "metric", hour).agg(
        F.sum(value).alias("sum_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count(F.lit(1)).alias("n"),
    )
    return with_average(grouped)


def merge_hourly(parts: DataFrame) -> DataFrame:
    """Combine rollup rows of the same hour that were computed from disjoint readings."""
    merged = parts.groupBy(*ROLLUP_KEY).agg(
        F.sum("sum_value").alias("sum_value"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("n").alias("n"),
    )
    return with_average(merged)


def with_average(rollup: DataFrame) -> DataFrame:
    average = F.col("sum_value") / F.col("n")
    return rollup.select(
        *ROLLUP_KEY, average.alias("avg_value"), "min_value", "max_value", "n", "sum_value"
    )


def time_spine(keys: DataFrame, start, end, step: str, name: str = "slot") -> DataFrame:
    """Every key with every point of a regular grid.

    The grid is generated inside each key's row, so there is no join and nothing to
    collect; it grows with the number of keys, in parallel.
    """
    grid = F.sequence(timestamp_at(start), timestamp_at(end), F.expr(f"INTERVAL {step}"))
    return keys.select("*", F.explode(grid).alias(name))


def missing_hours(readings: DataFrame, devices: DataFrame, start, end) -> DataFrame:
    """Device-hours of the range without a single reading."""
    begin, until = timestamp_at(start), timestamp_at(end)
    present = (
        readings.filter(F.col("sampled_at").between(begin, until + F.expr("INTERVAL 1 HOUR")))
        .select("device", F.date_trunc("hour", F.col("sampled_at")).alias("slot"))
        .distinct()
    )
    spine = time_spine(devices.select("device"), begin, until, "1 HOUR")
    return spine.join(present, ["device", "slot"], "left_anti")
