"""Mergeable summaries kept per hour or minute: distinct devices and quantiles of raw lags.

Sketches of disjoint readings merge, so any longer range is answered from the stored rows
without the readings. Distinct counts have a relative standard error of 1.04 / sqrt(2^size)
(0.8 % at the default size, exact while few); quantiles a rank error that falls with k
(about 0.9 % at 300 with 99 % confidence, exact while n is at most k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.expressions import timestamp_at

LG_SIZE = 14
K = 300


def hourly_devices(readings: DataFrame, lg_size: int = LG_SIZE) -> DataFrame:
    """(metric, hour, devices, n): a sketch of the devices of each metric and hour.

    Partial sketches are made before the shuffle, so what moves is one sketch for each
    task, metric and hour.
    """
    hour = F.date_trunc("hour", F.col("sampled_at")).alias("hour")
    return readings.groupBy("metric", hour).agg(
        F.hll_sketch_agg(F.col("device").cast("string"), lg_size).alias("devices"), F.count(F.lit(1)).alias("n")
    )


def distinct_devices(hours: DataFrame, start=None, end=None, by: tuple[str | Column, ...] = ()) -> DataFrame:
    """Estimated devices, and readings, of the hours in [start, end), by any columns of theirs."""
    if start is not None:
        hours = hours.filter(F.col("hour") >= timestamp_at(start))
    if end is not None:
        hours = hours.filter(F.col("hour") < timestamp_at(end))
    union = F.hll_sketch_estimate(F.hll_union_agg("devices")).alias("devices")
    return hours.groupBy(*by).agg(union, F.sum("n").alias("n"))


def lag_sketches(rows: DataFrame, by: tuple[str, ...] = (), time: str = "ingested_at", k: int = K) -> DataFrame:
    """(minute, *by, lags, n): a sketch of the lags in `lag_seconds` of each minute."""
    minute = F.date_trunc("minute", F.col(time)).alias("minute")
    usable = rows.filter(F.col("lag_seconds").isNotNull() & ~F.isnan("lag_seconds"))
    lag = F.col("lag_seconds").cast("double")
    return usable.groupBy(minute, *by).agg(F.kll_sketch_agg_double(lag, k).alias("lags"), F.count(F.lit(1)).alias("n"))


def lag_quantiles(
    minutes: DataFrame, window: str = "5 minutes", by: tuple[str, ...] = (), quantiles=(("p50", 0.5), ("p95", 0.95))
) -> DataFrame:
    """(window_start, *by, n, and a column for each quantile), merged from minutes."""
    start = F.window("minute", window)["start"].alias("window_start")
    merged = minutes.groupBy(start, *by).agg(F.kll_merge_agg_double("lags").alias("_lags"), F.sum("n").alias("n"))
    found = [F.kll_sketch_get_quantile_double("_lags", F.lit(float(q))).alias(name) for name, q in quantiles]
    return merged.select("window_start", *by, "n", *found)


def rank_bounds(rows: DataFrame, found: DataFrame, name: str, by: tuple[str, ...], lag: str = "lag_seconds") -> DataFrame:
    """`found` with name_below and name_upto: the shares of the rows whose lag is below,
    and at most, the quantile of that name. For holding quantiles against raw rows."""
    joined = rows.select(*by, lag).join(found.select(*by, F.col(name).alias("_q")), list(by))
    shares = joined.groupBy(*by).agg(
        F.avg((F.col(lag) < F.col("_q")).cast("double")).alias(f"{name}_below"),
        F.avg((F.col(lag) <= F.col("_q")).cast("double")).alias(f"{name}_upto"),
    )
    return found.join(shares, list(by))
