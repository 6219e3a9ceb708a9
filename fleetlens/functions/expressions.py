"""Scalar expressions: time differences, validation, status, histogram quantiles.

Everything here is a composition of built-in functions, so it stays inside
whole-stage code generation. No expression reads the wall clock; callers pass the
moment they want to compare against.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values (they define the results).
ONLINE_SECONDS = 6.0  # three reporting intervals of two seconds
OFFLINE_SECONDS = 60.0
STATUS_RANKS = (("online", 1), ("stale", 2), ("offline", 3))
REASON_NON_FINITE = "non_finite_value"
REASON_MISSING_TEXT = "missing_metric_or_unit"
LAG_BOUNDS_SECONDS = (0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def timestamp_at(moment) -> Column:
    """A timestamp column from a Column, a datetime or an ISO text."""
    if isinstance(moment, Column):
        return moment
    return F.lit(moment).cast("timestamp")


def seconds_between(start, end) -> Column:
    """Seconds from `start` to `end` as a double, exact to the microsecond."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def is_finite(value: Column) -> Column:
    """True for an ordinary number; false for null, NaN and the infinities.

    Spark orders NaN above every number, so a plain `>` would accept it.
    """
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def reject_reason(value: Column, metric: Column, unit: Column) -> Column:
    """Why a reading fails structural validation; null when it passes."""
    blank = [c.isNull() | (c == "") for c in (metric, unit)]
    return F.when(~is_finite(value), REASON_NON_FINITE).when(blank[0] | blank[1], REASON_MISSING_TEXT)


def clamp_zero(value: Column) -> Column:
    """Negative numbers become zero; null stays null."""
    return F.when(value < 0, F.lit(0).cast("double")).otherwise(value.cast("double"))


def ingest_lag(sampled_at: Column, ingested_at: Column) -> Column:
    """Platform clock minus device clock in seconds, never negative."""
    return clamp_zero(seconds_between(sampled_at, ingested_at))


def device_status(
    staleness: Column, online: float = ONLINE_SECONDS, stale: float = OFFLINE_SECONDS
) -> Column:
    """online / stale / offline; a device without a staleness is offline."""
    return (
        F.when(staleness <= online, "online").when(staleness <= stale, "stale").otherwise("offline")
    )


def status_rank(status: Column) -> Column:
    """Order of severity, so that `max` finds the worst status of a group."""
    return F.coalesce(*[F.when(status == name, F.lit(rank)) for name, rank in STATUS_RANKS])


def status_of_rank(rank: Column) -> Column:
    return F.coalesce(*[F.when(rank == number, F.lit(name)) for name, number in STATUS_RANKS])


def reading_key(device: Column, metric: Column, sampled_at: Column) -> Column:
    """128-bit text id of a reading, a pure function of its natural key.

    A replayed message gets the same id on every executor; the zero character keeps
    ("a", "bc") and ("ab", "c") apart.
    """
    parts = [device.cast("string"), metric, F.unix_micros(sampled_at).cast("string")]
    return F.md5(F.concat_ws("\u0000", *parts))


def bucket_counts(value: Column, bounds: Sequence[float], prefix: str = "le_") -> list[Column]:
    """One conditional count per upper bound (cumulative), for use inside `agg`."""
    return [
        F.count_if(value <= bound).alias(bucket_name(bound, prefix)) for bound in bounds
    ]


def bucket_name(bound: float, prefix: str = "le_") -> str:
    return prefix + f"{bound:g}".replace(".", "_")


def histogram_quantile(
    q: float, total: str, bounds: Sequence[float], prefix: str = "le_"
) -> Column:
    """Quantile estimated from cumulative bucket counts by linear interpolation.

    The estimate walks to the first bucket holding the wanted rank and interpolates
    between its bounds; a rank beyond the last finite bound answers that bound.
    Bucket counts merge by addition, so a quantile over any number of rows needs
    only a dozen counters per group. `total` names the column with the full count.
    """
    rank = f"({q}D * {total})"
    cases = []
    lower, below = "0D", "0"
    for bound in bounds:
        here, upper = bucket_name(bound, prefix), f"{float(bound)}D"
        share = f"({rank} - {below}) / nullif({here} - {below}, 0)"
        cases.append(f"WHEN {here} >= {rank} THEN {lower} + ({upper} - {lower}) * {share}")
        lower, below = upper, here
    return F.expr(f"CASE WHEN {total} = 0 THEN NULL {' '.join(cases)} ELSE {lower} END")
