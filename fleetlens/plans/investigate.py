"""Investigation questions: series, gaps, anomalies, genealogy, time-range reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.functions.expressions import timestamp_at
from fleetlens.operators.detect import evaluable, mark_evaluated
from fleetlens.operators.rollup import hourly
from fleetlens.operators.series import (
    MAX_ROWS,
    SERIES,
    by_time,
    gaps,
    newest,
    rolling_mean,
    rolling_stats,
)

# Bounds and defaults of the report sizes, and the display band.
SERIES_POINTS, SERIES_POINTS_MAX = 120, 2000
RECENT, RECENT_MAX = 20, 200
DISPLAYED = 3
DETAIL_FIELDS = (
    "value double, mean double, sigma double, range array<double>, recent_mean double, "
    "baseline double, gap_seconds double"
)
FLAGGED = 6
BAND_SIGMA, BAND_SHARE, BAND_FLOOR = 1.5, 0.01, 0.2
SEVERITIES = ("critical", "warn", "info")


def narrow(rows: DataFrame, device=None, metric: str | None = None) -> DataFrame:
    """Restrict to one device and/or metric; without either, all series are answered."""
    if device is not None:
        rows = rows.filter(F.col("device") == F.lit(device))
    if metric is not None:
        rows = rows.filter(F.col("metric") == metric)
    return rows


def between(rows: DataFrame, start, end) -> DataFrame:
    """Inclusive time range; a `day` partition column is filtered along with it."""
    start, end = timestamp_at(start), timestamp_at(end)
    rows = rows.filter(F.col("sampled_at").between(start, end))
    if "day" in rows.columns:
        rows = rows.filter(F.col("day").between(F.to_date(start), F.to_date(end)))
    return rows


def series_points(
    readings: DataFrame,
    limit: int = SERIES_POINTS,
    device=None,
    metric: str | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """The last `limit` points of each series with a 10-point mean, in no order.

    The mean starts over at the oldest point returned.
    """
    if not 1 <= limit <= SERIES_POINTS_MAX:
        raise ValueError(f"limit must be between 1 and {SERIES_POINTS_MAX}")
    points = newest(narrow(readings, device, metric), limit, max_rows)
    mean = F.avg("value").over(by_time(SERIES).rowsBetween(-9, 0))
    value = F.col("value").cast("double").alias("value")
    return points.select(*SERIES, "sampled_at", value, mean.alias("rolling_mean_10"))


def rounded(rows: DataFrame) -> DataFrame:
    """Values and rolling means as they are shown, to three places."""
    shown = {c: F.round(c, DISPLAYED) for c in ("value", "rolling_mean_10")}
    return rows.withColumns(shown)


def series_tail(readings: DataFrame, limit: int = SERIES_POINTS, **choice) -> DataFrame:
    """`series_points`, oldest first."""
    return rounded(series_points(readings, limit, **choice)).orderBy(*SERIES, "sampled_at")


def series_history(
    readings: DataFrame, device=None, metric: str | None = None, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Every point with its 10-point mean over the whole history.

    Sorted by time when a single device is asked for; a fleet-wide answer is as large
    as the table and is left unsorted.
    """
    rows = rolling_mean(narrow(readings, device, metric), 10, max_rows=max_rows)
    rows = rounded(rows.select(*SERIES, "sampled_at", "value", "rolling_mean_10"))
    return rows if device is None else rows.orderBy("metric", "sampled_at")


def series_band(points: DataFrame) -> DataFrame:
    """Add the display band around the rolling mean, one width per returned series.

    Takes `series_points`: the rows are already grouped by series, so there is no
    further shuffle.
    """
    whole = Window.partitionBy(*SERIES)  # at most SERIES_POINTS_MAX rows
    spread = F.stddev_pop("value").over(whole) * F.lit(BAND_SIGMA)
    floor = F.abs(F.avg("value").over(whole)) * F.lit(BAND_SHARE) + F.lit(BAND_FLOOR)
    return (
        points.withColumn("_width", F.greatest(spread, floor))
        .withColumn("band_low", F.col("rolling_mean_10") - F.col("_width"))
        .withColumn("band_high", F.col("rolling_mean_10") + F.col("_width"))
        .drop("_width")
    )


def reading_gaps(
    readings: DataFrame, longer_than: float = 20.0, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Silences above the limit, longest first."""
    found = gaps(readings, max_rows).filter(F.col("gap_seconds") > F.lit(float(longer_than)))
    return found.select(
        *SERIES, F.col("sampled_at").alias("resumed_at"), F.col("gap_seconds").alias("silent_for")
    ).orderBy(F.col("silent_for").desc(), *SERIES, "resumed_at")


def device_anomalies(anomalies: DataFrame, readings: DataFrame, device=None) -> DataFrame:
    """Anomalies with the time and value of the reading that caused them, newest first.

    Only the readings that were flagged are joined; the large table is reduced by a
    join against the short list of ids instead of being sorted whole. Where readings
    are kept by day, the days in the list prune the folders that are read.
    """
    rows = narrow(anomalies, device)
    key = ["reading_id"]
    flagged = rows.filter(F.col("reading_id").isNotNull())
    if "day" in readings.columns and "reading_day" in rows.columns:
        flagged = flagged.withColumnRenamed("reading_day", "day")
        key.append("day")
    causes = readings.join(flagged.select(*key).distinct(), key).select(
        "reading_id",
        F.col("sampled_at").alias("reading_sampled_at"),
        F.col("value").cast("double").alias("reading_value"),
    )
    joined = rows.join(causes, "reading_id", "left")
    return joined.orderBy(F.col("detected_at").desc(), "device", "type", "metric", "reading_id")


def flagged_readings(anomalies: DataFrame, n: int = FLAGGED) -> DataFrame:
    """The newest `n` anomalies of each device that point at a reading; rank 1 is shown."""
    newest_of = Window.partitionBy("device").orderBy(
        F.col("detected_at").desc(), F.col("reading_id").desc(), "type"
    )
    rows = anomalies.filter(F.col("reading_id").isNotNull())
    return rows.withColumn("rank", F.row_number().over(newest_of)).filter(F.col("rank") <= n)


def markers(device_rows: DataFrame) -> DataFrame:
    """Anomalies that can be drawn: those with a reading time and value."""
    drawable = F.col("reading_sampled_at").isNotNull() & F.col("reading_value").isNotNull()
    return device_rows.filter(drawable)


def genealogy(readings: DataFrame, stages: DataFrame, reading_id=None) -> DataFrame:
    """The stages each reading went through; of one reading, in order."""
    facts = readings.select("reading_id", "device", "metric", "value", "sampled_at")
    if reading_id is None:
        return facts.join(stages, "reading_id")
    chosen = F.col("reading_id") == F.lit(reading_id)
    trail = facts.filter(chosen).join(stages.filter(chosen), "reading_id")
    return trail.orderBy("at", stage_position(F.col("stage")))


def stage_position(stage):
    """Place of a stage in the trail, for stages stamped at the same instant."""
    order = F.array(*[F.lit(s) for s in ("ingested", "validated", "enriched", "evaluated")])
    return F.array_position(order, stage)


def pareto(anomalies: DataFrame) -> DataFrame:
    """Totals, still open and devices affected per type and severity."""
    still_open = F.col("resolved_at").isNull()
    return (
        anomalies.groupBy("type", "severity")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count(F.when(still_open, F.lit(1))).alias("still_open"),
            F.count_distinct("device").alias("devices_affected"),
        )
        .orderBy(F.col("total").desc(), "type", "severity")
    )


def pareto_pivot(counts: DataFrame) -> DataFrame:
    """One row per type with a column per severity, largest total first."""
    wide = counts.groupBy("type").pivot("severity", list(SEVERITIES)).agg(F.sum("total"))
    filled = wide.fillna(0, subset=list(SEVERITIES))
    total = sum((F.col(name) for name in SEVERITIES), F.lit(0))
    return filled.orderBy(total.desc(), "type")


def recent_anomalies(anomalies: DataFrame, limit: int = RECENT) -> DataFrame:
    """The newest anomalies of the fleet; only `limit` rows leave each task."""
    if not 1 <= limit <= RECENT_MAX:
        raise ValueError(f"limit must be between 1 and {RECENT_MAX}")
    ties = [name for name in ("device", "type", "metric", "reading_id") if name in anomalies.columns]
    return anomalies.orderBy(F.col("detected_at").desc(), *ties).limit(limit)


def anomaly_table(anomalies: DataFrame) -> DataFrame:
    return anomalies.select("detected_at", "type", "severity", "device", "detail").orderBy(
        F.col("detected_at").desc(), "device", "type"
    )


def with_detail_fields(anomalies: DataFrame) -> DataFrame:
    """The JSON `detail` as typed columns; null where a rule has no such field."""
    parsed = anomalies.withColumn("_d", F.from_json("detail", DETAIL_FIELDS))
    names = ("value", "mean", "sigma", "recent_mean", "baseline", "gap_seconds")
    fields = [F.col(f"_d.{name}").alias(name) for name in names]
    ends = [F.get("_d.range", F.lit(i)).alias(name) for i, name in enumerate(("lo", "hi"))]
    return parsed.select(*anomalies.columns, *fields, *ends)


def with_variant_detail(anomalies: DataFrame) -> DataFrame:
    """`detail` as a VARIANT: parsed once, read by path, whatever fields a rule writes.

    A null detail stays null; text that is no JSON becomes null as well.
    """
    return anomalies.withColumn("detail", F.try_parse_json("detail"))


def detail_field(path: str, kind: str = "double"):
    """A field inside a VARIANT `detail`; null where it is not there or not of the kind."""
    return F.try_variant_get("detail", path, kind)


def anomaly_table_typed(anomalies: DataFrame) -> DataFrame:
    """The anomaly table with its detail as columns, newest first."""
    fields = [detail_field(f"$.{name}").alias(name) for name in ("value", "mean", "sigma", "recent_mean", "baseline", "gap_seconds")]
    ends = [detail_field(f"$.range[{i}]").alias(name) for i, name in enumerate(("lo", "hi"))]
    rows = with_variant_detail(anomalies).select("detected_at", "type", "severity", "device", "metric", *fields, *ends)
    return rows.orderBy(F.col("detected_at").desc(), "device", "type")


def range_by_metric(readings: DataFrame, start, end) -> DataFrame:
    """Count and average per metric over an inclusive time range."""
    return (
        between(readings, start, end)
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"))
    )


def metric_range(readings: DataFrame, devices: DataFrame, metric: str, start, end) -> DataFrame:
    """Readings of one metric over a time range, labelled by device."""
    rows = narrow(between(readings, start, end), metric=metric)
    label = "name" if "name" in devices.columns else "device"
    names = devices.select("device", F.col(label).alias("label"))
    return rows.join(names, "device").select("sampled_at", "device", "label", "value").orderBy(
        "sampled_at", "device"
    )


def hourly_since(readings: DataFrame, since) -> DataFrame:
    """The hourly rollup computed on the fly from the usable readings since a moment."""
    rows = evaluable(readings).filter(F.col("sampled_at") >= timestamp_at(since))
    return hourly(rows).drop("sum_value")


def stored_hourly_since(rollup: DataFrame, since) -> DataFrame:
    """The same answer read from the stored rollup; whole hours only."""
    since = timestamp_at(since)
    rows = rollup.filter(F.col("hour") >= since)
    if "day" in rows.columns:
        rows = rows.filter(F.col("day") >= F.to_date(since)).drop("day")
    return rows.drop("sum_value")


def evaluation_view(
    readings: DataFrame,
    stages: DataFrame,
    spike_window: int = 20,
    since=None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Window statistics and whether each reading was evaluated; optionally bounded."""
    rows = readings if since is None else readings.filter(F.col("sampled_at") >= timestamp_at(since))
    marked = mark_evaluated(rolling_stats(rows, spike_window, max_rows), stages)
    return marked.select(*SERIES, "reading_id", "value", "mean", "std", "evaluated", "sampled_at")


def totals(readings: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Number of readings and of open anomalies as (name, value) rows."""
    count = F.count(F.lit(1)).alias("value")
    counted = readings.agg(count).select(F.lit("readings").alias("name"), "value")
    still_open = anomalies.filter(F.col("resolved_at").isNull()).agg(count)
    return counted.unionByName(still_open.select(F.lit("open_anomalies").alias("name"), "value"))
