"""The four detection rules as set operations over all series at once.

Point rules (out of range, spike) judge each reading against its own trailing window,
which includes the reading itself. Window rules (drift, offline gap) judge the newest
readings of a series at the moment of the sweep. Readings that failed validation never
reach a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.config import Settings, limits_frame
from fleetlens.functions.expressions import is_finite, seconds_between, timestamp_at
from fleetlens.operators.series import (
    MAX_ROWS,
    SERIES,
    newest,
    newest_first,
    rolling_stats,
    rows_to_check,
)

# Names in the stage trail and in the anomaly table.
OUT_OF_RANGE, SPIKE, DRIFT, OFFLINE_GAP = "out_of_range", "spike", "drift", "offline_gap"
SEVERITY = {OUT_OF_RANGE: "critical", SPIKE: "warn", DRIFT: "warn", OFFLINE_GAP: "critical"}
INGESTED, VALIDATED, ENRICHED, EVALUATED = "ingested", "validated", "enriched", "evaluated"
OK, WARN, REJECT = "ok", "warn", "reject"


def evaluable(readings: DataFrame) -> DataFrame:
    """Readings that take part in windows, rules and rollups.

    Ordinary numbers only, as one NaN would poison the 20 windows after it, and no
    reading that ingest has rejected, where the rows tell.
    """
    usable = readings.filter(is_finite(F.col("value")))
    if "reject_reason" in readings.columns:
        usable = usable.filter(F.col("reject_reason").isNull())
    return usable


def judgeable(readings: DataFrame, settings: Settings) -> DataFrame:
    """Ordinary numbers of metrics that have limits.

    The limits themselves are attached after the shuffle of the windows, so they do not
    travel with every reading.
    """
    limited = limits_frame(readings.sparkSession, settings.limits).select("metric")
    return evaluable(readings).join(limited, "metric", "left_semi")


def with_limits(readings: DataFrame, settings: Settings) -> DataFrame:
    """Attach the limits of each metric; metrics without limits are not judged."""
    return readings.join(limits_frame(readings.sparkSession, settings.limits), "metric")


def unevaluated(readings: DataFrame, stages: DataFrame) -> DataFrame:
    """Readings that no sweep has judged yet."""
    judged = stages.filter(F.col("stage") == EVALUATED).select("reading_id")
    return readings.join(judged, "reading_id", "left_anti")


def mark_evaluated(readings: DataFrame, stages: DataFrame) -> DataFrame:
    """The same question as a boolean column `evaluated`."""
    judged = (
        stages.filter(F.col("stage") == EVALUATED)
        .select("reading_id")
        .distinct()
        .withColumn("evaluated", F.lit(True))
    )
    joined = readings.join(judged, "reading_id", "left")
    return joined.withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))


def judge(enriched: DataFrame) -> DataFrame:
    """Add `finding`: out_of_range before spike, null when the reading is normal."""
    value, mean, std = F.col("value"), F.col("mean"), F.col("std")
    outside = (value < F.col("lo")) | (value > F.col("hi"))
    jump = (std > 0) & (F.abs(value - mean) > F.col("spike_sigma") * std)
    return enriched.withColumn("finding", F.when(outside, OUT_OF_RANGE).when(jump, SPIKE))


def evaluate_points(
    readings: DataFrame, settings: Settings, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Every reading with its window statistics and finding."""
    max_rows = rows_to_check(readings, max_rows)
    stats = rolling_stats(judgeable(readings, settings), settings.spike_window, max_rows)
    return judge(with_limits(stats, settings))


def severity_of(kind: Column) -> Column:
    """The severity that belongs to an anomaly type."""
    return F.coalesce(*[F.when(kind == name, F.lit(level)) for name, level in SEVERITY.items()])


def point_anomalies(evaluated: DataFrame, detected_at="sampled_at") -> DataFrame:
    """Findings as anomaly rows. `detected_at` is a column name or a moment."""
    finding = F.col("finding")
    spike = finding == SPIKE
    detail = F.when(
        spike,
        F.to_json(
            F.struct("value", F.round("mean", 3).alias("mean"), F.col("spike_sigma").alias("sigma"))
        ),
    ).otherwise(F.to_json(F.struct("value", F.array("lo", "hi").alias("range"))))
    when = F.col(detected_at) if detected_at == "sampled_at" else timestamp_at(detected_at)
    return evaluated.filter(finding.isNotNull()).select(
        "device",
        "metric",
        "reading_id",
        finding.alias("type"),
        severity_of(finding).alias("severity"),
        detail.alias("detail"),
        when.alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.to_date("sampled_at").alias("reading_day"),
    )


def evaluation_stages(evaluated: DataFrame, at) -> DataFrame:
    """The `enriched` and `evaluated` rows of the trail, two per reading, in one pass."""
    window = F.to_json(F.struct(F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std")))
    finding = F.col("finding")
    reason = F.when(finding.isNotNull(), F.to_json(F.struct(finding.alias("reason"))))
    stage = F.inline(
        F.array(
            F.struct(F.lit(ENRICHED).alias("stage"), F.lit(OK).alias("status"), window.alias("detail")),
            F.struct(
                F.lit(EVALUATED).alias("stage"),
                F.when(finding.isNotNull(), WARN).otherwise(OK).alias("status"),
                F.coalesce(reason, F.lit("{}")).alias("detail"),
            ),
        )
    )
    return evaluated.select("reading_id", stage, timestamp_at(at).alias("at"))


def series_condition(
    readings: DataFrame, settings: Settings, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Per series: mean of the newest readings and the largest recent gap in seconds.

    One limited shuffle serves both rules. The gap of the oldest row looked at needs
    its predecessor, hence one row more than the lookback.
    """
    max_rows = rows_to_check(readings, max_rows)
    tail = newest(judgeable(readings, settings), settings.tail_rows, max_rows)
    # the next row of the descending order is the predecessor in time, so ranks and
    # gaps share one sort
    before = F.lead("sampled_at").over(newest_first(SERIES))
    rank = F.col("rank")
    gap = F.when(rank <= settings.gap_lookback, seconds_between(before, "sampled_at"))
    recent = F.when(rank <= settings.drift_window, F.col("value"))
    condition = (
        tail.withColumn("_gap", gap)
        .groupBy(*SERIES)
        .agg(F.avg(recent).alias("recent_mean"), F.max("_gap").alias("max_gap_seconds"))
    )
    return with_limits(condition, settings)


def _drifted() -> Column:
    return F.abs(F.col("recent_mean") - F.col("baseline")) > F.col("drift_delta")


def _silent(settings: Settings) -> Column:
    return F.col("max_gap_seconds") > F.lit(float(settings.gap_seconds))


def drift_candidates(condition: DataFrame) -> DataFrame:
    """Series whose recent mean has left the neighbourhood of the baseline."""
    return condition.filter(_drifted())


def gap_candidates(condition: DataFrame, settings: Settings) -> DataFrame:
    """Series that were silent for longer than allowed and have resumed since."""
    return condition.filter(_silent(settings))


def window_anomalies(condition: DataFrame, settings: Settings, detected_at) -> DataFrame:
    """Drift and gap candidates as anomaly rows, before the guard, in one pass."""
    drift = F.to_json(F.struct(F.round("recent_mean", 3).alias("recent_mean"), "baseline"))
    gap = F.to_json(F.struct(F.round("max_gap_seconds", 1).alias("gap_seconds")))
    rules = ((DRIFT, _drifted(), drift), (OFFLINE_GAP, _silent(settings), gap))
    found = [
        F.when(
            holds,
            F.struct(
                F.lit(kind).alias("type"),
                F.lit(SEVERITY[kind]).alias("severity"),
                detail.alias("detail"),
            ),
        )
        for kind, holds, detail in rules
    ]
    return condition.select(
        "device",
        "metric",
        F.lit(None).cast("string").alias("reading_id"),
        F.inline(F.array_compact(F.array(*found))),
        timestamp_at(detected_at).alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("date").alias("reading_day"),
    )


def guard(candidates: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """At most one open anomaly per device and type.

    Candidates of a device that already has an open anomaly of the type are dropped;
    of several metrics of one device the alphabetically first is reported.
    """
    if anomalies is not None:
        still_open = anomalies.filter(F.col("resolved_at").isNull()).select("device", "type")
        candidates = candidates.join(still_open.distinct(), ["device", "type"], "left_anti")
    rest = [name for name in candidates.columns if name not in ("device", "type")]
    first = F.min_by(F.struct(*rest), "metric").alias("_first")
    return candidates.groupBy("device", "type").agg(first).select("device", "type", "_first.*")
