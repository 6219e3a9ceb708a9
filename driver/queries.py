"""Every operator and read query, run over the whole generated tables.

Events are readings (user = device, type = metric) and customers are devices. Doubles
are rounded to six places and timestamps are returned without a zone, so results
compare exactly with another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, TimestampType

from fleetlens.config import Limits, Settings
from fleetlens.operators import detect, ingest, rollup, series, sketches
from fleetlens.plans import fleet as fleets
from fleetlens.plans import investigate, quality
from fleetlens.session import ensure_checkpoint_dir
from fleetlens.sources import wire
from fleetlens.sources.store import Store
from fleetlens.sources.tables import GENERATED, customers_as_devices, events_as_readings, table
from fleetlens.streaming import queries as streams
from fleetlens.sources.buckets import save_bucketed
from fleetlens.streaming import stateful
from fleetlens.streaming.ingest import ingest_batch
from fleetlens.streaming.queries import start_ingest
from fleetlens.streaming.rollup import read_rollup, refresh_rollup
from fleetlens.streaming.sweep import sweep

Query = Callable[[SparkSession, str], DataFrame]

# The parameters all queries below share with their SQL twins.
METRICS = ("click", "error", "purchase", "signup")  # "view" has no limits
SETTINGS = Settings(
    spike_window=6,
    drift_window=5,
    gap_lookback=8,
    gap_seconds=240 * 3600,
    limits=tuple(Limits(m, 0.05, 300.0, 50.0, 2.0, 25.0) for m in METRICS),
)
AS_OF = "2024-01-31 00:00:00"
RANGE = ("2024-01-10 00:00:00", "2024-01-11 00:00:00")
WEEK_START = "2024-01-24 00:00:00"
CHECKPOINT = "2024-01-25 00:00:00"
MID_HOUR = "2024-01-15 12:30:00"
SLICE_ROWS = 10  # so few that most series are cut
ONLINE, STALE = 6 * 3600.0, 48 * 3600.0
LONG_SILENCE = 24 * 3600.0
POINTS = 8
PARTITIONS = 4
DELIVERED_AT = (datetime(2024, 1, 20, 12, 0, 30, tzinfo=UTC), datetime(2024, 2, 1, 8, 15, tzinfo=UTC))
DELIVERIES = ("2024-01-15 00:00:00", "2024-01-20 00:00:00")

_REGISTRY: dict[str, Query] = {}


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def query(function: Query) -> Query:
    """Register a query under its function name and normalise its result columns."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(function(spark, folder))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    _REGISTRY[function.__name__] = run
    return function


def comparable(rows: DataFrame) -> DataFrame:
    columns = []
    for field in rows.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return rows.select(*columns)


readings = events_as_readings
devices = customers_as_devices


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.heartbeats(readings(spark, folder), order="reading_id")


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    return detect.evaluate_points(readings(spark, folder), SETTINGS)


def condition(spark: SparkSession, folder: str) -> DataFrame:
    return detect.series_condition(readings(spark, folder), SETTINGS)


def guarded(spark: SparkSession, folder: str) -> DataFrame:
    found = detect.window_anomalies(condition(spark, folder), SETTINGS, AS_OF)
    return detect.guard(found)


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """All four rules; a point finding is dated by its reading, a window one by the sweep."""
    rows = readings(spark, folder)
    most = series.rows_to_check(rows, series.MAX_ROWS)
    points = detect.point_anomalies(detect.evaluate_points(rows, SETTINGS, most))
    state = detect.series_condition(rows, SETTINGS, most)
    windows = detect.guard(detect.window_anomalies(state, SETTINGS, AS_OF))
    found = points.unionByName(windows.withColumn("reading_id", F.col("reading_id").cast("long")))
    settled = F.col("detected_at") + F.expr("INTERVAL 1 HOUR")
    return found.withColumn("resolved_at", F.when(F.col("reading_id") % 3 == 0, settled))


def stages(spark: SparkSession, folder: str) -> DataFrame:
    """The full trail: ingest stages dated by the reading, evaluation by the sweep."""
    arrived = ingest.with_validation(
        readings(spark, folder)
        .withColumn("unit", F.lit("u"))
        .withColumn("source_offset", F.col("reading_id"))
    )
    first = ingest.ingest_stages(arrived, F.col("sampled_at"))
    return first.unionByName(detect.evaluation_stages(evaluated(spark, folder), AS_OF))


# ---- windows and detection ----


@query
def enrich_stats(spark, folder):
    rows = series.rolling_stats(readings(spark, folder), SETTINGS.spike_window)
    return rows.select("reading_id", "mean", "std")


@query
def enrich_stats_sliced(spark, folder):
    """The same with nearly every series cut into time slices."""
    rows = series.rolling_stats(readings(spark, folder), SETTINGS.spike_window, SLICE_ROWS)
    return rows.select("reading_id", "mean", "std")


@query
def evaluate_points(spark, folder):
    rows = evaluated(spark, folder)
    return rows.select(
        "reading_id", "device", "metric", "value", F.coalesce("finding", F.lit("ok")).alias("finding")
    )


@query
def drift_raw(spark, folder):
    rows = detect.drift_candidates(condition(spark, folder))
    return rows.select("device", "metric", "recent_mean", "baseline")


@query
def gap_raw(spark, folder):
    rows = detect.gap_candidates(condition(spark, folder), SETTINGS)
    return rows.select("device", "metric", "max_gap_seconds")


@query
def drift_guarded(spark, folder):
    rows = guarded(spark, folder).filter(F.col("type") == detect.DRIFT)
    return rows.select("device", "metric", "type", "severity")


@query
def gap_guarded(spark, folder):
    rows = guarded(spark, folder).filter(F.col("type") == detect.OFFLINE_GAP)
    return rows.select("device", "metric", "type", "severity")


@query
def anomalies_all(spark, folder):
    return anomalies(spark, folder).select(
        "device", "metric", "reading_id", "type", "severity", "detected_at"
    )


@query
def unevaluated(spark, folder):
    """Readings left for the next sweep after one that ran at the checkpoint."""
    rows = readings(spark, folder)
    done = rows.filter(F.col("sampled_at") <= F.lit(CHECKPOINT).cast("timestamp"))
    trail = detect.evaluation_stages(detect.evaluate_points(done, SETTINGS), CHECKPOINT)
    return detect.unevaluated(rows, trail).select("reading_id", "device", "metric")


@query
def bounded_eval(spark, folder):
    """Incremental evaluation: readings after the checkpoint, from their anchors on."""
    moment = F.lit(CHECKPOINT).cast("timestamp")
    rows = detect.judgeable(readings(spark, folder), SETTINGS)
    fresh = rows.filter(F.col("sampled_at") > moment)
    before = rows.filter(F.col("sampled_at") <= moment)
    tail = series.newest(before, SETTINGS.spike_window).drop("rank")
    stats = series.rolling_stats(tail.unionByName(fresh), SETTINGS.spike_window)
    judged = detect.judge(detect.with_limits(stats.filter(F.col("sampled_at") > moment), SETTINGS))
    return judged.select(
        "reading_id", "mean", "std", F.coalesce("finding", F.lit("ok")).alias("finding")
    )


@query
def evaluation_view(spark, folder):
    rows = readings(spark, folder)
    done = rows.filter(F.col("sampled_at") <= F.lit(CHECKPOINT).cast("timestamp"))
    trail = detect.evaluation_stages(detect.evaluate_points(done, SETTINGS), CHECKPOINT)
    view = investigate.evaluation_view(rows, trail, SETTINGS.spike_window)
    return view.select("reading_id", "value", "mean", "std", "evaluated")


@query
def evaluation_view_since(spark, folder):
    rows = readings(spark, folder)
    done = rows.filter(F.col("sampled_at") <= F.lit(CHECKPOINT).cast("timestamp"))
    trail = detect.evaluation_stages(detect.evaluate_points(done, SETTINGS), CHECKPOINT)
    view = investigate.evaluation_view(rows, trail, SETTINGS.spike_window, since=WEEK_START)
    return view.select("reading_id", "value", "mean", "std", "evaluated")


@query
def eval_checkpoint(spark, folder):
    rows = ingest.series_checkpoints(readings(spark, folder), AS_OF)
    return rows.select("device", "metric", "last_sampled_at")


@query
def window_anchor(spark, folder):
    """Anchor five readings before the checkpoint of each series."""
    rows = readings(spark, folder)
    done = rows.filter(F.col("sampled_at") <= F.lit(CHECKPOINT).cast("timestamp"))
    return series.anchors(rows, ingest.series_checkpoints(done, AS_OF), 5)


# ---- fleet ----


@query
def device_list(spark, folder):
    rows = fleets.device_list(
        devices(spark, folder), readings(spark, folder), heartbeats(spark, folder)
    )
    return rows.withColumn("metrics", F.array_join("metrics", ","))


def fleet_rows(spark, folder):
    return fleets.fleet(
        devices(spark, folder),
        readings(spark, folder),
        heartbeats(spark, folder),
        anomalies(spark, folder),
        AS_OF,
        ONLINE,
        STALE,
    )


@query
def fleet(spark, folder):
    return fleet_rows(spark, folder)


@query
def fleet_overview(spark, folder):
    return fleets.fleet_overview(
        devices(spark, folder),
        readings(spark, folder),
        heartbeats(spark, folder),
        anomalies(spark, folder),
    )


@query
def fleet_groups(spark, folder):
    return fleets.fleet_groups(fleet_rows(spark, folder))


@query
def fleet_groups_by_kind(spark, folder):
    return fleets.fleet_groups(fleet_rows(spark, folder), by="kind")


@query
def fleet_groups_of_location(spark, folder):
    """The location filter of the fleet view, grouped by kind."""
    rows = fleets.filter_fleet(fleet_rows(spark, folder), location="NATION_3")
    return fleets.fleet_groups(rows, by="kind")


@query
def fleet_totals(spark, folder):
    return fleets.fleet_totals(fleet_rows(spark, folder))


@query
def default_metric(spark, folder):
    return fleets.default_metric(readings(spark, folder))


@query
def freshness(spark, folder):
    return fleets.staleness(devices(spark, folder), heartbeats(spark, folder), AS_OF)


@query
def freshness_all_devices(spark, folder):
    return fleets.staleness(
        devices(spark, folder), heartbeats(spark, folder), AS_OF, include_unseen=True
    )


# ---- investigation ----


@query
def reading_gaps(spark, folder):
    return investigate.reading_gaps(readings(spark, folder), LONG_SILENCE)


@query
def reading_gaps_sliced(spark, folder):
    return investigate.reading_gaps(readings(spark, folder), LONG_SILENCE, max_rows=SLICE_ROWS)


def shown(rows: DataFrame) -> DataFrame:
    """Points with what is displayed of them; null within a hair of a half step, where
    engines may round either way."""
    named = {"raw_value": F.col("value"), "raw_mean": F.col("rolling_mean_10")}
    rows = investigate.rounded(rows.withColumns(named))

    def clear(raw: str, name: str):
        off = F.abs(F.col(raw) * 1000 - F.floor(F.col(raw) * 1000) - 0.5)
        return F.when(off > 1e-4, F.col(name))

    return rows.select(
        "device", "metric", "sampled_at", F.col("raw_value").alias("value"),
        F.col("raw_mean").alias("rolling_mean_10"),
        clear("raw_value", "value").alias("shown_value"),
        clear("raw_mean", "rolling_mean_10").alias("shown_mean"),
    )


@query
def series_tail(spark, folder):
    return shown(investigate.series_points(readings(spark, folder), POINTS))


@query
def series_tail_sliced(spark, folder):
    return shown(investigate.series_points(readings(spark, folder), POINTS, max_rows=SLICE_ROWS))


@query
def rolling_full(spark, folder):
    """`series_history` with what it rounds next to it."""
    return shown(series.rolling_mean(readings(spark, folder), 10))


@query
def rolling_full_sliced(spark, folder):
    return shown(series.rolling_mean(readings(spark, folder), 10, max_rows=SLICE_ROWS))


@query
def series_band(spark, folder):
    return investigate.series_band(investigate.series_points(readings(spark, folder), POINTS))


def anomaly_rows(spark, folder):
    """The found anomalies are few and used twice, so they are written down once."""
    ensure_checkpoint_dir(spark)
    found = anomalies(spark, folder).checkpoint()
    return investigate.device_anomalies(found, readings(spark, folder))


@query
def device_anomalies(spark, folder):
    return anomaly_rows(spark, folder).select(
        "device", "metric", "reading_id", "type", "severity", "detected_at",
        "reading_sampled_at", "reading_value",
    )


@query
def anomaly_markers(spark, folder):
    rows = investigate.markers(anomaly_rows(spark, folder))
    return rows.select("device", "type", "severity", "reading_sampled_at", "reading_value")


@query
def flagged_readings(spark, folder):
    rows = investigate.flagged_readings(anomalies(spark, folder))
    return rows.select("device", "reading_id", "type", "rank")


@query
def genealogy(spark, folder):
    rows = investigate.genealogy(readings(spark, folder), stages(spark, folder))
    return rows.select("reading_id", "device", "metric", "value", "sampled_at", "stage", "status", "at")


GENEALOGY_BUCKETS = 8
ONE_READING = 42


def bucketed_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readings and stages stored in buckets of the reading id."""
    place, name = scratch(spark), uuid4().hex
    facts = {"readings": readings(spark, folder), "stages": stages(spark, folder)}
    saved = [
        save_bucketed(rows, f"{kind}_{name}", f"{place}/{kind}", "reading_id", GENEALOGY_BUCKETS)
        for kind, rows in facts.items()
    ]
    return saved[0], saved[1]


@query
def genealogy_bucketed(spark, folder):
    """The same from bucketed tables, joined bucket by bucket."""
    rows = investigate.genealogy(*bucketed_facts(spark, folder))
    return rows.select("reading_id", "device", "metric", "value", "sampled_at", "stage", "status", "at")


@query
def genealogy_of_reading(spark, folder):
    """The trail of one reading; one bucket of each table is read."""
    rows = investigate.genealogy(*bucketed_facts(spark, folder), reading_id=ONE_READING)
    return rows.select("reading_id", "device", "metric", "value", "sampled_at", "stage", "status", "at")


@query
def pareto(spark, folder):
    seen = fleets.seen_only(anomalies(spark, folder), heartbeats(spark, folder))
    return investigate.pareto(seen)


@query
def pareto_all_devices(spark, folder):
    return investigate.pareto(anomalies(spark, folder))


@query
def pareto_pivot(spark, folder):
    return investigate.pareto_pivot(investigate.pareto(anomalies(spark, folder)))


@query
def recent_anomalies(spark, folder):
    seen = fleets.seen_only(anomalies(spark, folder), heartbeats(spark, folder))
    rows = investigate.recent_anomalies(seen, 50)
    return rows.select("device", "metric", "type", "severity", "detected_at", "resolved_at")


@query
def anomaly_table(spark, folder):
    rows = investigate.anomaly_table(anomalies(spark, folder))
    return rows.drop("detail")


@query
def anomaly_details(spark, folder):
    """The fields inside `detail`; rounded ones are held against the exact number."""
    rows = investigate.with_detail_fields(anomalies(spark, folder))
    means = evaluated(spark, folder).select("reading_id", F.col("mean").alias("_mean"))
    tails = condition(spark, folder).select(
        "device", "metric", F.col("recent_mean").alias("_recent"), F.col("max_gap_seconds").alias("_gap")
    )
    joined = rows.join(means, "reading_id", "left").join(tails, ["device", "metric"], "left")

    def close(shown: str, exact: str, step: float):
        return (F.abs(F.col(shown) - F.col(exact)) <= step * 0.5001).alias(f"{shown}_close")

    return joined.select(
        "device", "metric", "reading_id", "type", "value", "sigma", "lo", "hi", "baseline",
        close("mean", "_mean", 0.001), close("recent_mean", "_recent", 0.001),
        close("gap_seconds", "_gap", 0.1),
    )


@query
def anomaly_table_typed(spark, folder):
    """The table with what the detail holds, but for means, which are shown rounded."""
    return investigate.anomaly_table_typed(anomalies(spark, folder)).drop("mean", "recent_mean", "gap_seconds")


@query
def range_by_metric(spark, folder):
    return investigate.range_by_metric(readings(spark, folder, *RANGE), *RANGE)


@query
def latest_per_series(spark, folder):
    rows = series.latest_per_series(readings(spark, folder), ("value", "reading_id"))
    return rows.select("device", "metric", "value", "sampled_at", "reading_id")


@query
def latest_per_device(spark, folder):
    return series.latest_per_device(readings(spark, folder))


@query
def hourly_rollup(spark, folder):
    return investigate.hourly_since(readings(spark, folder, WEEK_START), WEEK_START)


@query
def hourly_merged(spark, folder):
    """The rollup put together from two batches that meet in the middle of an hour."""
    rows = readings(spark, folder)
    early = F.col("sampled_at") <= F.lit(MID_HOUR).cast("timestamp")
    parts = rollup.hourly(rows.filter(early)).unionByName(rollup.hourly(rows.filter(~early)))
    return rollup.merge_hourly(parts).drop("sum_value")


@query
def metric_range(spark, folder):
    names = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("device"), F.col("c_name").alias("name")
    )
    return investigate.metric_range(readings(spark, folder, *RANGE), names, "error", *RANGE)


@query
def totals(spark, folder):
    return investigate.totals(readings(spark, folder), anomalies(spark, folder))


# ---- ingest ----


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return as_messages(table(spark, folder, "events"))


def as_messages(rows: DataFrame) -> DataFrame:
    """Events as wire fields; some lack a unit, an optional field or a finite value."""
    k = F.get_json_object("props", "$.k").cast("int")
    finite = F.when(k == 13, F.lit(float("nan"))).otherwise(F.col("value"))
    return rows.select(
        F.col("user_id").cast("string").alias("device_external_id"),
        F.concat(F.lit("kind-"), "event_type").alias("device_kind"),
        F.col("event_type").alias("metric"),
        finite.alias("value"),
        F.when(k % 10 == 0, "").otherwise("u").alias("unit"),
        wire.iso_time(F.col("ts").cast("timestamp")).alias("sampled_at"),
        F.when(k < 50, F.concat(F.lit("rack-"), k.cast("string"))).alias("location"),
        F.when(k >= 90, F.concat(F.lit("1."), k.cast("string"))).alias("firmware"),
        F.pmod("user_id", F.lit(PARTITIONS)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )


def received(spark: SparkSession, folder: str) -> DataFrame:
    """Every event sent over the wire as JSON and decoded again."""
    return wire.decode(wire.encode(messages(spark, folder)))


@query
def wire_roundtrip(spark, folder):
    rows = received(spark, folder)
    return rows.select(
        "device", "kind", "metric", F.when(~F.isnan("value"), F.col("value")).alias("value"),
        "unit", "sampled_at", "location", "firmware", "source_topic", "source_partition",
        "source_offset", "quarantine_reason",
    )


@query
def validation(spark, folder):
    rows = ingest.with_validation(received(spark, folder))
    return rows.select("source_offset", F.coalesce("reject_reason", F.lit("ok")).alias("reason"))


@query
def ingest_trail(spark, folder):
    rows = ingest.with_validation(received(spark, folder))
    trail = ingest.ingest_stages(rows.withColumnRenamed("source_offset", "reading_id").withColumn(
        "source_offset", F.col("reading_id")), AS_OF)
    return trail.groupBy("stage", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reading_id").alias("id_sum")
    )


@query
def dedup_first(spark, folder):
    """First arrival per device, metric and hour."""
    rows = readings(spark, folder).withColumn("hour", F.date_trunc("hour", F.col("sampled_at")))
    kept = ingest.first_arrivals(rows, ("device", "metric", "hour"), ("reading_id",))
    return kept.select("reading_id", "device", "metric", "hour", "value")


@query
def unseen_keys(spark, folder):
    """Readings after the checkpoint whose device, metric and hour of day are new."""
    moment = F.lit(CHECKPOINT).cast("timestamp")
    rows = readings(spark, folder).withColumn("hour", F.hour("sampled_at"))
    stored = rows.filter(F.col("sampled_at") <= moment)
    fresh = rows.filter(F.col("sampled_at") > moment)
    key = ("device", "metric", "hour")
    kept = ingest.first_arrivals(ingest.unseen(fresh, stored, key), key, ("reading_id",))
    return kept.select("reading_id", "device", "metric", "hour")


@query
def device_upsert(spark, folder):
    """Devices known at the checkpoint, updated by the messages after it."""
    rows = received(spark, folder)
    moment = F.lit(CHECKPOINT).cast("timestamp")
    old = ingest.newest_device_attributes(rows.filter(F.col("sampled_at") <= moment))
    new = ingest.newest_device_attributes(rows.filter(F.col("sampled_at") > moment))
    return ingest.upsert_devices(old, new)


@query
def heartbeat(spark, folder):
    return heartbeats(spark, folder)


@query
def ingest_checkpoint(spark, folder):
    rows = ingest.consumer_offsets(wire.encode(messages(spark, folder)), AS_OF)
    return fleets.consumers(rows)


def lags(spark, folder) -> DataFrame:
    raw = wire.encode(messages(spark, folder).withColumn("_at", F.to_timestamp("sampled_at")))
    done = raw.filter(F.col("_at") <= F.lit(CHECKPOINT).cast("timestamp"))
    ends = raw.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    return quality.consumer_lag(ingest.consumer_offsets(done, AS_OF), ends)


@query
def consumer_lag(spark, folder):
    """Lag of a consumer that stopped at the checkpoint."""
    return lags(spark, folder)


@query
def total_consumer_lag(spark, folder):
    return quality.total_lag(lags(spark, folder))


@query
def ingested_by_device(spark, folder):
    return ingest.ingested_by_device(ingest.with_validation(received(spark, folder)))


# ---- pipeline quality ----


def lagged(spark: SparkSession, folder: str) -> DataFrame:
    """Readings arriving k - 5 seconds (k from the event's properties) after sampling."""
    k = F.get_json_object("props", "$.k").cast("int")
    sampled = F.col("ts").cast("timestamp")
    arrival = F.timestamp_micros(F.unix_micros(sampled) + (k - 5) * 1_000_000)
    return table(spark, folder, "events").select(
        F.col("event_type").alias("metric"),
        sampled.alias("sampled_at"),
        arrival.alias("ingested_at"),
    )


def extent(rows: DataFrame, time) -> tuple[str, str]:
    """The first and the last moment of a table."""
    ends = rows.agg(F.min(time).cast("string").alias("a"), F.max(time).cast("string").alias("b")).first()
    return ends.a, ends.b


@query
def event_rate(spark, folder):
    return quality.event_rate(readings(spark, folder), "sampled_at", 1)


@query
def anomaly_rate(spark, folder):
    return quality.event_rate(anomalies(spark, folder), "detected_at", 5, ("type",))


@query
def lag_buckets(spark, folder):
    return quality.lag_buckets(quality.with_lag(lagged(spark, folder)), ("metric",))


@query
def gap_histogram(spark, folder):
    """The same buckets over the hours between readings, as one fleet-wide row."""
    hours = series.gaps(readings(spark, folder)).withColumn("lag_seconds", F.col("gap_seconds") / 3600)
    return quality.lag_buckets(hours)


@query
def devices_by_day(spark, folder):
    """Distinct devices by metric and day from hourly sketches, held against the exact number."""
    rows = readings(spark, folder)
    day = F.to_date("hour").alias("day")
    found = sketches.distinct_devices(sketches.hourly_devices(rows), by=("metric", day))
    exact = rows.groupBy("metric", F.to_date("sampled_at").alias("day")).agg(F.count_distinct("device").alias("exact"))
    close = F.abs(F.col("devices") - F.col("exact")) <= F.ceil(0.04 * F.col("exact"))
    return found.join(exact, ["metric", "day"]).select("metric", "day", "n", "exact", close.alias("close"))


@query
def lag_quantiles(spark, folder):
    """Quantiles of raw lags by metric and day, merged from sketches of minutes; their rank
    among the raw lags is within two in a hundred of what was asked for."""
    rows = quality.with_lag(lagged(spark, folder)).withColumn("window_start", F.date_trunc("day", F.col("ingested_at")))
    found = sketches.lag_quantiles(sketches.lag_sketches(rows, ("metric",)), "1 day", ("metric",))
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        found = sketches.rank_bounds(rows, found, name, ("window_start", "metric"))
        fits = (F.col(f"{name}_below") <= q + 0.02) & (F.col(f"{name}_upto") >= q - 0.02)
        found = found.withColumn(f"{name}_close", fits)
    return found.select("window_start", "metric", "n", "p50_close", "p95_close")


@query
def missing_hours(spark, folder):
    rows = readings(spark, folder)
    hour = F.date_trunc("hour", F.col("sampled_at"))
    return rollup.missing_hours(rows, heartbeats(spark, folder), *extent(rows, hour))


@query
def alerts(spark, folder):
    """Minutes at which the pipeline would have alerted, from its first arrival to its last."""
    rows = quality.with_lag(lagged(spark, folder))
    behind = quality.behind_minutes(quality.in_flight(rows), limit=1)
    minute = F.date_trunc("minute", F.col("ingested_at"))
    return quality.alerts(
        quality.stalled_minutes(rows, *extent(rows, minute)), quality.slow_minutes(rows), behind
    )


# ---- the store: batches, replays, incremental sweeps, streams ----


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/fleetlens-{uuid4().hex}"


def delivered(spark: SparkSession, folder: str) -> list[DataFrame]:
    """All messages in two deliveries; the second repeats five days of the first."""
    rows, at = table(spark, folder, "events"), F.col("ts")  # the stored column, so scans skip
    first, second = (F.lit(text).cast("timestamp_ntz") for text in DELIVERIES)
    return [wire.encode(as_messages(part)) for part in (rows.filter(at <= second), rows.filter(at > first))]


_STORES: dict[tuple[str, str], Store] = {}


def filled_store(spark: SparkSession, folder: str) -> Store:
    """A store after both deliveries, each followed by a sweep and a rollup refresh.

    Filled once per session and table folder, then read by the queries below.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        store = Store(spark, scratch(spark))
        for number, raw in enumerate(delivered(spark, folder)):
            ingest_batch(store, raw, number, now=DELIVERED_AT[number])
            sweep(store, SETTINGS)
            refresh_rollup(store)
        _STORES[key] = store
    return _STORES[key]


@query
def store_readings(spark, folder):
    """What is stored after deliveries with repetitions."""
    return filled_store(spark, folder).facts("reading").select(
        "device", "metric", "sampled_at", "unit", "source_offset",
        F.when(~F.isnan("value"), F.col("value")).alias("value"),
        F.coalesce("reject_reason", F.lit("ok")).alias("reason"),
    )


@query
def store_devices(spark, folder):
    """Device, heartbeat and series state after deliveries with repetitions."""
    store = filled_store(spark, folder)
    series_of = store.state("series").groupBy("device").agg(
        F.sum("n").alias("readings"), F.max("last_sampled_at").alias("last_sampled_at")
    )
    rows = store.state("device").join(store.state("heartbeat"), "device")
    return rows.join(series_of, "device")


@query
def store_latest(spark, folder):
    """The newest reading per series as kept by ingest."""
    rows = filled_store(spark, folder).latest()
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query
def sweep_findings(spark, folder):
    """Point findings of incremental sweeps, one after each delivery."""
    store = filled_store(spark, folder)
    found = store.facts("anomaly").filter(F.col("reading_id").isNotNull())
    rows = investigate.device_anomalies(found, store.facts("reading"))
    return rows.select("device", "metric", "type", "severity", "reading_sampled_at", "reading_value")


@query
def sweep_trail(spark, folder):
    """Stages written by ingest and sweeps, counted per stage and status."""
    trail = filled_store(spark, folder).stages()
    return trail.groupBy("stage", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("reading_id").alias("readings")
    )


@query
def stored_rollup(spark, folder):
    """The hourly rollup refreshed after each delivery."""
    return read_rollup(filled_store(spark, folder)).drop("sum_value")


@query
def stored_rollup_since(spark, folder):
    """The same since the week's start, where only the days asked for are read."""
    return read_rollup(filled_store(spark, folder), WEEK_START).drop("sum_value")


@query
def hourly_of_store(spark, folder):
    """The rollup on the fly over the stored readings: the same rule, the same rows."""
    readings_of = filled_store(spark, folder).facts("reading")
    return investigate.hourly_since(readings_of, "2024-01-01 00:00:00")


@query
def store_batch_stats(spark, folder):
    """Counts of both deliveries added up; the second repeats what the first has stored."""
    names = ("arrived", "stored", "duplicates", "rejected", "quarantined")
    return filled_store(spark, folder).facts("batch_stats").agg(*[F.sum(n).alias(n) for n in names])


@query
def duplicate_rate(spark, folder):
    """Repeated messages per second at the minutes of the two deliveries."""
    return quality.duplicate_rate(filled_store(spark, folder).facts("batch_stats"))


@query
def store_offsets(spark, folder):
    rows = filled_store(spark, folder).state("offsets")
    return rows.select("consumer", "topic", "partition", "last_offset")


@query
def store_evaluated(spark, folder):
    """The state the sweeps keep per series."""
    rows = filled_store(spark, folder).state("evaluated")
    return rows.select("device", "metric", "last_sampled_at", "n", F.size("tail").alias("kept"))


@query
def batch_equals_sweep(spark, folder):
    """Point findings of one pass over the stored readings, against the sweeps' own twin."""
    found = detect.point_anomalies(
        detect.evaluate_points(filled_store(spark, folder).facts("reading"), SETTINGS)
    )
    return found.select("device", "metric", "type", "severity", "detected_at")


@query
def sweep_late(spark, folder):
    """Findings after a third delivery whose readings are far behind the state.

    Every seventh message is held back until the others are stored and swept, with so
    few rows a slice that a series' history is cut; each is judged in its true window.
    """
    raw = wire.encode(messages(spark, folder))
    late = F.col("offset") % 7 == 0
    store = Store(spark, scratch(spark))
    for number, part in enumerate((raw.filter(~late), raw.filter(late))):
        ingest_batch(store, part, number)
        sweep(store, SETTINGS, max_rows=4 * SLICE_ROWS)
        refresh_rollup(store)
    held = store.stages().filter("stage = 'enriched'").select("reading_id", "detail")
    stored = store.facts("reading")
    judged = detect.evaluate_points(stored, SETTINGS).select("reading_id", F.col("mean").alias("exact"))
    rows = stored.filter(F.col("source_offset") % 7 == 0).join(held, "reading_id").join(judged, "reading_id")
    off = F.abs(F.col("exact") * 1000 - F.floor(F.col("exact") * 1000) - 0.5)
    mean = F.get_json_object("detail", "$.mean").cast("double")
    return rows.select("device", "metric", "sampled_at", F.when(off > 1e-4, mean).alias("shown_mean"))


@query
def stream_stored(spark, folder):
    """The events as a stream of messages through the ingest stream into the store."""
    events = spark.readStream.schema(GENERATED["events"])
    source = events.option("pathGlobFilter", "events.parquet").parquet(folder)
    place = scratch(spark)
    store = Store(spark, f"{place}/store")
    stream = start_ingest(
        wire.encode(as_messages(source)), store, f"{place}/checkpoint", seconds=None
    )
    stream.awaitTermination()
    return store.facts("reading").groupBy("metric", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count("reject_reason").alias("rejected")
    )


def landed(spark: SparkSession, folder: str, place: str, parts: list[DataFrame]) -> None:
    """Raw messages as JSON-lines files, part after part; a device's go to one file of a part."""
    for part in parts:
        rows = part.select("key", "value", "topic", "partition", "offset")
        rows.repartition(2, "key").write.mode("append").json(place)


@query
def stream_rate(spark, folder):
    """Events per second of a stream, complete, however late an event is."""
    events = spark.readStream.schema(GENERATED["events"])
    source = events.option("pathGlobFilter", "events.parquet").parquet(folder)
    rows = source.select(F.col("ts").cast("timestamp").alias("sampled_at"))
    place = scratch(spark)
    stateful.start_rate(rows, "sampled_at", f"{place}/rates", f"{place}/checkpoint", seconds=None).awaitTermination()
    return stateful.read_rate(spark, f"{place}/rates")


def first_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Both deliveries as files, through the stream that drops repeats, stopped and started
    again before the second; its first part is delivered twice."""
    place = scratch(spark)
    early, late = delivered(spark, folder)

    def drain():
        rows = stateful.first_readings(wire.file_stream(spark, f"{place}/in", files_per_batch=1))
        stateful.drained(rows, f"{place}/out", f"{place}/checkpoint").awaitTermination()

    landed(spark, folder, f"{place}/in", [early, early])
    drain()
    landed(spark, folder, f"{place}/in", [late])
    drain()
    return spark.read.parquet(f"{place}/out")


@query
def stream_first_readings(spark, folder):
    """Readings of a stream with repeats in a micro-batch, across them and after a restart."""
    rows = first_readings(spark, folder)
    return rows.select(
        "device", "metric", "sampled_at", "source_offset", F.when(~F.isnan("value"), F.col("value")).alias("value"),
        F.coalesce("reject_reason", F.lit("ok")).alias("reason"),
    )


def streamed_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """All messages in order of time as files, evaluated by a stream that is stopped half way."""
    place = scratch(spark)
    raw = wire.encode(messages(spark, folder).withColumn("_at", F.to_timestamp("sampled_at")))
    first, second = (F.lit(text).cast("timestamp") for text in DELIVERIES)
    at = F.col("_at")
    parts = [raw.filter(at <= first), raw.filter((at > first) & (at <= second)), raw.filter(at > second)]

    def drain():
        rows = ingest.with_validation(wire.decode(wire.file_stream(spark, f"{place}/in", files_per_batch=1)))
        rows = rows.filter("quarantine_reason IS NULL").withColumn("reading_id", F.col("source_offset"))
        stateful.drained(stateful.evaluated(rows, SETTINGS), f"{place}/out", f"{place}/checkpoint").awaitTermination()

    landed(spark, folder, f"{place}/in", parts[:2])
    drain()
    landed(spark, folder, f"{place}/in", parts[2:])
    drain()
    return spark.read.schema(stateful.EVALUATED).parquet(f"{place}/out")


@query
def stream_evaluated(spark, folder):
    """Every reading of the stream with its window and finding."""
    rows = stateful.point_findings(streamed_evaluation(spark, folder), SETTINGS)
    return rows.select("device", "metric", F.col("reading_id").cast("long").alias("source_offset"),
                       "mean", "std", F.coalesce("finding", F.lit("ok")).alias("finding"))


@query
def stream_findings(spark, folder):
    """Anomalies of all four rules from the stream's own state."""
    rows = streamed_evaluation(spark, folder)
    points = detect.point_anomalies(stateful.point_findings(rows, SETTINGS))
    found = points.unionByName(stateful.window_findings(rows, SETTINGS, AS_OF))
    return found.select("device", "metric", F.col("reading_id").cast("long").alias("source_offset"), "type", "severity", "detected_at")
