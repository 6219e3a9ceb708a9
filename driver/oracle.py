"""The SQL twin of each registered query, for another engine on the same tables."""

from __future__ import annotations

CTE = {
    "r": """SELECT event_id AS reading_id, user_id AS device, event_type AS metric, value,
        ts AS sampled_at FROM events""",
    "stats": """SELECT *, avg(value) OVER w AS mean, coalesce(stddev_pop(value) OVER w, 0) AS std
        FROM r WINDOW w AS (PARTITION BY device, metric ORDER BY sampled_at
        ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "judged": """SELECT *, CASE WHEN value < 0.05 OR value > 300 THEN 'out_of_range'
        WHEN std > 0 AND abs(value - mean) > 2.0 * std THEN 'spike' END AS finding FROM stats
        WHERE metric <> 'view'""",
    "tail": """SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY sampled_at DESC) AS rn,
        (epoch_us(sampled_at) - epoch_us(lag(sampled_at) OVER
          (PARTITION BY device, metric ORDER BY sampled_at))) / 1e6 AS gap FROM r""",
    "cond": """SELECT device, metric, avg(value) FILTER (WHERE rn <= 5) AS recent_mean,
        max(gap) FILTER (WHERE rn <= 8) AS max_gap FROM tail
        WHERE metric <> 'view' GROUP BY device, metric""",
    "win": """SELECT device, metric, 'drift' AS type, 'warn' AS severity FROM cond
        WHERE abs(recent_mean - 50) > 25
        UNION ALL SELECT device, metric, 'offline_gap', 'critical' FROM cond WHERE max_gap > 864000""",
    "guarded": """SELECT device, min(metric) AS metric, type, severity FROM win
        GROUP BY device, type, severity""",
    "anom": """SELECT device, metric, reading_id, finding AS type,
        CASE finding WHEN 'spike' THEN 'warn' ELSE 'critical' END AS severity,
        sampled_at AS detected_at,
        CASE WHEN reading_id % 3 = 0 THEN sampled_at + INTERVAL 1 HOUR END AS resolved_at
        FROM judged WHERE finding IS NOT NULL
        UNION ALL SELECT device, metric, NULL, type, severity, TIMESTAMP '2024-01-31 00:00:00', NULL
        FROM guarded""",
    "hb": """SELECT user_id AS device, arg_max(ts, event_id) AS last_seen_at,
        max(event_id) AS last_offset FROM events GROUP BY user_id""",
    "dev": """SELECT c_custkey AS device, c_mktsegment AS kind, n_name AS location
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "lastdev": """SELECT * FROM (SELECT *, row_number() OVER
        (PARTITION BY device ORDER BY sampled_at DESC, metric DESC) AS rn FROM r) WHERE rn = 1""",
    "overview": """SELECT dev.device, kind, location, l.metric, l.value AS last_value,
        l.sampled_at AS last_reading, hb.last_seen_at,
        (SELECT count(*) FROM anom a WHERE a.device = dev.device AND a.resolved_at IS NULL)
          AS open_anomalies
        FROM dev LEFT JOIN hb ON hb.device = dev.device LEFT JOIN lastdev l ON l.device = dev.device""",
    "fleet": """SELECT *, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_seen_at)) / 1e6
        AS staleness_s FROM overview WHERE last_seen_at IS NOT NULL""",
    "status": """SELECT *, CASE WHEN staleness_s <= 21600 THEN 'online'
        WHEN staleness_s <= 172800 THEN 'stale' ELSE 'offline' END AS status FROM fleet""",
    "pts": """SELECT device, metric, sampled_at, value, avg(value) OVER (PARTITION BY device, metric
        ORDER BY sampled_at ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling_mean_10
        FROM tail WHERE rn <= 8""",
    "k": """SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS kk FROM events""",
    "msg": """SELECT CAST(user_id AS VARCHAR) AS device, 'kind-' || event_type AS kind,
        event_type AS metric, CASE WHEN kk = 13 THEN NULL ELSE value END AS value,
        CASE WHEN kk % 10 = 0 THEN '' ELSE 'u' END AS unit, ts AS sampled_at,
        CASE WHEN kk < 50 THEN 'rack-' || kk END AS location,
        CASE WHEN kk >= 90 THEN '1.' || kk END AS firmware,
        'telemetry.readings' AS source_topic, CAST(user_id % 4 AS INTEGER) AS source_partition,
        event_id AS source_offset FROM k""",
    "valid": "SELECT * FROM msg WHERE value IS NOT NULL AND unit <> ''",
    "vstats": """SELECT *, avg(value) OVER w AS mean, coalesce(stddev_pop(value) OVER w, 0) AS std
        FROM valid WINDOW w AS (PARTITION BY device, metric ORDER BY sampled_at
        ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "vjudged": """SELECT *, CASE WHEN value < 0.05 OR value > 300 THEN 'out_of_range'
        WHEN std > 0 AND abs(value - mean) > 2.0 * std THEN 'spike' END AS finding FROM vstats
        WHERE metric <> 'view'""",
    "vtail": """SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY sampled_at DESC) AS rn,
        (epoch_us(sampled_at) - epoch_us(lag(sampled_at) OVER
          (PARTITION BY device, metric ORDER BY sampled_at))) / 1e6 AS gap FROM valid""",
    "vwin": """SELECT * FROM (SELECT device, metric,
          unnest([CASE WHEN abs(avg(value) FILTER (WHERE rn <= 5) - 50) > 25 THEN 'drift' END,
                  CASE WHEN max(gap) FILTER (WHERE rn <= 8) > 864000 THEN 'offline_gap' END]) AS type,
          unnest(['warn', 'critical']) AS severity
        FROM vtail WHERE metric <> 'view' GROUP BY device, metric) WHERE type IS NOT NULL""",
    "lags": """SELECT event_type AS metric, ts AS sampled_at, greatest(0, kk - 5) AS lag,
        ts + to_seconds(kk - 5) AS ingested_at FROM k""",
    "hourly": """SELECT device, metric, date_trunc('hour', sampled_at) AS hour,
        avg(value) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n
        FROM r GROUP BY 1, 2, 3""",
}

# What each fragment builds on.
NEEDS = {
    "stats": ["r"], "judged": ["stats"], "tail": ["r"], "cond": ["tail"], "win": ["cond"],
    "guarded": ["win"], "anom": ["judged", "guarded"], "lastdev": ["r"],
    "overview": ["dev", "hb", "lastdev", "anom"], "fleet": ["overview"], "status": ["fleet"],
    "pts": ["tail"], "msg": ["k"], "valid": ["msg"], "vstats": ["valid"], "vjudged": ["vstats"], "vtail": ["valid"], "vwin": ["vtail"], "lags": ["k"], "hourly": ["r"],
}

BOUNDS = (0.5, 1, 2, 5, 10, 30, 60, 120, 300)


def _name(bound: float) -> str:
    return "le_" + f"{bound:g}".replace(".", "_")


def _quantile(q: float) -> str:
    cases, lower, below = [], "0.0", "0"
    for bound in BOUNDS:
        here = _name(bound)
        cases.append(
            f"WHEN {here} >= {q} * n THEN {lower} + ({bound} - {lower}) * ({q} * n - {below}) "
            f"/ nullif({here} - {below}, 0)"
        )
        lower, below = str(float(bound)), here
    return f"CASE WHEN n = 0 THEN NULL {' '.join(cases)} ELSE 300.0 END"


def _buckets(lag: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {lag} <= {b}) AS {_name(b)}" for b in BOUNDS)


def _shown(column: str, name: str) -> str:
    """Three places, null within a hair of a half step."""
    off = f"abs({column} * 1000 - floor({column} * 1000) - 0.5)"
    return f"CASE WHEN {off} > 1e-4 THEN round({column}, 3) END AS {name}"


def _sql(body: str, *fragments: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in fragments:
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({CTE[name]})" for name in order) + "\n" + body


_BUCKET_NAMES = ", ".join(_name(b) for b in BOUNDS)
_STATS_COLUMNS = "round(mean, 6) AS mean, round(std, 6) AS std"


def statements() -> dict[str, str]:
    out = {
        "enrich_stats": _sql(f"SELECT reading_id, {_STATS_COLUMNS} FROM stats", "stats"),
        "evaluate_points": _sql(
            "SELECT reading_id, device, metric, round(value, 6) AS value, "
            "coalesce(finding, 'ok') AS finding FROM judged",
            "judged",
        ),
        "drift_raw": _sql(
            "SELECT device, metric, round(recent_mean, 6) AS recent_mean, 50.0::DOUBLE AS baseline "
            "FROM cond WHERE abs(recent_mean - 50) > 25",
            "cond",
        ),
        "gap_raw": _sql(
            "SELECT device, metric, round(max_gap, 6) AS max_gap_seconds FROM cond "
            "WHERE max_gap > 864000",
            "cond",
        ),
        "drift_guarded": _sql(
            "SELECT device, metric, type, severity FROM guarded WHERE type = 'drift'", "guarded"
        ),
        "gap_guarded": _sql(
            "SELECT device, metric, type, severity FROM guarded WHERE type = 'offline_gap'", "guarded"
        ),
        "anomalies_all": _sql(
            "SELECT device, metric, reading_id, type, severity, detected_at FROM anom", "anom"
        ),
        "unevaluated": _sql(
            "SELECT reading_id, device, metric FROM r "
            "WHERE sampled_at > TIMESTAMP '2024-01-25 00:00:00' OR metric = 'view'",
            "r",
        ),
        "bounded_eval": _sql(
            f"SELECT reading_id, {_STATS_COLUMNS}, coalesce(finding, 'ok') AS finding FROM judged "
            "WHERE sampled_at > TIMESTAMP '2024-01-25 00:00:00'",
            "judged",
        ),
        "evaluation_view": _sql(
            f"SELECT reading_id, round(value, 6) AS value, {_STATS_COLUMNS}, "
            "sampled_at <= TIMESTAMP '2024-01-25 00:00:00' AND metric <> 'view' AS evaluated FROM stats",
            "stats",
        ),
        "evaluation_view_since": _sql(
            "SELECT reading_id, round(value, 6) AS value, round(avg(value) OVER w, 6) AS mean, "
            "round(coalesce(stddev_pop(value) OVER w, 0), 6) AS std, "
            "sampled_at <= TIMESTAMP '2024-01-25 00:00:00' AND metric <> 'view' AS evaluated "
            "FROM r WHERE sampled_at >= TIMESTAMP '2024-01-24 00:00:00' "
            "WINDOW w AS (PARTITION BY device, metric ORDER BY sampled_at "
            "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
            "r",
        ),
        "eval_checkpoint": _sql(
            "SELECT device, metric, max(sampled_at) AS last_sampled_at FROM r GROUP BY device, metric",
            "r",
        ),
        "window_anchor": _sql(
            "SELECT device, metric, max(sampled_at) FILTER (WHERE place = 6) AS anchor FROM "
            "(SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY sampled_at DESC) "
            "AS place FROM r WHERE sampled_at <= TIMESTAMP '2024-01-25 00:00:00') "
            "GROUP BY device, metric",
            "r",
        ),
        "device_list": _sql(
            "SELECT dev.device, kind, location, coalesce(m.metrics, '') AS metrics FROM dev "
            "LEFT JOIN (SELECT device, string_agg(metric, ',' ORDER BY metric) AS metrics FROM "
            "(SELECT DISTINCT device, metric FROM r) GROUP BY device) m ON m.device = dev.device "
            "WHERE EXISTS (SELECT 1 FROM hb WHERE hb.device = dev.device)",
            "dev", "r", "hb",
        ),
        "fleet": _sql(
            "SELECT * REPLACE (round(last_value, 6) AS last_value, "
            "round(staleness_s, 6) AS staleness_s) FROM status",
            "status",
        ),
        "fleet_overview": _sql(
            "SELECT * REPLACE (round(last_value, 6) AS last_value) FROM overview", "overview"
        ),
        "fleet_totals": _sql(
            "SELECT count(DISTINCT coalesce(location, '—')) AS groups, count(*) AS devices, "
            "count(*) FILTER (WHERE status = 'online') AS online, "
            "count(*) FILTER (WHERE status = 'stale') AS stale, "
            "count(*) FILTER (WHERE status = 'offline') AS offline, "
            "coalesce(sum(open_anomalies), 0)::BIGINT AS open_anomalies FROM status",
            "status",
        ),
        "default_metric": _sql("SELECT device, metric FROM lastdev", "lastdev"),
        "freshness": _sql(
            "SELECT dev.device, last_seen_at, round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') "
            "- epoch_us(last_seen_at)) / 1e6, 6) AS staleness_s "
            "FROM dev JOIN hb ON hb.device = dev.device ORDER BY staleness_s DESC NULLS FIRST",
            "dev", "hb",
        ),
        "freshness_all_devices": _sql(
            "SELECT dev.device, last_seen_at, round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') "
            "- epoch_us(last_seen_at)) / 1e6, 6) AS staleness_s "
            "FROM dev LEFT JOIN hb ON hb.device = dev.device ORDER BY staleness_s DESC NULLS FIRST",
            "dev", "hb",
        ),
        "reading_gaps": _sql(
            "SELECT device, metric, sampled_at AS resumed_at, round(gap, 6) AS silent_for "
            "FROM tail WHERE gap > 86400",
            "tail",
        ),
        "series_tail": _sql(
            "SELECT device, metric, sampled_at, round(value, 6) AS value, "
            "round(rolling_mean_10, 6) AS rolling_mean_10, "
            f"{_shown('value', 'shown_value')}, {_shown('rolling_mean_10', 'shown_mean')} FROM pts",
            "pts",
        ),
        "rolling_full": _sql(
            "SELECT device, metric, sampled_at, round(value, 6) AS value, "
            "round(rolling_mean_10, 6) AS rolling_mean_10, "
            f"{_shown('value', 'shown_value')}, {_shown('rolling_mean_10', 'shown_mean')} FROM "
            "(SELECT *, avg(value) OVER (PARTITION BY device, metric ORDER BY sampled_at "
            "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling_mean_10 FROM r)",
            "r",
        ),
        "series_band": _sql(
            "SELECT device, metric, sampled_at, round(value, 6) AS value, "
            "round(rolling_mean_10, 6) AS rolling_mean_10, "
            "round(rolling_mean_10 - width, 6) AS band_low, "
            "round(rolling_mean_10 + width, 6) AS band_high FROM (SELECT *, "
            "greatest(1.5 * stddev_pop(value) OVER (PARTITION BY device, metric), "
            "0.01 * abs(avg(value) OVER (PARTITION BY device, metric)) + 0.2) AS width FROM pts)",
            "pts",
        ),
        "device_anomalies": _sql(
            "SELECT a.device, a.metric, a.reading_id, type, severity, detected_at, "
            "r.sampled_at AS reading_sampled_at, round(r.value, 6) AS reading_value "
            "FROM anom a LEFT JOIN r ON r.reading_id = a.reading_id",
            "anom",
        ),
        "anomaly_markers": _sql(
            "SELECT a.device, type, severity, r.sampled_at AS reading_sampled_at, "
            "round(r.value, 6) AS reading_value FROM anom a JOIN r ON r.reading_id = a.reading_id",
            "anom",
        ),
        "flagged_readings": _sql(
            "SELECT device, reading_id, type, CAST(place AS INTEGER) AS rank FROM "
            "(SELECT *, row_number() OVER (PARTITION BY device ORDER BY detected_at DESC, "
            "reading_id DESC, type) AS place FROM anom WHERE reading_id IS NOT NULL) "
            "WHERE place <= 6",
            "anom",
        ),
        "genealogy": _sql(
            "SELECT reading_id, device, metric, round(value, 6) AS value, sampled_at, stage, status, "
            "\"at\" FROM (SELECT *, NULL AS finding, 'ingested' AS stage, 'ok' AS status, sampled_at AS \"at\" FROM stats "
            "UNION ALL SELECT *, NULL, 'validated', 'ok', sampled_at FROM stats "
            "UNION ALL SELECT *, 'enriched', 'ok', TIMESTAMP '2024-01-31 00:00:00' FROM judged "
            "UNION ALL SELECT *, 'evaluated', CASE WHEN finding IS NULL THEN 'ok' ELSE 'warn' END, "
            "TIMESTAMP '2024-01-31 00:00:00' FROM judged)",
            "judged",
        ),
        "recent_anomalies": _sql(
            "SELECT device, metric, type, severity, detected_at, resolved_at FROM anom a "
            "WHERE EXISTS (SELECT 1 FROM hb WHERE hb.device = a.device) "
            "ORDER BY detected_at DESC, device, type, metric, reading_id LIMIT 50",
            "anom", "hb",
        ),
        "anomaly_table": _sql(
            "SELECT detected_at, type, severity, device FROM anom ORDER BY detected_at DESC", "anom"
        ),
        "anomaly_details": _sql(
            "SELECT a.device, a.metric, a.reading_id, type, "
            "CASE WHEN type IN ('spike', 'out_of_range') THEN round(r.value, 6) END AS value, "
            "CASE WHEN type = 'spike' THEN 2.0::DOUBLE END AS sigma, "
            "CASE WHEN type = 'out_of_range' THEN 0.05::DOUBLE END AS lo, "
            "CASE WHEN type = 'out_of_range' THEN 300.0::DOUBLE END AS hi, "
            "CASE WHEN type = 'drift' THEN 50.0::DOUBLE END AS baseline, "
            "CASE WHEN type = 'spike' THEN true END AS mean_close, "
            "CASE WHEN type = 'drift' THEN true END AS recent_mean_close, "
            "CASE WHEN type = 'offline_gap' THEN true END AS gap_seconds_close "
            "FROM anom a LEFT JOIN r ON r.reading_id = a.reading_id",
            "anom",
        ),
        "range_by_metric": _sql(
            "SELECT metric, count(*) AS n, round(avg(value), 6) AS avg_value FROM r WHERE sampled_at "
            "BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00' "
            "GROUP BY metric",
            "r",
        ),
        "latest_per_series": _sql(
            "SELECT device, metric, round(arg_max(value, sampled_at), 6) AS value, "
            "max(sampled_at) AS sampled_at, arg_max(reading_id, sampled_at) AS reading_id "
            "FROM r GROUP BY device, metric",
            "r",
        ),
        "latest_per_device": _sql(
            "SELECT device, metric, round(value, 6) AS value, sampled_at FROM lastdev", "lastdev"
        ),
        "hourly_rollup": _sql(
            "SELECT device, metric, hour, round(avg_value, 6) AS avg_value, "
            "round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, n "
            "FROM hourly WHERE hour >= TIMESTAMP '2024-01-24 00:00:00'",
            "hourly",
        ),
        "hourly_merged": _sql(
            "SELECT device, metric, hour, round(avg_value, 6) AS avg_value, "
            "round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, n FROM hourly",
            "hourly",
        ),
        "metric_range": _sql(
            "SELECT sampled_at, device, c_name AS label, round(value, 6) AS value "
            "FROM r JOIN customer ON c_custkey = device WHERE metric = 'error' AND sampled_at "
            "BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00' "
            "ORDER BY sampled_at",
            "r",
        ),
        "totals": _sql(
            "SELECT 'readings' AS name, count(*) AS value FROM r UNION ALL "
            "SELECT 'open_anomalies', count(*) FROM anom WHERE resolved_at IS NULL",
            "anom",
        ),
        "wire_roundtrip": _sql(
            "SELECT device, kind, metric, round(value, 6) AS value, unit, sampled_at, location, "
            "firmware, source_topic, source_partition, source_offset, "
            "CAST(NULL AS VARCHAR) AS quarantine_reason FROM msg",
            "msg",
        ),
        "validation": _sql(
            "SELECT source_offset, CASE WHEN value IS NULL THEN 'non_finite_value' "
            "WHEN metric = '' OR unit = '' THEN 'missing_metric_or_unit' ELSE 'ok' END AS reason "
            "FROM msg",
            "msg",
        ),
        "ingest_trail": _sql(
            "SELECT 'ingested' AS stage, 'ok' AS status, count(*) AS n, "
            "sum(source_offset)::BIGINT AS id_sum FROM msg UNION ALL "
            "SELECT 'validated', CASE WHEN value IS NULL OR unit = '' THEN 'reject' ELSE 'ok' END, "
            "count(*), sum(source_offset)::BIGINT FROM msg GROUP BY 2",
            "msg",
        ),
        "dedup_first": _sql(
            "SELECT reading_id, device, metric, hour, round(value, 6) AS value FROM "
            "(SELECT *, date_trunc('hour', sampled_at) AS hour, row_number() OVER (PARTITION BY "
            "device, metric, date_trunc('hour', sampled_at) ORDER BY reading_id) AS place FROM r) "
            "WHERE place = 1",
            "r",
        ),
        "unseen_keys": _sql(
            "SELECT min(reading_id) AS reading_id, device, metric, CAST(hour AS INTEGER) AS hour "
            "FROM (SELECT *, hour(sampled_at) AS hour FROM r) a "
            "WHERE sampled_at > TIMESTAMP '2024-01-25 00:00:00' AND NOT EXISTS (SELECT 1 FROM r b "
            "WHERE b.sampled_at <= TIMESTAMP '2024-01-25 00:00:00' AND b.device = a.device "
            "AND b.metric = a.metric AND hour(b.sampled_at) = a.hour) "
            "GROUP BY device, metric, hour",
            "r",
        ),
        "device_upsert": _sql(
            "SELECT device, arg_max(kind, source_offset) AS kind, "
            "arg_max(location, source_offset) FILTER (WHERE location IS NOT NULL) AS location, "
            "arg_max(firmware, source_offset) FILTER (WHERE firmware IS NOT NULL) AS firmware "
            "FROM msg GROUP BY device",
            "msg",
        ),
        "heartbeat": _sql("SELECT device, last_seen_at, last_offset FROM hb", "hb"),
        "ingest_checkpoint": _sql(
            "SELECT 'ingester' AS consumer, source_topic AS topic, source_partition AS partition, "
            "max(source_offset) AS last_offset, TIMESTAMP '2024-01-31 00:00:00' AS updated_at "
            "FROM msg GROUP BY source_topic, source_partition",
            "msg",
        ),
        "consumer_lag": _sql(
            "SELECT 'ingester' AS consumer, source_topic AS topic, source_partition AS partition, "
            "last_offset, end_offset, greatest(0, end_offset - last_offset - 1) AS lag FROM "
            "(SELECT source_topic, source_partition, max(source_offset) + 1 AS end_offset, "
            "max(source_offset) FILTER (WHERE sampled_at <= TIMESTAMP '2024-01-25 00:00:00') "
            "AS last_offset FROM msg GROUP BY source_topic, source_partition)",
            "msg",
        ),
        "ingested_by_device": _sql(
            "SELECT device, count(*) AS ingested FROM msg "
            "WHERE value IS NOT NULL AND unit <> '' GROUP BY device",
            "msg",
        ),
        "event_rate": _sql(
            "SELECT date_trunc('minute', sampled_at) AS window_start, count(*) AS n, "
            "round(count(*) / 60.0, 6) AS per_second FROM r GROUP BY 1",
            "r",
        ),
        "anomaly_rate": _sql(
            "SELECT time_bucket(INTERVAL 5 MINUTE, detected_at) AS window_start, type, "
            "count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM anom GROUP BY 1, 2",
            "anom",
        ),
        "lag_buckets": _sql(
            f"SELECT metric, n, {_BUCKET_NAMES}, round({_quantile(0.5)}, 6) AS p50, "
            f"round({_quantile(0.95)}, 6) AS p95 FROM "
            f"(SELECT metric, count(*) AS n, {_buckets('lag')} FROM lags GROUP BY metric)",
            "lags",
        ),
        "gap_histogram": _sql(
            f"SELECT n, {_BUCKET_NAMES}, round({_quantile(0.5)}, 6) AS p50, "
            f"round({_quantile(0.95)}, 6) AS p95 FROM "
            f"(SELECT count(gap) AS n, {_buckets('gap / 3600')} FROM tail)",
            "tail",
        ),
        "missing_hours": _sql(
            "SELECT hb.device, slot FROM hb, (SELECT unnest(generate_series(min(date_trunc('hour', "
            "sampled_at)), max(date_trunc('hour', sampled_at)), INTERVAL 1 HOUR)) AS slot FROM r) "
            "WHERE NOT EXISTS "
            "(SELECT 1 FROM r WHERE r.device = hb.device "
            "AND date_trunc('hour', r.sampled_at) = slot)",
            "hb", "r",
        ),
        "alerts": _alerts(),
        "store_readings": _sql(
            "SELECT device, metric, sampled_at, unit, source_offset, round(value, 6) AS value, "
            "CASE WHEN value IS NULL THEN 'non_finite_value' "
            "WHEN unit = '' THEN 'missing_metric_or_unit' ELSE 'ok' END AS reason FROM msg",
            "msg",
        ),
        "store_devices": _sql(
            "SELECT device, arg_max(kind, source_offset) AS kind, "
            "arg_max(location, source_offset) FILTER (WHERE location IS NOT NULL) AS location, "
            "arg_max(firmware, source_offset) FILTER (WHERE firmware IS NOT NULL) AS firmware, "
            "arg_max(sampled_at, source_offset) AS last_seen_at, "
            "max(source_offset) AS last_offset, count(*) AS readings, "
            "max(sampled_at) AS last_sampled_at FROM msg GROUP BY device",
            "msg",
        ),
        "store_latest": _sql(
            "SELECT device, metric, sampled_at, round(value, 6) AS value, unit FROM (SELECT *, "
            "row_number() OVER (PARTITION BY device, metric ORDER BY sampled_at DESC) AS place "
            "FROM msg) WHERE place = 1",
            "msg",
        ),
        "sweep_findings": _sql(
            "SELECT device, metric, finding AS type, "
            "CASE finding WHEN 'spike' THEN 'warn' ELSE 'critical' END AS severity, "
            "sampled_at AS reading_sampled_at, round(value, 6) AS reading_value "
            "FROM vjudged WHERE finding IS NOT NULL",
            "vjudged",
        ),
        "sweep_trail": _sql(
            "SELECT 'ingested' AS stage, 'ok' AS status, count(*) AS n, count(*) AS readings "
            "FROM msg UNION ALL SELECT 'validated', "
            "CASE WHEN value IS NULL OR unit = '' THEN 'reject' ELSE 'ok' END, count(*), count(*) "
            "FROM msg GROUP BY 2 UNION ALL SELECT 'enriched', 'ok', count(*), count(*) FROM vjudged "
            "UNION ALL SELECT 'evaluated', CASE WHEN finding IS NULL THEN 'ok' ELSE 'warn' END, "
            "count(*), count(*) FROM vjudged GROUP BY 2",
            "vjudged",
        ),
        "stored_rollup": _sql(
            "SELECT device, metric, date_trunc('hour', sampled_at) AS hour, "
            "round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value, "
            "round(max(value), 6) AS max_value, count(*) AS n FROM msg "
            "WHERE value IS NOT NULL AND unit <> '' GROUP BY 1, 2, 3",
            "msg",
        ),
        "total_consumer_lag": _sql(
            "SELECT 'ingester' AS consumer, sum(greatest(0, ends - done - 1))::BIGINT AS lag FROM "
            "(SELECT max(source_offset) + 1 AS ends, max(source_offset) "
            "FILTER (WHERE sampled_at <= TIMESTAMP '2024-01-25 00:00:00') AS done "
            "FROM msg GROUP BY source_partition)",
            "msg",
        ),
        "store_batch_stats": _sql(
            "SELECT (count(*) + repeated)::BIGINT AS arrived, count(*) AS stored, repeated AS duplicates, "
            "count(*) FILTER (WHERE value IS NULL OR unit = '') AS rejected, 0::BIGINT AS quarantined "
            "FROM msg, (SELECT count(*) AS repeated FROM msg WHERE sampled_at > "
            "TIMESTAMP '2024-01-15 00:00:00' AND sampled_at <= TIMESTAMP '2024-01-20 00:00:00') "
            "GROUP BY repeated",
            "msg",
        ),
        "store_offsets": _sql(
            "SELECT 'ingester' AS consumer, source_topic AS topic, source_partition AS partition, "
            "max(source_offset) AS last_offset FROM msg GROUP BY source_topic, source_partition",
            "msg",
        ),
        "store_evaluated": _sql(
            "SELECT device, metric, max(sampled_at) AS last_sampled_at, count(*) AS n, "
            "CAST(least(count(*), 9) AS INTEGER) AS kept FROM valid WHERE metric <> 'view' "
            "GROUP BY device, metric",
            "valid",
        ),
        "batch_equals_sweep": _sql(
            "SELECT device, metric, finding AS type, "
            "CASE finding WHEN 'spike' THEN 'warn' ELSE 'critical' END AS severity, "
            "sampled_at AS detected_at FROM vjudged WHERE finding IS NOT NULL",
            "vjudged",
        ),
        "sweep_late": _sql(
            f"SELECT device, metric, sampled_at, {_shown('mean', 'shown_mean')} FROM vjudged "
            "WHERE source_offset % 7 = 0",
            "vjudged",
        ),
        "stream_stored": _sql(
            "SELECT metric, CAST(sampled_at AS DATE) AS day, count(*) AS n, "
            "count(*) FILTER (WHERE value IS NULL OR unit = '') AS rejected FROM msg GROUP BY 1, 2",
            "msg",
        ),
        "anomaly_table_typed": _sql(
            "SELECT detected_at, type, severity, a.device, a.metric, "
            "CASE WHEN type IN ('spike', 'out_of_range') THEN round(r.value, 6) END AS value, "
            "CASE WHEN type = 'spike' THEN 2.0::DOUBLE END AS sigma, "
            "CASE WHEN type = 'drift' THEN 50.0::DOUBLE END AS baseline, "
            "CASE WHEN type = 'out_of_range' THEN 0.05::DOUBLE END AS lo, "
            "CASE WHEN type = 'out_of_range' THEN 300.0::DOUBLE END AS hi "
            "FROM anom a LEFT JOIN r ON r.reading_id = a.reading_id",
            "anom",
        ),
        "devices_by_day": _sql(
            "SELECT metric, CAST(sampled_at AS DATE) AS day, count(*) AS n, "
            "count(DISTINCT device) AS exact, true AS close FROM r GROUP BY 1, 2",
            "r",
        ),
        "lag_quantiles": _sql(
            "SELECT date_trunc('day', ingested_at)::TIMESTAMP AS window_start, metric, count(*) AS n, "
            "true AS p50_close, true AS p95_close FROM lags GROUP BY 1, 2",
            "lags",
        ),
        "duplicate_rate": _sql(
            "SELECT TIMESTAMP '2024-01-20 12:00:00' AS window_start, count(*) AS arrived, 0::BIGINT AS duplicates, "
            "0.0::DOUBLE AS per_second FROM msg WHERE sampled_at <= TIMESTAMP '2024-01-20 00:00:00' "
            "UNION ALL SELECT TIMESTAMP '2024-02-01 08:15:00', count(*), "
            "count(*) FILTER (WHERE sampled_at <= TIMESTAMP '2024-01-20 00:00:00'), "
            "round(count(*) FILTER (WHERE sampled_at <= TIMESTAMP '2024-01-20 00:00:00') / 60.0, 6) "
            "FROM msg WHERE sampled_at > TIMESTAMP '2024-01-15 00:00:00'",
            "msg",
        ),
        "stream_first_readings": _sql(
            "SELECT device, metric, sampled_at, source_offset, round(value, 6) AS value, "
            "CASE WHEN value IS NULL THEN 'non_finite_value' "
            "WHEN unit = '' THEN 'missing_metric_or_unit' ELSE 'ok' END AS reason FROM msg",
            "msg",
        ),
        "stream_evaluated": _sql(
            "SELECT device, metric, source_offset, round(mean, 6) AS mean, round(std, 6) AS std, "
            "coalesce(finding, 'ok') AS finding FROM vjudged",
            "vjudged",
        ),
        "stream_findings": _sql(
            "SELECT device, metric, source_offset, finding AS type, "
            "CASE finding WHEN 'spike' THEN 'warn' ELSE 'critical' END AS severity, "
            "sampled_at AS detected_at FROM vjudged WHERE finding IS NOT NULL "
            "UNION ALL SELECT device, metric, NULL, type, severity, TIMESTAMP '2024-01-31 00:00:00' FROM vwin",
            "vjudged", "vwin",
        ),
    }
    out["stream_rate"] = out["event_rate"]
    out["genealogy_bucketed"] = out["genealogy"]
    out["genealogy_of_reading"] = f"SELECT * FROM ({out['genealogy']}) WHERE reading_id = 42"
    for name in ("enrich_stats", "reading_gaps", "series_tail", "rolling_full"):
        out[f"{name}_sliced"] = out[name]
    out["hourly_of_store"] = out["stored_rollup"]
    out["stored_rollup_since"] = (
        f"SELECT * FROM ({out['stored_rollup']}) WHERE hour >= TIMESTAMP '2024-01-24 00:00:00'"
    )
    seen = "WHERE EXISTS (SELECT 1 FROM hb WHERE hb.device = a.device)"
    for name, where in (("pareto", seen), ("pareto_all_devices", "")):
        out[name] = _sql(
            "SELECT type, severity, count(*) AS total, "
            "count(*) FILTER (WHERE resolved_at IS NULL) AS still_open, "
            f"count(DISTINCT device) AS devices_affected FROM anom a {where} "
            "GROUP BY type, severity",
            "anom", "hb",
        )
    out["pareto_pivot"] = _sql(
        "SELECT type, "
        + ", ".join(
            f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "warn", "info")
        )
        + " FROM anom GROUP BY type",
        "anom",
    )
    for name, group, where in (
        ("fleet_groups", "coalesce(location, '—')", ""),
        ("fleet_groups_by_kind", "kind", ""),
        ("fleet_groups_of_location", "kind", "WHERE location = 'NATION_3'"),
    ):
        out[name] = _sql(
            f'SELECT {group} AS "group", count(*) AS devices, '
            "sum(open_anomalies)::BIGINT AS open_anomalies, "
            "CASE max(CASE status WHEN 'offline' THEN 3 WHEN 'stale' THEN 2 ELSE 1 END) "
            "WHEN 3 THEN 'offline' WHEN 2 THEN 'stale' ELSE 'online' END AS worst "
            f"FROM status {where} GROUP BY 1",
            "status",
        )
    return out


def _alerts() -> str:
    sums = ", ".join(f"sum({_name(b)}) AS {_name(b)}" for b in BOUNDS)
    return _sql(
        f""", m AS (SELECT DISTINCT date_trunc('minute', ingested_at) AS minute FROM lags),
        spine AS (SELECT unnest(generate_series(min(minute), max(minute), INTERVAL 1 MINUTE))
          AS minute FROM m),
        idle AS (SELECT minute FROM spine s WHERE NOT EXISTS (SELECT 1 FROM m
          WHERE m.minute IN (s.minute, s.minute - INTERVAL 1 MINUTE))),
        per AS (SELECT date_trunc('minute', ingested_at) AS minute, count(*) AS n, {_buckets('lag')}
          FROM lags GROUP BY 1),
        five AS (SELECT unnest([minute, minute + INTERVAL 1 MINUTE, minute + INTERVAL 2 MINUTE,
          minute + INTERVAL 3 MINUTE, minute + INTERVAL 4 MINUTE]) AS minute, * EXCLUDE (minute)
          FROM per),
        slow AS (SELECT minute FROM (SELECT minute, sum(n) AS n, {sums} FROM five GROUP BY minute)
          WHERE {_quantile(0.95)} > 30),
        fly AS (SELECT minute, count(*) AS lag FROM (SELECT unnest(generate_series(
          date_trunc('minute', sampled_at) + INTERVAL 1 MINUTE,
          date_trunc('minute', ingested_at), INTERVAL 1 MINUTE)) AS minute FROM lags)
          GROUP BY minute)
        SELECT 'no_readings_ingested' AS alert, i.minute FROM idle i
          JOIN idle p ON p.minute = i.minute - INTERVAL 1 MINUTE
        UNION ALL SELECT 'high_ingest_lag', i.minute FROM slow i
          JOIN slow p ON p.minute = i.minute - INTERVAL 1 MINUTE
        UNION ALL SELECT 'high_consumer_lag', minute FROM fly WHERE lag > 1""",
        "lags",
    )
