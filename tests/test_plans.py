from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import START
from fleetlens.operators import rollup
from fleetlens.plans import fleet as fleets
from fleetlens.plans import investigate, quality

NAIVE = START.replace(tzinfo=None)
ANOMALY = (
    "device string, metric string, reading_id long, type string, severity string, "
    "detected_at timestamp, resolved_at timestamp"
)


@pytest.fixture
def anomalies(spark):
    t = [START + timedelta(seconds=i) for i in range(10)]
    return spark.createDataFrame(
        [
            ("a", "m", 0, "spike", "warn", t[0], None),
            ("a", "m", 1, "spike", "warn", t[1], t[5]),
            ("a", "m", None, "drift", "warn", t[2], None),
            ("b", "m", 3, "out_of_range", "critical", t[3], None),
            ("ghost", "m", 99, "spike", "warn", t[4], None),
        ],
        ANOMALY,
    )


@pytest.fixture
def devices(spark):
    rows = [("a", "k1", "hall"), ("b", "k2", None), ("c", "k1", "hall"), ("ghost", "k3", "yard")]
    return spark.createDataFrame(rows, "device string, kind string, location string")


@pytest.fixture
def beats(spark):
    rows = [
        ("a", START, 1), ("b", START - timedelta(seconds=30), 2), ("c", START - timedelta(days=1), 3),
    ]
    return spark.createDataFrame(rows, "device string, last_seen_at timestamp, last_offset long")


def test_fleet_groups_and_totals(spark, seed, devices, beats, anomalies):
    readings = seed({("a", "m"): [1.0, 2.0], ("b", "m"): [3.0]})
    rows = fleets.fleet(devices, readings, beats, anomalies, START + timedelta(seconds=1))
    got = {r.device: (r.last_value, r.status, r.open_anomalies) for r in rows.collect()}
    assert got == {"a": (2.0, "online", 2), "b": (3.0, "stale", 1), "c": (None, "offline", 0)}
    assert [r.device for r in rows.collect()] == ["a", "b", "c"]
    groups = {r.group: r for r in fleets.fleet_groups(rows).collect()}
    assert (groups["hall"].devices, groups["hall"].worst) == (2, "offline")
    assert groups["—"].worst == "stale"
    totals = fleets.fleet_totals(fleets.filter_fleet(rows, kind="k1")).first()
    assert totals.asDict() == {
        "groups": 1, "devices": 2, "online": 1, "stale": 0, "offline": 1, "open_anomalies": 2,
    }
    nothing = fleets.fleet_totals(fleets.filter_fleet(rows, location="nowhere")).first()
    assert nothing.devices == 0 and nothing.open_anomalies == 0
    everyone = fleets.fleet_overview(devices, readings, beats, anomalies)
    assert everyone.count() == 4

    lists = {r.device: r.metrics for r in fleets.device_list(devices, readings, beats).collect()}
    assert lists == {"a": ["m"], "b": ["m"], "c": []}
    ages = fleets.staleness(devices, beats, START, include_unseen=True).collect()
    assert [r.device for r in ages] == ["ghost", "c", "b", "a"]


def test_pareto_and_recent(anomalies, beats):
    seen = fleets.seen_only(anomalies, beats)
    rows = {(r.type, r.severity): r for r in investigate.pareto(seen).collect()}
    spike = rows[("spike", "warn")]
    assert (spike.total, spike.still_open, spike.devices_affected) == (2, 1, 1)
    wide = investigate.pareto_pivot(investigate.pareto(anomalies)).collect()
    assert [(r.type, r.critical, r.warn, r.info) for r in wide] == [
        ("spike", 0, 3, 0), ("drift", 0, 1, 0), ("out_of_range", 1, 0, 0),
    ]
    newest = investigate.recent_anomalies(anomalies, 2).collect()
    assert [r.device for r in newest] == ["ghost", "b"]
    for limit in (0, 201):
        with pytest.raises(ValueError):
            investigate.recent_anomalies(anomalies, limit)
    flagged = investigate.flagged_readings(anomalies, 1).collect()
    assert {(r.device, r.reading_id) for r in flagged} == {("a", 1), ("b", 3), ("ghost", 99)}


def test_device_anomalies_keep_those_without_reading(anomalies, seed):
    rows = investigate.device_anomalies(anomalies, seed({("a", "m"): [1.0, 2.0]}), "a")
    got = [(r.type, r.reading_value) for r in rows.collect()]
    assert got == [("drift", None), ("spike", 2.0), ("spike", 1.0)]
    assert investigate.markers(rows).count() == 2


def test_series_mean_restarts_but_history_does_not(seed):
    rows = seed({("a", "m"): range(1, 13)})
    tail = investigate.series_tail(rows, 3, device="a", metric="m").collect()
    assert [(r.value, r.rolling_mean_10) for r in tail] == [(10.0, 10.0), (11.0, 10.5), (12.0, 11.0)]
    whole = investigate.series_history(rows, "a").collect()
    assert whole[-1].rolling_mean_10 == 7.5
    band = investigate.series_band(investigate.series_points(rows, 3)).collect()
    width = 1.5 * (2 / 3) ** 0.5
    assert {round(r.band_high - r.rolling_mean_10, 9) for r in band} == {round(width, 9)}
    with pytest.raises(ValueError):
        investigate.series_tail(rows, 2001)


def test_gaps_and_range(spark, seed):
    rows = seed({("a", "m"): [1.0, 2.0]}, step=20).unionByName(
        seed({("b", "m"): [1.0, 2.0]}, step=20.5)
    )
    found = investigate.reading_gaps(rows).collect()
    assert [(r.device, r.silent_for) for r in found] == [("b", 20.5)]
    inside = investigate.range_by_metric(rows, START, START + timedelta(seconds=20)).first()
    assert (inside.n, inside.avg_value) == (3, 4 / 3)


def test_spine_and_missing_hours(spark, seed):
    rows = seed({("a", "m"): [1.0, 2.0]}, step=7200)
    devices = spark.createDataFrame([("a",), ("z",)], "device string")
    gone = rollup.missing_hours(rows, devices, NAIVE, NAIVE + timedelta(hours=2))
    assert sorted((r.device, (r.slot - NAIVE).seconds // 3600) for r in gone.collect()) == [
        ("a", 1), ("z", 0), ("z", 1), ("z", 2),
    ]


def test_rates_and_consumer_lag(spark, seed):
    rates = quality.event_rate(seed({("a", "m"): range(45)}), "sampled_at", 1).collect()
    assert sorted((r.n, r.per_second) for r in rates) == [(15, 0.25), (30, 0.5)]
    offsets = spark.createDataFrame(
        [("c", "t", 0, 9), ("c", "t", 1, 20)],
        "consumer string, topic string, partition int, last_offset long",
    )
    ends = spark.createDataFrame(
        [("t", 0, 15), ("t", 1, 10)], "topic string, partition int, end_offset long"
    )
    lags = quality.consumer_lag(offsets, ends)
    assert sorted(r.lag for r in lags.collect()) == [0, 5]
    assert quality.total_lag(lags).first().lag == 5


def test_alert_conditions(spark):
    def minute(i):
        return START + timedelta(minutes=i)

    rows = spark.createDataFrame(
        [(minute(0), 1.0), (minute(1), 1.0), (minute(6), 50.0), (minute(7), 50.0)],
        "ingested_at timestamp, lag_seconds double",
    ).withColumn("sampled_at", F.col("ingested_at") - F.expr("INTERVAL 90 SECONDS"))
    at = {i: (NAIVE + timedelta(minutes=i)) for i in range(20)}
    stalled = quality.stalled_minutes(rows, NAIVE, at[9]).collect()
    # idle over two minutes from 3 on, held for two minutes from 4 on; same after 7
    assert sorted(r.minute for r in stalled) == [at[4], at[5]]
    slow = quality.slow_minutes(rows).collect()
    # slow windows last from 6 to 11; the first minute does not count yet
    assert sorted(r.minute for r in slow) == [at[i] for i in range(7, 12)]
    waiting = {r.minute: r.lag for r in quality.in_flight(rows).collect()}
    assert waiting[at[0]] == 2 and waiting[at[1]] == 1
    behind = quality.behind_minutes(quality.in_flight(rows), limit=1)
    firing = quality.alerts(quality.stalled_minutes(rows, NAIVE, at[9]), behind)
    assert {r.alert for r in firing.collect()} == {"no_readings_ingested", "high_consumer_lag"}
