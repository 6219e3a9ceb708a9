"""Sketches against exact numbers, and tables in buckets."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import READING, START
from fleetlens.operators import sketches
from fleetlens.plans import investigate, quality
from fleetlens.sources.buckets import save_bucketed


def test_distinct_devices_of_any_range(spark):
    rows = spark.range(60_000).select(
        "id", F.concat(F.lit("d"), F.expr("id % 9000")).alias("device"), F.lit("m").alias("metric"),
        F.col("id").cast("double").alias("value"), F.timestamp_seconds(F.lit(1767225600) + F.col("id") * 6).alias("sampled_at"),
    )
    hours = sketches.hourly_devices(rows)
    assert hours.count() == 100
    bound = 4 * 1.04 / 2 ** (sketches.LG_SIZE / 2)
    for first, last in ((0, 100), (3, 5), (40, 90)):
        start, end = START + timedelta(hours=first), START + timedelta(hours=last)
        inside = rows.filter((F.col("sampled_at") >= F.lit(start)) & (F.col("sampled_at") < F.lit(end)))
        exact, n = inside.agg(F.count_distinct("device"), F.count("*")).first()
        got = sketches.distinct_devices(hours, start, end).first()
        assert got.n == n and abs(got.devices - exact) <= bound * exact
    # Hours of separate batches merge.
    even, odd = (sketches.hourly_devices(rows.filter(f"id % 2 = {i}")) for i in (0, 1))
    merged = sketches.distinct_devices(even.unionByName(odd)).first()
    assert merged.n == 60_000 and abs(merged.devices - 9000) <= bound * 9000
    none = sketches.distinct_devices(hours.limit(0), by=("metric",))
    assert none.count() == 0


def test_quantiles_of_raw_lags(spark):
    draw = random.Random(1)
    lags = [draw.expovariate(0.1) if draw.random() < 0.7 else float(draw.randrange(5)) for _ in range(20_000)]
    rows = spark.createDataFrame(
        [(START + timedelta(seconds=draw.randrange(600)), lag) for lag in lags], "ingested_at timestamp, lag_seconds double"
    )
    rows = rows.unionByName(spark.createDataFrame([(START, None), (START, float("nan"))], rows.schema))
    minutes = sketches.lag_sketches(rows)
    assert minutes.count() == 10
    found = sketches.lag_quantiles(minutes, "10 minutes", quantiles=(("p50", 0.5), ("p95", 0.95), ("p99", 0.99))).first()
    assert found.n == len(lags)
    for q, got in ((0.5, found.p50), (0.95, found.p95), (0.99, found.p99)):
        below = sum(x < got for x in lags) / len(lags)
        upto = sum(x <= got for x in lags) / len(lags)
        assert below - 0.015 <= q <= upto + 0.015
    few = sketches.lag_quantiles(sketches.lag_sketches(rows.filter("lag_seconds = 3").limit(7)), "1 hour")
    assert few.agg(F.min("p50"), F.max("p95")).first()[:] == (3.0, 3.0)
    assert quality.lag_buckets(rows).count() == 1


@pytest.fixture
def facts(spark, tmp_path):
    rows = [(i, f"d{i % 5}", "m", float(i), START) for i in range(400)]
    trail = [(i, s, "ok", START) for i in range(400) for s in ("ingested", "validated")]
    saved = {}
    for name, frame in (
        ("t_readings", spark.createDataFrame(rows, READING)),
        ("t_stages", spark.createDataFrame(trail, "reading_id long, stage string, status string, at timestamp")),
    ):
        saved[name] = save_bucketed(frame, name, str(tmp_path / name), "reading_id", 4)
    yield saved["t_readings"], saved["t_stages"]
    for name in saved:
        spark.sql(f"DROP TABLE {name}")


def test_bucketed_genealogy_needs_no_shuffle(spark, facts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        trail = investigate.genealogy(*facts)
        plan = trail._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
        assert trail.count() == 800 and trail.select("reading_id").distinct().count() == 400
        one = investigate.genealogy(*facts, reading_id=17)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SelectedBucketsCount: 1 out of 4") == 2
        assert [r.stage for r in one.collect()] == ["ingested", "validated"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_variant_details(spark):
    schema = "detected_at timestamp, type string, severity string, device string, metric string, detail string"
    rows = [
        (START, "spike", "warn", "a", "m", '{"value":3.5,"mean":1.25,"sigma":4.0}'),
        (START, "out_of_range", "critical", "b", "m", '{"value":99.0,"range":[-5.0,60.0]}'),
        (START, "drift", "warn", "c", "m", '{"recent_mean":25.5,"baseline":"?"}'),
        (START, "offline_gap", "critical", "d", "m", None),
        (START, "offline_gap", "critical", "e", "m", "no json"),
    ]
    found = {r.device: r for r in investigate.anomaly_table_typed(spark.createDataFrame(rows, schema)).collect()}
    assert (found["a"].value, found["a"].mean, found["a"].sigma, found["a"].lo) == (3.5, 1.25, 4.0, None)
    assert (found["b"].value, found["b"].lo, found["b"].hi) == (99.0, -5.0, 60.0)
    assert (found["c"].recent_mean, found["c"].baseline) == (25.5, None)
    assert found["d"].gap_seconds is None and found["e"].gap_seconds is None
