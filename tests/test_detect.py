from __future__ import annotations

import json
import math
from datetime import timedelta

from pyspark.sql import functions as F

from conftest import READING, START
from fleetlens.config import Limits, Settings
from fleetlens.operators import detect

TEMP = Settings(limits=(Limits("temperature_c", -10.0, 60.0, 22.0, 4.0, 3.0),))
M = "temperature_c"


def test_point_rules(spark, seed):
    rows = seed(
        {
            ("oor", M): [22.0, 22.1, 100.0],
            ("spike", M): [22.0] * 20 + [50.0],
            ("steady", M): [22.0] * 25,
            ("at16", M): [22.0] * 15 + [50.0],
            ("at18", M): [22.0] * 17 + [50.0],
            ("both", M): [22.0] * 20 + [99.0],
            ("nan", M): [22.0] * 20 + [math.nan] + [22.0] * 3,
            ("edge", M): [-10.0, 60.0],
            ("other", "unlimited"): [1e9],
        }
    )
    judged = detect.evaluate_points(rows, TEMP)
    found = {(r.device, r.finding) for r in judged.filter("finding is not null").collect()}
    assert found == {
        ("oor", "out_of_range"), ("spike", "spike"), ("at18", "spike"), ("both", "out_of_range"),
    }
    devices = {r.device: r.n for r in judged.groupBy("device").agg(F.count("*").alias("n")).collect()}
    assert "other" not in devices  # no limits, not judged
    assert devices["nan"] == 23  # the rejected reading is neither judged nor in a window

    rows = {r.type: r for r in detect.point_anomalies(judged, START).collect()}
    assert json.loads(rows["out_of_range"].detail)["range"] == [-10.0, 60.0]
    assert rows["out_of_range"].severity == "critical"
    detail = json.loads(rows["spike"].detail)
    assert rows["spike"].severity == "warn" and detail["sigma"] == 4.0
    assert detail["mean"] == round(detail["mean"], 3)

    trail = detect.evaluation_stages(judged, START)
    assert trail.filter("stage = 'evaluated'").count() == judged.count()
    assert trail.filter("stage = 'enriched' and status = 'ok'").count() == judged.count()
    assert trail.filter("stage = 'evaluated' and status = 'warn'").count() == 4


def condition(rows, settings=TEMP):
    return detect.series_condition(rows, settings)


def test_drift_and_guard(seed):
    rows = seed(
        {
            ("drift", M): [30.0] * 30,
            ("clean", M): [22.0] * 30,
            ("short", M): [30.0] * 2,
            ("recovered", M): [40.0] * 50 + [22.0] * 30,
        }
    )
    found = detect.window_anomalies(condition(rows), TEMP, START)
    assert sorted((r.device, r.type) for r in found.collect()) == [
        ("drift", "drift"), ("short", "drift"),
    ]
    raised = detect.guard(found)
    assert raised.count() == 2 and {r.severity for r in raised.collect()} == {"warn"}
    for _ in range(2):  # later sweeps stay silent while the anomaly is open
        assert detect.guard(found, raised).isEmpty()
    resolved = raised.withColumn("resolved_at", F.current_timestamp())
    assert detect.guard(found, resolved).count() == 2


def test_one_anomaly_per_device_and_type(seed):
    limits = tuple(Limits(m, -1e9, 1e9, 0.0, 4.0, 1.0) for m in ("b_metric", "a_metric"))
    settings = Settings(limits=limits)
    rows = seed({("d", "b_metric"): [5.0] * 3, ("d", "a_metric"): [5.0] * 3})
    raised = detect.guard(detect.window_anomalies(condition(rows, settings), settings, START))
    assert [(r.device, r.metric, r.type) for r in raised.collect()] == [("d", "a_metric", "drift")]


def test_offline_gap(spark):
    def at(*seconds):
        return [START + timedelta(seconds=s) for s in seconds]

    plan = {
        "gap": at(-120, -118, -10),
        "none": at(0, 2, 4),
        "silent_now": at(0, 2),
        # 201 gaps, the long one is the oldest and out of sight
        "old": at(0, *range(100, 100 + 2 * 201, 2)),
        # 200 gaps, the long one is just in sight
        "seen": at(0, *range(100, 100 + 2 * 200, 2)),
    }
    rows, number = [], 0
    for device, times in plan.items():
        for moment in times:
            rows.append((number, device, M, 22.0, moment))
            number += 1
    found = detect.window_anomalies(condition(spark.createDataFrame(rows, READING)), TEMP, START)
    gaps = {r.device: json.loads(r.detail)["gap_seconds"] for r in found.collect()}
    assert gaps == {"gap": 108.0, "seen": 100.0}


def test_unevaluated_and_marks(spark, seed):
    rows = seed({("d", M): [22.0, 22.1, 21.9]})
    trail = detect.evaluation_stages(
        detect.evaluate_points(rows.filter("reading_id < 2"), TEMP), START
    )
    assert [r.reading_id for r in detect.unevaluated(rows, trail).collect()] == [2]
    marks = {r.reading_id: r.evaluated for r in detect.mark_evaluated(rows, trail).collect()}
    assert marks == {0: True, 1: True, 2: False}
