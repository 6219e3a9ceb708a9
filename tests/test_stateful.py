"""Streams with state: repeats, restarts, late readings, complete rates."""

from __future__ import annotations

import json
import math
from datetime import timedelta

from pyspark.sql import functions as F

from conftest import START, message
from fleetlens.config import Limits, Settings
from fleetlens.operators import detect, ingest
from fleetlens.sources.wire import decode, file_stream
from fleetlens.streaming import stateful

M = "temperature_c"
SMALL = Settings(limits=(Limits(M, 0.0, 90.0, 20.0, 1.5, 5.0),), spike_window=4, drift_window=3, gap_lookback=3, gap_seconds=100)


def drop_file(folder, name, messages, first):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"key": "k", "value": m if isinstance(m, str) else json.dumps(m), "topic": "t", "partition": 0, "offset": first + i})
        for i, m in enumerate(messages)
    ]
    (folder / name).write_text("\n".join(lines))


def test_repeats_are_dropped_and_late_readings_kept(spark, tmp_path):
    sent = [message("d", 20.0 + i, START + timedelta(seconds=i)) for i in range(6)]
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def drain():
        rows = stateful.first_readings(file_stream(spark, str(folder), files_per_batch=1))
        stateful.drained(rows, out, mark).awaitTermination()

    drop_file(folder, "a.json", [sent[3], sent[3], sent[4], "no json"], 0)
    drop_file(folder, "b.json", [sent[4], sent[5]], 4)
    drain()
    # After the restart: repeats of before, and readings from long before the newest.
    early = message("d", 1.0, START - timedelta(days=400))
    drop_file(folder, "c.json", [sent[3], sent[0], early, early], 6)
    drain()
    got = sorted((r.sampled_at, r.source_offset) for r in spark.read.parquet(out).collect())
    naive = START.replace(tzinfo=None)
    assert [o for _, o in got] == [8, 7, 0, 2, 5]
    assert got[0][0] == naive - timedelta(days=400)


def test_evaluation_equals_the_batch_after_restarts(spark, tmp_path):
    values = [20, 21, 19, 20, 60, 20, 95, 20, 21, 30, 31, 32]
    at = [START + timedelta(seconds=10 * i + (500 if i > 8 else 0)) for i in range(len(values))]
    sent = [message(d, v + (d == "e"), t) for v, t in zip(values, at) for d in ("d", "e")]
    sent.insert(7, message("d", math.nan, START + timedelta(seconds=31)))
    sent.insert(9, message("d", 1.0, START, metric="unlimited"))
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def readings(raw):
        rows = ingest.with_validation(decode(raw)).filter("quarantine_reason IS NULL")
        return rows.withColumn("reading_id", F.col("source_offset"))

    done = 0
    for n in (5, 6, 26):  # a run each; within a file readings are not in order
        drop_file(folder, f"{n}.json", [json.dumps(m) for m in reversed(sent[done:n])], 100 * n)
        done = n
        raw = file_stream(spark, str(folder), files_per_batch=1)
        stateful.drained(stateful.evaluated(readings(raw), SMALL), out, mark).awaitTermination()
    rows = spark.read.schema(stateful.EVALUATED).parquet(out)
    whole = readings(spark.read.schema("key string, value string, topic string, partition int, offset long").json(str(folder)))
    want = detect.evaluate_points(whole, SMALL)
    close = lambda r: (r.device, r.sampled_at, round(r["mean"], 9), round(r["std"], 9), r.finding)
    found = sorted(map(close, stateful.point_findings(rows, SMALL).collect()))
    assert found == sorted(map(close, want.collect())) and len(found) == 24
    assert {r[-1] for r in found} == {None, "spike", "out_of_range"}
    windows = detect.window_anomalies(detect.series_condition(whole, SMALL), SMALL, START)
    names = ("device", "metric", "type", "detail")
    assert sorted(windows.select(*names).collect()) == sorted(stateful.window_findings(rows, SMALL, START).select(*names).collect())
    assert windows.count() == 4

    # A reading from before the state: told apart, not misjudged.
    drop_file(folder, "late.json", [message("d", 50.0, START - timedelta(seconds=5))], 9000)
    raw = file_stream(spark, str(folder), files_per_batch=1)
    stateful.drained(stateful.evaluated(readings(raw), SMALL), out, mark).awaitTermination()
    late = spark.read.schema(stateful.EVALUATED).parquet(out).filter("reading_id = '9000'").collect()
    assert [r.covered for r in late] == [False]


def test_series_share_buckets_of_state(spark, tmp_path):
    """Calls and state keys are as many as buckets, not as series; results are those of the batch."""
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    whole = []
    for part in range(3):
        sent = [
            message(f"d{d}", 20.0 + (d * 7 + i * 5) % 11 + (80 if (d, i) == (3, 7) else 0), START + timedelta(seconds=200 * i + d))
            for i in range(4 * part, 4 * part + 4)
            for d in range(30)
            if (d + part) % 3  # some series of a bucket rest while others go on
        ]
        drop_file(folder, f"{part}.json", sent, 1000 * part)
        raw = file_stream(spark, str(folder), files_per_batch=1)
        rows = ingest.with_validation(decode(raw)).withColumn("reading_id", F.col("source_offset"))
        query = stateful.drained(stateful.evaluated(rows, SMALL, buckets=2), out, mark)
        query.awaitTermination()
        whole += [json.dumps({"key": "k", "value": json.dumps(m), "topic": "t", "partition": 0, "offset": 1000 * part + i}) for i, m in enumerate(sent)]
    keys = spark.read.format("statestore").option("path", mark).option("stateVarName", "series").load().select("key").distinct()
    assert keys.count() <= 2
    rows = spark.read.schema(stateful.EVALUATED).parquet(out)
    text = spark.createDataFrame([(w,) for w in whole], "line string")
    raw = text.select(F.from_json("line", "key string, value string, topic string, partition int, offset long").alias("m")).select("m.*")
    readings = ingest.with_validation(decode(raw)).withColumn("reading_id", F.col("source_offset"))
    close = lambda r: (r.device, r.sampled_at, round(r["mean"], 9), round(r["std"], 9), r.finding)
    want = sorted(map(close, detect.evaluate_points(readings, SMALL).collect()), key=str)
    assert sorted(map(close, stateful.point_findings(rows, SMALL).collect()), key=str) == want and len(want) == 240
    windows = detect.window_anomalies(detect.series_condition(readings, SMALL), SMALL, START).select("device", "type", "detail")
    found = stateful.window_findings(rows, SMALL, START).select("device", "type", "detail")
    assert sorted(found.collect()) == sorted(windows.collect()) and windows.count() > 0


def test_rates_are_complete_and_replays_replace(spark, tmp_path):
    schema = "at timestamp"
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for minutes in ([0, 0, 50], [90, 1, 0]):  # the second batch is far behind the first
        rows = [(START + timedelta(minutes=m),) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stateful.start_rate(stream, "at", out, mark, seconds=None).awaitTermination()
    rates = {r.window_start: (r.n, round(r.per_second, 6)) for r in stateful.read_rate(spark, out).collect()}
    naive = START.replace(tzinfo=None)
    assert rates == {naive + timedelta(minutes=m): (n, round(n / 60, 6)) for m, n in ((0, 3), (1, 1), (50, 1), (90, 1))}
