from __future__ import annotations

import json
from datetime import timedelta

from conftest import START, message
from fleetlens.config import Settings
from fleetlens.sources.wire import file_stream
from fleetlens.streaming import queries as streams
from fleetlens.streaming.rollup import read_rollup


def drop_file(folder, name, messages, first):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"key": "k", "value": json.dumps(m), "topic": "t", "partition": 0, "offset": first + i})
        for i, m in enumerate(messages)
    ]
    (folder / name).write_text("\n".join(lines))


def test_files_to_store_and_sweeps(spark, store, tmp_path):
    folder, mark = tmp_path / "in", str(tmp_path / "mark")
    values = [22.0] * 20 + [50.0]
    sent = [message("d", v, START + timedelta(seconds=2 * i)) for i, v in enumerate(values)]
    drop_file(folder, "a.json", sent[:15], 0)
    drop_file(folder, "b.json", sent[10:], 15)  # five messages delivered again

    def drain():
        source = file_stream(spark, str(folder), files_per_batch=1)
        streams.start_ingest(source, store, mark, seconds=None).awaitTermination()

    drain()
    assert store.refresh().facts("reading").count() == 21
    drain()  # nothing new
    assert store.refresh().facts("batch_stats").count() == 2
    # a lost checkpoint: everything is read again and nothing is stored twice
    again = file_stream(spark, str(folder))
    streams.start_ingest(again, store, str(tmp_path / "new"), seconds=None).awaitTermination()
    assert store.refresh().facts("reading").count() == 21
    assert store.facts("batch_stats").filter("stored = 0 and duplicates = 26").count() == 1
    sweeps = str(tmp_path / "sweeps")
    streams.start_sweeps(store, Settings(), sweeps, drain=True).awaitTermination()
    assert [r.type for r in store.refresh().facts("anomaly").collect()] == ["spike"]
    assert read_rollup(store).count() == 1

    drop_file(folder, "c.json", [message("d", 99.0, START + timedelta(seconds=100))], 40)
    drain()
    streams.start_sweeps(store, Settings(), sweeps, drain=True).awaitTermination()
    found = sorted(r.type for r in store.refresh().facts("anomaly").collect())
    # the mean of all 22 values is (20 * 22 + 50 + 99) / 22 = 26.8, more than 3 off
    assert found == ["drift", "offline_gap", "out_of_range", "spike"]


def test_sweeps_of_a_new_store(spark, store, tmp_path):
    """A sweep stream may be started before anything was ingested."""
    sweeps = str(tmp_path / "sweeps")
    streams.start_sweeps(store, Settings(), sweeps, drain=True).awaitTermination()
    folder = tmp_path / "in"
    drop_file(folder, "a.json", [message("d", 500.0, START)], 0)
    source = file_stream(spark, str(folder))
    streams.start_ingest(source, store, str(tmp_path / "mark"), seconds=None).awaitTermination()
    streams.start_sweeps(store, Settings(), sweeps, drain=True).awaitTermination()
    assert {r.type for r in store.refresh().facts("anomaly").collect()} == {"out_of_range", "drift"}


def test_rate_stream_emits_closed_windows_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for number, minutes in enumerate(([0, 0, 1], [2, 0], [30])):
        lines = [json.dumps({"at": (START + timedelta(minutes=m)).isoformat()}) for m in minutes]
        (folder / f"{number}.json").write_text("\n".join(lines))
    source = spark.readStream.schema("at timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    out = str(tmp_path / "out")
    rates = streams.stream_rate(source, "at", minutes=1, late="5 minutes")
    (
        rates.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "mark"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    got = sorted((r.window_start, r.n) for r in spark.read.parquet(out).collect())
    naive = START.replace(tzinfo=None)
    assert got == [(naive + timedelta(minutes=m), n) for m, n in ((0, 3), (1, 1), (2, 1))]
