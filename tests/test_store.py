"""Ingest, replay, state and incremental sweeps against the written tables."""

from __future__ import annotations

import json
import math
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import START, message
from fleetlens.config import Limits, Settings
from fleetlens.operators import detect, ingest, series
from fleetlens.plans import fleet as fleets
from fleetlens.plans import investigate
from fleetlens.sources.store import INGEST, Store
from fleetlens.sources.tables import RAW
from fleetlens.streaming.ingest import ingest_batch
from fleetlens.streaming import sweep as sweeps_module
from fleetlens.streaming.rollup import read_rollup, refresh_rollup
from fleetlens.streaming.sweep import sweep

M = "temperature_c"
TEMP = Settings(limits=(Limits(M, -10.0, 60.0, 22.0, 4.0, 3.0),))


def raw(spark, messages, first=0, partition=0):
    rows = [
        ("k", m if isinstance(m, str) else json.dumps(m), "t", partition, first + i)
        for i, m in enumerate(messages)
    ]
    return spark.createDataFrame(rows, RAW)


def series_of(device, values, start=START, step=2, metric=M):
    return [
        message(device, v, start + timedelta(seconds=i * step), metric)
        for i, v in enumerate(values)
    ]


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_first_arrival_wins_within_and_across_batches(spark, store):
    same = [message("d", 1.0, START), message("d", 2.0, START)]
    assert ingest_batch(store, raw(spark, same), 0)
    late = [message("d", 3.0, START), message("d", 4.0, START + timedelta(seconds=2))]
    assert ingest_batch(store, raw(spark, late, first=2), 1)
    assert rows_of(store.facts("reading"), "value", "source_offset") == [(1.0, 0), (4.0, 3)]
    assert rows_of(store.facts("batch_stats"), "arrived", "stored", "duplicates") == [
        (2, 1, 1), (2, 1, 1),
    ]
    # duplicates move the offset but neither the heartbeat nor the trail
    assert rows_of(store.state("offsets"), "consumer", "last_offset") == [("ingester", 3)]
    assert store.facts("ingest_stage").count() == 4
    assert not ingest_batch(store, raw(spark, late, first=2), 1)  # replay of a stored batch
    assert store.facts("reading").count() == 2


def test_unfinished_batch_is_invisible_and_written_again(spark, store, monkeypatch):
    assert ingest_batch(store, raw(spark, series_of("d", [1.0, 2.0])), 0)

    def fail(*_, **__):
        raise RuntimeError("lost")

    more = raw(spark, series_of("d", [3.0], START + timedelta(seconds=60)), first=2)
    monkeypatch.setattr(Store, "commit", fail)
    with pytest.raises(RuntimeError):
        ingest_batch(store, more, 1)
    monkeypatch.undo()
    other = Store(spark, store.root, store.snapshot_every)
    assert other.facts("reading").count() == 2 and other.state("series").first().n == 2
    assert ingest_batch(other, more, 1)
    assert other.facts("reading").count() == 3 and other.state("series").first().n == 3
    assert other.facts("ingest_stage").count() == 6


def test_rejects_quarantine_and_keyed_state(spark, store):
    later = START + timedelta(seconds=10)
    batch = [
        message("d", 1.0, later, location="rack-a", firmware="1"),
        message("d", math.nan, later + timedelta(seconds=1), kind="other"),
        message("d", 5.0, START, unit=""),  # older clock, higher offset
        "{broken",
        message("e", 1.0, START, location=None),
    ]
    ingest_batch(store, raw(spark, batch), 0)
    assert rows_of(store.facts("reading"), "device", F.coalesce("reject_reason", F.lit("ok"))) == [
        ("d", "missing_metric_or_unit"), ("d", "non_finite_value"), ("d", "ok"), ("e", "ok"),
    ]
    assert rows_of(store.facts("quarantine"), "raw_value", "source_offset", "reason") == [
        ("{broken", 3, "malformed_json")
    ]
    beat = store.state("heartbeat").filter("device = 'd'").first()
    assert beat.last_seen_at == START.replace(tzinfo=None) and beat.last_offset == 2
    device = store.state("device").filter("device = 'd'").first()
    assert (device.kind, device.location, device.firmware) == ("temp-probe", "rack-a", "1")

    again = [message("d", 2.0, later + timedelta(seconds=5), kind="new", location=None, firmware="2")]
    ingest_batch(store, raw(spark, again, first=9), 1)
    device = store.state("device").filter("device = 'd'").first()
    assert (device.kind, device.location, device.firmware) == ("new", "rack-a", "2")
    assert store.state("device").count() == 2

    names = rows_of(store.facts("ingest_stage"), "stage", "status")
    assert names.count(("validated", "reject")) == 2 and names.count(("ingested", "ok")) == 5
    assert rows_of(ingest.ingested_by_device(store.facts("reading")), "device", "ingested") == [
        ("d", 2), ("e", 1),
    ]


def test_incremental_sweeps(spark, store):
    ingest_batch(store, raw(spark, series_of("d", [22.0] * 25)), 0)
    assert sweep(store, TEMP) and not sweep(store, TEMP)
    more = series_of("d", [22.0] * 3 + [50.0], START + timedelta(seconds=50))
    ingest_batch(store, raw(spark, more, first=25), 1)
    assert sweep(store, TEMP) and not sweep(store, TEMP)
    trail = store.stages()
    assert trail.filter("stage = 'evaluated'").count() == 29
    assert trail.filter("stage = 'evaluated'").select("reading_id").distinct().count() == 29
    assert detect.unevaluated(store.facts("reading"), trail).isEmpty()
    assert rows_of(store.facts("anomaly"), "type", "severity") == [("spike", "warn")]
    state = store.state("evaluated").first()
    assert state.n == 29 and len(state.tail) == 29

    flagged = store.facts("anomaly").first().reading_id
    path = investigate.genealogy(store.facts("reading"), trail, flagged)
    assert [r.stage for r in path.collect()] == ["ingested", "validated", "enriched", "evaluated"]


def test_micro_batches_equal_one_batch(spark, tmp_path):
    values = [22.0 + (i % 7) * 0.1 for i in range(60)]
    values[30], values[45], values[59] = 99.0, 24.9, 26.0
    messages = [
        m
        for pair in zip(series_of("a", values), series_of("b", values[::-1]), strict=True)
        for m in pair
    ]
    results = []
    for parts in (1, 3):
        store = Store(spark, str(tmp_path / f"s{parts}"), snapshot_every=2)
        size = len(messages) // parts
        for i in range(parts):
            ingest_batch(
                store, raw(spark, messages[i * size : (i + 1) * size], first=i * size), i
            )
            sweep(store, TEMP)
        points = store.facts("anomaly").filter("reading_id is not null")
        results.append(
            (
                rows_of(points, "device", "type", "reading_id", "detail"),
                rows_of(store.stages(), "reading_id", "stage", "status", "detail"),
                rows_of(store.state("device"), "device", "kind"),
                rows_of(store.state("heartbeat"), "device", "last_seen_at", "last_offset"),
                rows_of(store.state("series"), "device", "metric", "n"),
                rows_of(store.state("evaluated"), "device", "metric", "n", "tail"),
            )
        )
    assert results[0] == results[1]
    assert len(results[0][0]) >= 2


def test_late_readings_get_their_true_window(spark, store):
    """Both a late reading inside the state's reach and one far behind it."""
    small = Settings(limits=TEMP.limits, spike_window=3, drift_window=2, gap_lookback=4)
    assert small.tail_rows == 5
    values = [20.0 + i for i in range(12)]
    ingest_batch(store, raw(spark, series_of("d", values, step=10)), 0)
    sweep(store, small)
    late = [
        message("d", 40.0, START + timedelta(seconds=45)),  # far behind the five newest
        message("d", 41.0, START + timedelta(seconds=105)),  # within reach
        message("d", 42.0, START + timedelta(seconds=200)),  # new
    ]
    ingest_batch(store, raw(spark, late, first=12), 1)
    sweep(store, small)
    everything = store.facts("reading")
    whole = series.rolling_stats(everything, 3, None).filter("source_offset >= 12")
    want = {r.reading_id: (round(r.mean, 3), round(r.std, 3)) for r in whole.collect()}
    enriched = store.stages().filter("stage = 'enriched'").collect()
    got = {r.reading_id: json.loads(r.detail) for r in enriched if r.reading_id in want}
    assert {k: (v["mean"], v["std"]) for k, v in got.items()} == want
    state = store.state("evaluated").first()
    assert state.n == 15 and [t.value for t in state.tail] == [29.0, 30.0, 41.0, 31.0, 42.0]


def test_window_rules_over_sweeps(spark, store):
    ingest_batch(store, raw(spark, series_of("d", [30.0] * 30) + series_of("e", [22.0] * 3)), 0)
    sweep(store, TEMP)
    resumed = series_of("d", [30.0], START + timedelta(seconds=600))
    ingest_batch(store, raw(spark, resumed, first=50), 1)
    sweep(store, TEMP)
    sweep(store, TEMP, all_series=True)
    assert rows_of(store.facts("anomaly"), "device", "type") == [("d", "drift"), ("d", "offline_gap")]
    gap = store.facts("anomaly").filter("type = 'offline_gap'").first()
    assert json.loads(gap.detail) == {"gap_seconds": 542.0}


def test_rollup_refresh_and_read_side(spark, store):
    ingest_batch(store, raw(spark, series_of("d", [1.0, 2.0, 3.0], step=1800)), 0)
    assert refresh_rollup(store) and not refresh_rollup(store)
    ingest_batch(store, raw(spark, [message("d", 9.0, START + timedelta(minutes=10))], 3), 1)
    refresh_rollup(store)
    got = rows_of(read_rollup(store), "hour", "avg_value", "min_value", "max_value", "n")
    naive = START.replace(tzinfo=None)
    assert got == [
        (naive, 4.0, 1.0, 9.0, 3), (naive + timedelta(hours=1), 3.0, 3.0, 3.0, 1),
    ]
    assert read_rollup(store, (naive + timedelta(hours=1)).isoformat(" ")).count() == 1

    sweep(store, TEMP)
    rows = fleets.fleet(
        store.state("device"), store.latest(), store.state("heartbeat"),
        store.facts("anomaly"), START + timedelta(minutes=61),
    ).first()
    assert (rows.device, rows.metric, rows.unit, rows.last_value) == ("d", M, "C", 3.0)
    assert rows.status == "offline" and rows.open_anomalies == 2
    assert fleets.consumers(store.state("offsets")).first().last_offset == 3


def test_incremental_reads_name_only_new_folders(spark, store):
    for i in range(4):
        at = START + timedelta(days=i)
        ingest_batch(store, raw(spark, series_of("d", [1.0], at), first=i), i)
    assert store.head(INGEST).seq == 4 and store.head(INGEST).snapshot_seq == 3
    files = store.facts("reading", after=3, upto=4).inputFiles()
    assert files and all("/seq=4/" in name for name in files)
    assert all("/seq=3/" in n or "/seq=4/" in n for n in store.state("series").inputFiles())
    assert store.state("series").first().n == 4
    assert rows_of(store.latest(), "value", "unit", "sampled_at") == [
        (1.0, "C", (START + timedelta(days=3)).replace(tzinfo=None))
    ]
    day = store.facts("reading", days=lambda day: day == F.lit("2026-01-02").cast("date"))
    assert all("/seq=2/day=2026-01-02/" in n for n in day.inputFiles()) and day.count() == 1
    assert store.facts("reading", days=lambda day: day < F.lit("2026-01-01").cast("date")).isEmpty()


def test_one_rule_for_rejects(spark, store):
    """Rejected readings are in no rollup, stored or on the fly, and no rule judges them."""
    sent = series_of("d", [22.0, 23.0]) + [message("d", 99.0, START + timedelta(seconds=30), unit="")]
    ingest_batch(store, raw(spark, sent), 0)
    sweep(store, TEMP)
    refresh_rollup(store)
    stored = store.facts("reading")
    assert stored.filter("reject_reason is not null").count() == 1
    assert detect.evaluate_points(stored, TEMP).count() == 2
    assert store.facts("anomaly").isEmpty()
    fly = rows_of(investigate.hourly_since(stored, START), "n", "avg_value")
    assert fly == rows_of(read_rollup(store), "n", "avg_value") == [(2, 22.5)]


def test_rollup_keeps_one_row_per_hour(spark, store):
    values = series_of("d", [20.0 + i for i in range(8)], step=10)
    for number in range(4):
        ingest_batch(store, raw(spark, values[2 * number : 2 * number + 2], first=2 * number), number)
        refresh_rollup(store)
    assert rows_of(read_rollup(store), "n", "min_value", "max_value") == [(8, 20.0, 27.0)]
    late = series_of("d", [5.0], START - timedelta(days=2))
    ingest_batch(store, raw(spark, late, first=50), 4)
    refresh_rollup(store)
    assert sorted(r.n for r in read_rollup(store).collect()) == [1, 8]


def test_refresh_that_died_half_way_is_repeated(spark, store, monkeypatch):
    """Days swapped in before the refresh was committed do not add their batch again."""
    ingest_batch(store, raw(spark, series_of("d", [20.0, 21.0], step=10)), 0)
    refresh_rollup(store)
    more = series_of("d", [30.0], START + timedelta(minutes=1)) + series_of("d", [40.0], START + timedelta(days=1))
    ingest_batch(store, raw(spark, more, first=10), 1)
    commit = store.commit
    monkeypatch.setattr(store, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        refresh_rollup(store)
    monkeypatch.setattr(store, "commit", commit)
    late = series_of("d", [50.0], START + timedelta(minutes=2))
    ingest_batch(store, raw(spark, late, first=20), 2)
    assert refresh_rollup(store)
    assert sorted(rows_of(read_rollup(store), "n", "max_value")) == [(1, 40.0), (4, 50.0)]
    plan = read_rollup(store, START + timedelta(days=1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_series_shorter_than_its_window_does_not_read_all_days(spark, store):
    small = Settings(limits=TEMP.limits, spike_window=3, drift_window=2, gap_lookback=4)
    for day in range(5):
        start = START + timedelta(days=day)
        sent = series_of("d", [22.0] * 6, start) + (series_of("e", [22.0] * 5, start) if day == 3 else [])
        ingest_batch(store, raw(spark, sent, first=20 * day), day)
        sweep(store, small)
        refresh_rollup(store)
    late = series_of("e", [30.0], START + timedelta(days=2))
    ingest_batch(store, raw(spark, late, first=200), 5)
    fresh = store.refresh().facts("reading", after=5).withColumn("fresh", F.lit(True))
    context, from_history = sweeps_module._context(store, fresh, 5, small)
    assert from_history
    assert {str(r.sampled_at.date()) for r in context.collect()} == {str((START + timedelta(days=3)).date())}


def test_late_readings_read_only_the_days_they_need(spark, store):
    small = Settings(limits=TEMP.limits, spike_window=3, drift_window=2, gap_lookback=4)
    for day in range(6):
        start = START + timedelta(days=day)
        ingest_batch(store, raw(spark, series_of("d", [22.0 + day] * 6, start), first=10 * day), day)
        sweep(store, small)
        refresh_rollup(store)
    late = series_of("d", [61.0], START + timedelta(days=3, hours=2))
    ingest_batch(store, raw(spark, late, first=99), 6)
    fresh = store.refresh().facts("reading", after=6).withColumn("fresh", F.lit(True))
    context, from_history = sweeps_module._context(store, fresh, 6, small)
    assert from_history
    days = {str(r.sampled_at.date()) for r in context.collect()}
    assert min(days) == str((START + timedelta(days=2)).date())
    assert sweep(store, small, max_rows=4)
    found = store.facts("anomaly").filter("reading_id is not null and type = 'out_of_range'")
    assert found.count() == 1
    trail = store.stages().filter("stage = 'enriched'").join(found.select("reading_id"), "reading_id")
    # its window: three readings of its own day, 25 each, and itself
    assert '"mean":34.0' in trail.first().detail


def test_lag_of_very_late_messages_is_not_spread_over_readings(spark):
    from fleetlens.plans import quality

    rows = [(START, START + timedelta(minutes=m)) for m in (0, 3, 3, 90, 60 * 24 * 40)]
    got = quality.in_flight(spark.createDataFrame(rows, "sampled_at timestamp, ingested_at timestamp"))
    lags = {r.minute: r.lag for r in got.collect()}
    naive = START.replace(tzinfo=None)
    want = {naive + timedelta(minutes=m): sum(late >= m for late in (3, 3, 90, 60 * 24 * 40)) for m in range(1, 60 * 24 * 40 + 1)}
    assert lags == want


def test_few_files_however_many_shuffle_partitions(spark, store):
    sent = [m for n in range(60) for m in series_of(f"d{n}", [22.0] * 3 + [90.0])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ingest_batch(store, raw(spark, sent), 0)
        sweep(store, Settings(limits=TEMP.limits))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for name, kinds in (("sweep_stage", 2), ("anomaly", 4)):
        files = list(Path(store.root, name).rglob("*.parquet"))
        assert len(files) <= 8 * kinds, name
    assert store.facts("sweep_stage").count() == 2 * 240
    assert store.facts("anomaly").filter("type = 'out_of_range'").count() == 60
    assert not any(Path(store.root, "staging").iterdir())


def test_text_of_unusable_messages_only_is_cached(spark, store, monkeypatch):
    import fleetlens.streaming.ingest as ingests

    cached = []
    first = ingests._first_arrivals
    monkeypatch.setattr(ingests, "_first_arrivals", lambda s, m: cached.extend(m.collect()) or first(s, m))
    ingest_batch(store, raw(spark, [*series_of("d", [22.0] * 3), "{no json"]), 0)
    assert sorted(str(r.raw_value) for r in cached) == ["None"] * 3 + ["{no json"]
    assert [r.raw_value for r in store.facts("quarantine").collect()] == ["{no json"]
