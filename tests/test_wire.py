from __future__ import annotations

import json
import math
from datetime import UTC, datetime

from pyspark.sql import functions as F

from conftest import START, message
from fleetlens.sources import wire
from fleetlens.sources.tables import RAW, WIRE


def decoded(spark, *values):
    rows = [("k", value, "t", 0, i) for i, value in enumerate(values)]
    return wire.decode(spark.createDataFrame(rows, RAW)).orderBy("source_offset").collect()


def test_round_trip(spark):
    given = ("pump-7", "flow-meter", "litres_per_min", -3.75, "l/min", "2026-03-09T17:45:30.250000+00:00")
    rows = spark.createDataFrame([(*given, "hall 2", "0.9-beta"), (*given, None, None)], WIRE)
    sent = wire.encode(rows).withColumns({"partition": F.lit(2), "offset": F.lit(41).cast("long")})
    assert {r.key for r in sent.collect()} == {"pump-7"}
    assert '"location":null' in sent.filter("value like '%null%'").first().value
    back = wire.decode(sent).orderBy(F.col("location").asc_nulls_last()).collect()
    assert [(r.location, r.firmware) for r in back] == [("hall 2", "0.9-beta"), (None, None)]
    assert all(r.quarantine_reason is None and r.value == -3.75 for r in back)
    assert all(r.sampled_at == datetime(2026, 3, 9, 17, 45, 30, 250000) for r in back)
    assert {(r.source_partition, r.source_offset) for r in back} == {(2, 41)}


def test_tolerant_reader(spark):
    known = message("d1", 1.0, START)
    rows = decoded(
        spark,
        json.dumps({**known, "schema_version": 2}),
        json.dumps({**known, "value": math.nan}),
        "{not json",
        json.dumps({k: v for k, v in known.items() if k != "metric"}),
        json.dumps({**known, "value": None}),
        json.dumps({**known, "sampled_at": "yesterday"}),
        json.dumps({**known, "sampled_at": "2026-01-01T02:00:00.500000+02:00"}),
        json.dumps({**known, "unit": ""}),
        None,
    )
    assert [r.quarantine_reason for r in rows] == [
        None, None, "malformed_json", "missing_field", "missing_field", "bad_sampled_at",
        None, None, "malformed_json",
    ]
    assert rows[0].device == "d1" and rows[0].location is None
    assert math.isnan(rows[1].value)
    assert rows[6].sampled_at == datetime(2026, 1, 1, 0, 0, 0, 500000)


def test_iso_time_keeps_microseconds(spark):
    at = datetime(2026, 1, 1, 5, 6, 7, 123456, tzinfo=UTC)
    row = spark.createDataFrame([(at,)], "t timestamp").select(wire.iso_time(F.col("t"))).first()
    assert datetime.fromisoformat(row[0].replace("Z", "+00:00")) == at
