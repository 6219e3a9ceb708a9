"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from driver import oracle
from driver.queries import registered

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="generated tables not present")


@pytest.fixture(scope="module")
def twin():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_a_twin():
    assert set(registered()) == set(oracle.statements())


@pytest.mark.parametrize("name", sorted(registered()))
def test_same_rows(spark, twin, name):
    got = registered()[name](spark, str(FOLDER))
    columns = sorted(got.columns)
    cursor = twin.execute(oracle.statements()[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    want = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    rows = [tuple(row[c] for c in columns) for row in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["evaluate_points", "anomalies_all", "sweep_findings", "batch_equals_sweep", "pareto"])
def test_spikes_are_found(spark, name):
    """The tables hold spikes by the queries' own settings, so the twins above compare some."""
    rows = registered()[name](spark, str(FOLDER))
    kind = "type" if "type" in rows.columns else "finding"
    assert rows.filter(f"{kind} = 'spike'").count() > 0


def test_spike_details_are_filled(spark):
    rows = registered()["anomaly_details"](spark, str(FOLDER)).filter("type = 'spike'")
    assert rows.count() > 0 and rows.filter("mean_close AND sigma = 2.0").count() == rows.count()
