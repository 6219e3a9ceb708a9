from __future__ import annotations

import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetlens.session import session  # noqa: E402
from fleetlens.sources.store import Store  # noqa: E402

START = datetime(2026, 1, 1, tzinfo=UTC)
READING = "reading_id long, device string, metric string, value double, sampled_at timestamp"


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.sql.ui.retainedExecutions": "1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def store(spark, tmp_path) -> Store:
    return Store(spark, str(tmp_path / "store"), snapshot_every=2)


@pytest.fixture
def seed(spark):
    """Readings from {(device, metric): values}, two seconds apart."""

    def make(series: dict, step: float = 2.0, start: datetime = START):
        rows, number = [], 0
        for (device, metric), values in series.items():
            for i, value in enumerate(values):
                at = start + timedelta(seconds=i * step)
                rows.append((number, device, metric, float(value), at))
                number += 1
        return spark.createDataFrame(rows, READING)

    return make


def message(device, value, at, metric="temperature_c", unit="C", kind="temp-probe", **more):
    return {
        "device_external_id": device,
        "device_kind": kind,
        "metric": metric,
        "value": value,
        "unit": unit,
        "sampled_at": at.isoformat() if isinstance(at, datetime) else at,
        **more,
    }
