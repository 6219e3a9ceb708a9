"""Detection settings: windows, limits per metric, and their DataFrame form."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

try:  # YAML is optional; JSON settings always work
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

# Settings above this many metrics are joined by shuffle instead of broadcast.
BROADCAST_METRICS = 10_000

_LIMITS = pa.schema(
    [("metric", pa.string())]
    + [(name, pa.float64()) for name in ("lo", "hi", "baseline", "spike_sigma", "drift_delta")]
)

# Metric, lowest and highest valid value, baseline, spike sigma, drift delta.
DEFAULT_LIMITS = (
    ("temperature_c", -10.0, 60.0, 22.0, 4.0, 3.0),
    ("vibration_mm_s", 0.0, 20.0, 1.2, 4.0, 2.0),
    ("humidity_pct", 0.0, 100.0, 45.0, 4.0, 6.0),
    ("pressure_kpa", 80.0, 120.0, 101.0, 4.0, 2.0),
    ("flow_lpm", 0.0, 50.0, 12.4, 4.0, 4.0),
    ("current_a", 0.0, 30.0, 8.2, 4.0, 4.0),
    ("speed_rpm", 0.0, 3000.0, 1480.0, 4.0, 60.0),
    ("co2_ppm", 0.0, 5000.0, 620.0, 4.0, 150.0),
)


@dataclass(frozen=True)
class Limits:
    """What counts as abnormal for one metric."""

    metric: str
    lo: float
    hi: float
    baseline: float
    spike_sigma: float
    drift_delta: float


@dataclass(frozen=True)
class Settings:
    """Windows are counted in readings, gaps and the cycle in seconds."""

    cycle_seconds: int = 5
    drift_window: int = 30
    gap_seconds: float = 20
    spike_window: int = 20
    gap_lookback: int = 200
    limits: tuple[Limits, ...] = tuple(Limits(*row) for row in DEFAULT_LIMITS)

    def limit(self, metric: str) -> Limits | None:
        return next((item for item in self.limits if item.metric == metric), None)

    @property
    def tail_rows(self) -> int:
        """Readings per series that any detector can look back on."""
        return max(self.spike_window, self.drift_window, self.gap_lookback + 1)


def load_settings(path: str | Path) -> Settings:
    """Settings from a YAML or JSON file with a `thresholds` section per metric."""
    path = Path(path)
    text = path.read_text()
    if path.suffix == ".json":
        doc = json.loads(text)
    elif yaml is not None:
        doc = yaml.safe_load(text)
    else:
        raise RuntimeError("reading YAML settings needs the yaml module; use JSON instead")
    limits = []
    for metric, section in doc["thresholds"].items():
        lo, hi = (float(bound) for bound in section["valid_range"])
        rest = (float(section[name]) for name in ("baseline", "spike_sigma", "drift_delta"))
        limits.append(Limits(metric, lo, hi, *rest))
    windows = {name: int(doc[name]) for name in ("cycle_seconds", "drift_window", "spike_window")}
    return Settings(gap_seconds=float(doc["gap_seconds"]), limits=tuple(limits), **windows)


def limits_frame(spark: SparkSession, limits: Iterable[Limits]) -> DataFrame:
    """One row per metric; broadcast because its row count is known and checked.

    Handed over as Arrow, a small table becomes a constant of the plan.
    """
    rows = [asdict(item) for item in limits]
    frame = spark.createDataFrame(pa.Table.from_pylist(rows, schema=_LIMITS))
    return F.broadcast(frame) if len(rows) <= BROADCAST_METRICS else frame
