"""Time the headline queries; prints one JSON line.

All queries run once to warm up, then each runs three times and the median is reported.
Results are computed in full and thrown away by the `noop` sink. The steps that change a
store (ingest, sweep, rollup refresh) run once each, in order.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driver import queries as q
from fleetlens.session import session
from fleetlens.sources import wire
from fleetlens.sources.store import Store
from fleetlens.streaming.ingest import ingest_batch
from fleetlens.streaming.rollup import read_rollup, refresh_rollup
from fleetlens.streaming.sweep import sweep

HEADLINE = (
    "range_by_metric",
    "latest_per_series",
    "latest_per_device",
    "hourly_rollup",
    "evaluation_view",
    "evaluation_view_since",
    "bounded_eval",
    "enrich_stats",
    "evaluate_points",
    "drift_raw",
    "gap_raw",
    "anomalies_all",
    "reading_gaps",
    "series_tail",
    "rolling_full",
    "series_band",
    "device_list",
    "fleet",
    "fleet_groups",
    "pareto",
    "recent_anomalies",
    "genealogy",
    "freshness",
    "dedup_first",
    "wire_roundtrip",
    "event_rate",
    "lag_buckets",
    "missing_hours",
    "alerts",
)


def seconds(run: Callable[[], None], warm: int = 1, runs: int = 3) -> float:
    for _ in range(warm):
        run()
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 4)


def drain(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def stored(spark: SparkSession, folder: str) -> dict[str, float]:
    """Bulk ingest, the stored rollup, and an incremental sweep of one day."""
    raw = wire.encode(q.messages(spark, folder).withColumn("_at", F.to_timestamp("sampled_at")))
    last_day = F.col("_at") >= F.lit("2024-01-30 00:00:00").cast("timestamp")
    store = Store(spark, q.scratch(spark))
    out = {}

    def once(name: str, run: Callable[[], object]) -> None:
        out[name] = seconds(run, warm=0, runs=1)

    once("ingest_history", lambda: ingest_batch(store, raw.filter(~last_day), 0))
    once("sweep_history", lambda: sweep(store, q.SETTINGS))
    once("ingest_last_day", lambda: ingest_batch(store, raw.filter(last_day), 1))
    once("sweep_last_day", lambda: sweep(store, q.SETTINGS))
    once("rollup_refresh", lambda: refresh_rollup(store))
    out["rollup_stored_week"] = seconds(lambda: drain(read_rollup(store, q.WEEK_START)))
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = q.registered()
    runs = {name: (lambda name=name: drain(registered[name](spark, folder))) for name in HEADLINE}
    for run in runs.values():
        run()
    times = {name: seconds(run, warm=0) for name, run in runs.items()}
    times.update(stored(spark, folder))
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
