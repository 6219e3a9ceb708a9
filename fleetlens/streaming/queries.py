"""Structured Streaming queries around the micro-batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.config import Settings
from fleetlens.operators.ingest import CONSUMER
from fleetlens.sources.store import INGEST, Store
from fleetlens.streaming.ingest import ingest_batch
from fleetlens.streaming.rollup import refresh_rollup
from fleetlens.streaming.sweep import sweep

_COMMITS = "consumer string, batch_id bigint"


def _trigger(seconds: int | None) -> dict:
    return {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}


def start_ingest(
    raw: DataFrame,
    store: Store,
    checkpoint: str,
    seconds: int | None = 5,
    consumer: str = CONSUMER,
) -> StreamingQuery:
    """Store a raw message stream. Without `seconds`, drain the backlog and stop.

    Spark replays a micro-batch after a crash; the store recognises it by the id of the
    query and the batch, so delivery is at least once and the effect is exactly once. A
    stream that starts over with a new checkpoint has a new id: its messages are read
    again and recognised one by one.
    """
    return (
        raw.writeStream.foreachBatch(lambda rows, batch: _ingest(store, rows, batch, consumer))
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(seconds))
        .start()
    )


def _ingest(store: Store, rows: DataFrame, batch: int, consumer: str) -> None:
    query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    ingest_batch(store, rows, batch, consumer, origin=f"{consumer} {query}" if query else None)


def start_sweeps(
    store: Store, settings: Settings, checkpoint: str, seconds: int | None = None, drain: bool = False
) -> StreamingQuery:
    """Sweep and refresh the rollup whenever ingest has committed something.

    The stream watches the ingest commits, also of a store that has none yet. Batches committed while a sweep runs are
    picked up together by the next one, so a slow sweep never holds ingest back.
    """
    watched = store.spark.readStream.schema(_COMMITS).parquet(store.commit_folder(INGEST))
    every = None if drain else (seconds or settings.cycle_seconds)
    return (
        watched.writeStream.foreachBatch(lambda rows, batch: _sweep(store, settings))
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def _sweep(store: Store, settings: Settings) -> None:
    sweep(store, settings)
    refresh_rollup(store)


def stream_rate(
    rows: DataFrame, time: str, minutes: int = 1, late: str = "5 minutes", by: tuple[str, ...] = ()
) -> DataFrame:
    """Events per second in tumbling event-time windows of a stream.

    The watermark bounds the state: a window is emitted once no event older than
    `late` is expected any more.
    """
    window = F.window(F.col(time), f"{minutes} minutes")
    return (
        rows.withWatermark(time, late)
        .groupBy(window.alias("_w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("_w.start").alias("window_start"),
            *by,
            "n",
            (F.col("n") / F.lit(minutes * 60.0)).alias("per_second"),
        )
    )
