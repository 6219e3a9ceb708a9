"""Storing one micro-batch of messages so that a replay changes nothing."""

from __future__ import annotations

from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.expressions import reading_key
from fleetlens.operators import ingest
from fleetlens.operators.sizes import broadcast_if_small
from fleetlens.sources import wire
from fleetlens.sources.store import INGEST, STATS, Store, utc_now
from fleetlens.streaming import together

KEY = list(ingest.NATURAL_KEY)


def ingest_batch(
    store: Store,
    raw: DataFrame,
    batch_id: int,
    consumer: str = ingest.CONSUMER,
    now: datetime | None = None,
    origin: str | None = None,
) -> bool:
    """Store a batch of raw messages; False if it had been stored before.

    Serves streams (as the body of `foreachBatch`) and bulk backfills alike. The batch
    becomes visible in one step at the end, and the source's offsets are acknowledged
    only after this function returns: stored first, acknowledged second. Batches are
    numbered per `origin`, the consumer unless a stream names itself.
    """
    origin = origin or consumer
    if store.refresh().is_committed(INGEST, origin, batch_id):
        return False
    now = now or utc_now()
    head = store.head(INGEST)
    seq = head.seq + 1
    # Parsed once, and spilled to disk by the executors; after the loss of one, Spark
    # reads the same offsets from the source again. Only of unusable ones the text is kept.
    messages = wire.decode(raw)
    unusable = F.col("quarantine_reason").isNotNull()
    messages = messages.withColumn("raw_value", F.when(unusable, F.col("raw_value")))
    messages = messages.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        marked = store.stage("arrivals", _first_arrivals(store, messages))
        days = _store(store, messages, marked, head.seq, seq, consumer, now)
    finally:
        store.unstage("arrivals")
        messages.unpersist()
    store.commit(INGEST, seq, origin, batch_id, now, days=days)
    return True


def _first_arrivals(store: Store, messages: DataFrame) -> DataFrame:
    """First arrival per natural key, next to the newest stored time of its series."""
    usable = messages.filter(F.col("quarantine_reason").isNull())
    first = ingest.first_arrivals(usable.drop("raw_value", "quarantine_reason"))
    known = store.state("series", ("last_sampled_at",))
    return ingest.with_validation(first).join(known, ["device", "metric"], "left")


def _store(
    store: Store, messages: DataFrame, marked: DataFrame, last: int, seq: int, consumer: str, now
) -> list:
    """Write all tables of the batch; answers the days its readings fall on."""
    usable = messages.filter(F.col("quarantine_reason").isNull())
    at = F.lit(now).cast("timestamp")

    new = _not_stored(store, marked).select(
        reading_key(F.col("device"), F.col("metric"), F.col("sampled_at")).alias("reading_id"),
        *KEY,
        "value",
        "unit",
        at.alias("ingested_at"),
        "source_topic",
        "source_partition",
        "source_offset",
        "reject_reason",
        F.to_date("sampled_at").alias("day"),
    )
    # Contiguous ranges: few files per day whatever the batch spans, a hot device is
    # spread over tasks, and narrow statistics let scans skip row groups.
    layout = ["day", "metric", "device", "sampled_at"]
    store.write_facts(
        "reading", seq, new.repartitionByRange(*layout).sortWithinPartitions(*layout)
    )
    # Everything below starts from the rows as written, not from a second computation.
    stored = store.facts("reading", after=last, upto=seq)

    unusable = messages.filter(F.col("quarantine_reason").isNotNull())
    unusable = unusable.withColumnRenamed("quarantine_reason", "reason").withColumn("at", at)
    attributes = ingest.newest_device_attributes(usable)
    known = store.state("device").join(attributes.select("device"), "device", "left_semi")
    devices = ingest.upsert_devices(known, attributes)
    offsets = ingest.consumer_offsets(
        messages.select(
            F.col("source_topic").alias("topic"),
            F.col("source_partition").alias("partition"),
            F.col("source_offset").alias("offset"),
        ),
        at,
        consumer,
    )
    *_, days = together(
        lambda: store.write_facts("ingest_stage", seq, ingest.ingest_stages(stored, at)),
        lambda: store.write_facts("quarantine", seq, unusable),
        lambda: store.write_state("device", seq, devices),
        lambda: store.write_state("heartbeat", seq, ingest.heartbeats(stored)),
        lambda: store.write_state("series", seq, _series(store, stored, at)),
        lambda: store.write_state("offsets", seq, offsets),
        lambda: _write_stats(store, seq, messages, stored, consumer, now),
    )
    return days


def _write_stats(store: Store, seq: int, messages: DataFrame, stored: DataFrame, consumer: str, now):
    """One row of counts per batch; answers the days of the stored readings."""
    counts = messages.agg(
        F.count(F.lit(1)).alias("arrived"), F.count("quarantine_reason").alias("quarantined")
    ).first()
    kept = stored.agg(
        F.count(F.lit(1)).alias("stored"),
        F.count("reject_reason").alias("rejected"),
        F.collect_set("day").alias("days"),
    ).first()
    row = store.one_row(
        STATS,
        arrived=counts.arrived,
        stored=kept.stored,
        duplicates=counts.arrived - counts.quarantined - kept.stored,
        rejected=kept.rejected,
        quarantined=counts.quarantined,
        consumer=consumer,
        at=now,
    )
    store.write_facts("batch_stats", seq, row)
    return kept.days


def _not_stored(store: Store, marked: DataFrame) -> DataFrame:
    """Drop readings that an earlier batch stored.

    A reading newer than everything stored of its series cannot be a duplicate, so in
    steady state nothing is looked up. Only the others are compared with the stored
    readings of their days.
    """
    old = F.coalesce(F.col("sampled_at") <= F.col("last_sampled_at"), F.lit(False))
    fresh = marked.filter(~old).drop("last_sampled_at")
    suspects = marked.filter(old).drop("last_sampled_at")
    days = [row.day for row in suspects.select(F.to_date("sampled_at").alias("day")).distinct().collect()]
    if not days:
        return fresh
    stored = store.facts("reading", days=lambda day: day.isin(days)).select(*KEY)
    repeated = stored.join(broadcast_if_small(suspects.select(*KEY)), KEY, "left_semi")
    return fresh.unionByName(ingest.unseen(suspects, repeated))


def _series(store: Store, stored: DataFrame, at) -> DataFrame:
    """New state of the series this batch added readings to."""
    added = stored.groupBy("device", "metric").agg(
        F.max_by(F.struct("sampled_at", "value", "unit"), "sampled_at").alias("_new"),
        F.count(F.lit(1)).alias("_n"),
    )
    old = store.state("series", ("last_sampled_at", "value", "unit", "n"))
    merged = added.join(old, ["device", "metric"], "left")
    newer = F.coalesce(F.col("_new.sampled_at") > F.col("last_sampled_at"), F.lit(True))
    return merged.select(
        "device",
        "metric",
        F.when(newer, F.col("_new.sampled_at")).otherwise(F.col("last_sampled_at")).alias(
            "last_sampled_at"
        ),
        *[F.when(newer, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("value", "unit")],
        (F.coalesce("n", F.lit(0)) + F.col("_n")).alias("n"),
        at.alias("updated_at"),
    )
