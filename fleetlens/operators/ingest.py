"""Ingest as set operations: first arrivals, keyed state, stage rows, batch counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.functions.expressions import reject_reason, timestamp_at
from fleetlens.operators.detect import INGESTED, OK, REJECT, VALIDATED

NATURAL_KEY = ("device", "metric", "sampled_at")
CONSUMER = "ingester"  # fixed value: name of the default consumer


def first_arrivals(
    rows: DataFrame,
    key: Sequence[str] = NATURAL_KEY,
    order: Sequence[str] = ("source_partition", "source_offset"),
) -> DataFrame:
    """One row per key: the one that arrived first.

    Spark limits each group to one row inside the scan tasks, so a message delivered a
    billion times crosses the shuffle once per task.
    """
    arrival = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_arrival", arrival).filter(F.col("_arrival") == 1).drop("_arrival")


def unseen(rows: DataFrame, stored: DataFrame, key: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*key), list(key), "left_anti")


def with_validation(rows: DataFrame) -> DataFrame:
    """Add `reject_reason`; rejected readings are kept, not dropped."""
    reason = reject_reason(F.col("value"), F.col("metric"), F.col("unit"))
    return rows.withColumn("reject_reason", reason)


def ingest_stages(readings: DataFrame, at) -> DataFrame:
    """The `ingested` and `validated` rows of the trail, two per stored reading."""
    reason = F.col("reject_reason")
    refused = F.to_json(F.struct(reason.alias("reason")))
    stage = F.inline(
        F.array(
            F.struct(
                F.lit(INGESTED).alias("stage"),
                F.lit(OK).alias("status"),
                F.to_json(F.struct(F.col("source_offset").alias("offset"))).alias("detail"),
            ),
            F.struct(
                F.lit(VALIDATED).alias("stage"),
                F.when(reason.isNull(), OK).otherwise(REJECT).alias("status"),
                F.when(reason.isNull(), "{}").otherwise(refused).alias("detail"),
            ),
        )
    )
    return readings.select("reading_id", stage, timestamp_at(at).alias("at"))


def newest_device_attributes(messages: DataFrame, order: str = "source_offset") -> DataFrame:
    """Per device the last kind, and the last location and firmware that were given."""
    known = {
        name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name)
        for name in ("location", "firmware")
    }
    return messages.groupBy("device").agg(F.max_by("kind", order).alias("kind"), *known.values())


def upsert_devices(devices: DataFrame, newest: DataFrame) -> DataFrame:
    """New devices are added; known ones take the new kind and any given attribute."""
    old = devices.select("device", *[F.col(c).alias(f"_{c}") for c in ("kind", "location", "firmware")])
    merged = old.join(newest, "device", "full_outer")
    return merged.select(
        "device",
        *[F.coalesce(c, f"_{c}").alias(c) for c in ("kind", "location", "firmware")],
    )


def heartbeats(readings: DataFrame, order: str = "source_offset") -> DataFrame:
    """The last stored message of each device, even if its clock ran backwards."""
    return readings.groupBy("device").agg(
        F.max_by("sampled_at", order).alias("last_seen_at"), F.max(order).alias("last_offset")
    )


def consumer_offsets(raw: DataFrame, at, consumer: str = CONSUMER) -> DataFrame:
    """The last offset seen per partition; duplicates and unusable messages count too."""
    newest = raw.groupBy("topic", "partition").agg(F.max("offset").alias("last_offset"))
    return newest.select(
        F.lit(consumer).alias("consumer"),
        "topic",
        "partition",
        "last_offset",
        timestamp_at(at).alias("updated_at"),
    )


def series_checkpoints(readings: DataFrame, at) -> DataFrame:
    """The newest reading time per series."""
    newest = readings.groupBy("device", "metric").agg(F.max("sampled_at").alias("last_sampled_at"))
    return newest.withColumn("updated_at", timestamp_at(at))


def ingested_by_device(readings: DataFrame) -> DataFrame:
    """Accepted readings per device."""
    accepted = readings.filter(F.col("reject_reason").isNull())
    return accepted.groupBy("device").agg(F.count(F.lit(1)).alias("ingested"))
