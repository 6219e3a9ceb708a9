"""Schemas of the tables and the mapping of generic event tables onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Names and types of the record formats.
WIRE = (
    "device_external_id string, device_kind string, metric string, value double, unit string, "
    "sampled_at string, location string, firmware string"
)
RAW = "key string, value string, topic string, partition int, offset bigint"
DEVICE = "device string, kind string, location string, firmware string"
READING = (
    "reading_id string, device string, metric string, value double, unit string, "
    "sampled_at timestamp, ingested_at timestamp, source_topic string, source_partition int, "
    "source_offset bigint, reject_reason string"
)
STAGE = "reading_id string, stage string, status string, detail string, at timestamp"
ANOMALY = (
    "anomaly_id string, device string, metric string, reading_id string, type string, "
    "severity string, detail string, detected_at timestamp, resolved_at timestamp, "
    "reading_day date"
)
HEARTBEAT = "device string, last_seen_at timestamp, last_offset bigint"
CHECKPOINT = "device string, metric string, last_sampled_at timestamp, updated_at timestamp"
OFFSETS = "consumer string, topic string, partition int, last_offset bigint, updated_at timestamp"


# Schemas of the generated tables in use; stating them saves reading footers twice.
GENERATED = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(GENERATED[name]).parquet(f"{folder}/{name}.parquet")


def events_as_readings(
    spark: SparkSession, folder: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """The event table read as sensor readings: user = device, event type = metric.

    Event ids ascend with time, so they serve as reading id and as stream offset. The
    optional inclusive bounds are compared with the stored column itself, so the scan
    can skip row groups by their statistics.
    """
    rows = table(spark, folder, "events")
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return rows.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("device"),
        F.col("event_type").alias("metric"),
        "value",
        F.col("ts").cast("timestamp").alias("sampled_at"),
    )


def customers_as_devices(spark: SparkSession, folder: str) -> DataFrame:
    """The customer table read as devices: segment = kind, nation = location."""
    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("device"),
        F.col("c_mktsegment").alias("kind"),
        F.col("n_name").alias("location"),
    )
