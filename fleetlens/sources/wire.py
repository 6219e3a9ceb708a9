"""The JSON messages devices send, and the rows Spark reads them into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.sources.tables import RAW, WIRE

TOPIC = "telemetry.readings"  # fixed value: the one topic of the pipeline

_FIELDS = [field.split()[0] for field in WIRE.split(", ")]
_REQUIRED = ("device_external_id", "device_kind", "metric", "value", "unit", "sampled_at")
_CORRUPT = "_malformed"

# Reasons for which a message cannot become a reading at all.
MALFORMED, MISSING_FIELD, BAD_TIME = "malformed_json", "missing_field", "bad_sampled_at"


def decode(raw: DataFrame) -> DataFrame:
    """Messages as typed columns plus `quarantine_reason`, null for usable ones.

    Unknown keys are dropped by the explicit schema and absent optional keys read as
    null, so producers may add fields at any time. No message is dropped and none
    fails the batch.
    """
    schema = f"{WIRE}, {_CORRUPT} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = raw.withColumn("_m", F.from_json("value", schema, options))
    message = F.col("_m")
    moment = F.try_to_timestamp(message["sampled_at"])
    missing = F.lit(False)
    for name in _REQUIRED:
        missing = missing | message[name].isNull()
    reason = (
        F.when(message.isNull() | message[_CORRUPT].isNotNull(), MALFORMED)
        .when(missing, MISSING_FIELD)
        .when(moment.isNull(), BAD_TIME)
    )
    return parsed.select(
        message["device_external_id"].alias("device"),
        message["device_kind"].alias("kind"),
        message["metric"].alias("metric"),
        message["value"].alias("value"),
        message["unit"].alias("unit"),
        moment.alias("sampled_at"),
        message["location"].alias("location"),
        message["firmware"].alias("firmware"),
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.col("value").alias("raw_value"),
        reason.alias("quarantine_reason"),
    )


def encode(messages: DataFrame, topic: str = TOPIC) -> DataFrame:
    """Rows with the wire fields as (key, value, topic), keyed by device.

    The key keeps all readings of a device in one partition, in order. Absent optional
    fields are written as JSON nulls.
    """
    payload = F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"})
    rest = [name for name in messages.columns if name not in _FIELDS]
    return messages.select(
        F.col("device_external_id").alias("key"),
        payload.alias("value"),
        F.lit(topic).alias("topic"),
        *rest,
    )


def iso_time(moment: Column) -> Column:
    """A timestamp in the wire's ISO-8601 form, with microseconds and a UTC offset."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def kafka_stream(spark: SparkSession, servers: str, topic: str = TOPIC, **options) -> DataFrame:
    """The topic from its beginning. Needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    loaded = reader.options(**options).load()
    return loaded.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset"
    )


def kafka_sink(messages: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Publish encoded messages as a batch. Needs the Kafka connector on the class path."""
    (
        messages.select("key", "value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def file_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw messages landing as JSON-lines files with topic, partition and offset."""
    reader = spark.readStream.schema(RAW)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)
