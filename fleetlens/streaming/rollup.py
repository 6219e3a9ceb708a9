"""The stored hourly rollup: one row per series and hour, refreshed from new readings only.

A plain Parquet table in folders by day. A refresh writes the days anew that new
readings fall on: merged with what is stored of them, staged, and swapped in by Spark's
dynamic partition overwrite, which leaves all other days alone. Each row names the last
ingest batch in its day, so a refresh that died between the swap of a day and its end is
simply repeated: a day that has a batch already does not add it again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators.detect import evaluable
from fleetlens.operators.rollup import hourly, merge_hourly
from fleetlens.sources.store import INGEST, ROLLUP, Store, utc_now

SCHEMA = (
    "device string, metric string, hour timestamp, avg_value double, min_value double, "
    "max_value double, n bigint, sum_value double, upto bigint, day date"
)
_CONSUMER = "rollup"


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def overwrite_days(rows: DataFrame, folder: str, staging: str) -> None:
    """Replace the days that `rows` have in a table by day; rows may be read from the table."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(folder)


def add_batches(table: str, staging: str, readings: DataFrame, upto: int) -> None:
    """Add the batches up to number `upto` to the rollup in a folder.

    readings have the number of their batch as seq. Days that hold a batch already
    leave it out, so batches may be offered again.
    """
    spark = readings.sparkSession
    usable = evaluable(readings).withColumn("day", F.to_date("sampled_at"))
    # Calendar days of the new batches, a handful.
    days = [row.day for row in usable.select("day").distinct().collect()]
    before = _stored(spark, table).filter(F.col("day").isin(days))
    done = before.groupBy("day").agg(F.max("upto").alias("_upto"))
    new = usable.join(F.broadcast(done), "day", "left").filter(F.col("seq") > F.coalesce("_upto", F.lit(0)))
    fresh = hourly(new)
    merged = merge_hourly(before.select(fresh.columns).unionByName(fresh))
    rows = merged.withColumn("upto", F.lit(upto).cast("long")).withColumn("day", F.to_date("hour"))
    overwrite_days(rows.repartitionByRange("day", "metric", "device"), table, staging)


def refresh_rollup(store: Store, now: datetime | None = None) -> bool:
    """Add the usable readings ingested since the last refresh; False if there are none.

    Sums, counts and extremes of disjoint readings combine, so a refresh never reads
    old readings again.
    """
    store.refresh()
    head, last = store.head(ROLLUP), store.head(INGEST).seq
    if head.read_upto >= last:
        return False
    readings = store.facts("reading", after=head.read_upto, upto=last)
    add_batches(rollup_folder(store), f"{store.root}/hourly_staging", readings, last)
    store.commit(ROLLUP, head.seq + 1, _CONSUMER, head.seq + 1, now or utc_now(), read_upto=last)
    return True


def rollup_folder(store: Store) -> str:
    return f"{store.root}/hourly"


def rollup_by_day(store: Store) -> DataFrame:
    """The rollup as stored, with the day of each row; a filter on days reads these only."""
    return _stored(store.spark, rollup_folder(store))


def read_rollup(store: Store, since=None) -> DataFrame:
    """One row per device, metric and hour; only the days asked for are read."""
    rows = rollup_by_day(store)
    if since is not None:
        since = F.lit(since).cast("timestamp")
        rows = rows.filter((F.col("day") >= F.to_date(since)) & (F.col("hour") >= since))
    return rows.drop("day", "upto")
