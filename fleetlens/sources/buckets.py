"""Tables stored in buckets of a key, so that joins on it need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_bucketed(rows: DataFrame, name: str, folder: str, key: str, buckets: int) -> DataFrame:
    """Write a table in so many buckets of the key, sorted by it, and return it.

    Rows are dealt by the hash that buckets use, so each bucket is one file. Two tables
    with the same number of buckets join on the key file by file; a filter on one key
    reads one file of each.
    """
    dealt = rows.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", folder)
    writer.saveAsTable(name)
    return rows.sparkSession.table(name)
