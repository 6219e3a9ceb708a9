"""Intermediate rows in the checkpoint folder, in as many partitions as they are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

ROWS = 200_000


def stored(rows: DataFrame, rows_each: int = ROWS) -> DataFrame:
    """A checkpoint of narrow rows, read back in partitions of about so many, never more
    than it has; what is shuffled from few rows then comes from few tasks and files."""
    seen = Observation()
    kept = rows.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
    return kept.coalesce(1 + seen.get["n"] // rows_each)
