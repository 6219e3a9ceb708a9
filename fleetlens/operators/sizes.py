"""Broadcasting only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 500_000


def broadcast_if_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark narrow rows for broadcast when counting shows there are at most `most`.

    Counting stops at the bound. A larger side is left to Spark, which shuffles it.
    """
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
