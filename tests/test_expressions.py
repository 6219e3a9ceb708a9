from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import functions as F

from fleetlens.functions import expressions as X


def test_status_ladder_and_worst(spark):
    rows = spark.createDataFrame([(6.0,), (6.1,), (60.0,), (60.5,), (None,)], "s double")
    status = [r[0] for r in rows.select(X.device_status(F.col("s"))).collect()]
    assert status == ["online", "stale", "stale", "offline", "offline"]
    worst = rows.agg(X.status_of_rank(F.max(X.status_rank(X.device_status(F.col("s")))))).first()[0]
    assert worst == "offline"


def test_reject_reasons(spark):
    cases = [
        (1.0, "m", "u", None),
        (math.nan, "m", "u", "non_finite_value"),
        (math.inf, "m", "u", "non_finite_value"),
        (-math.inf, "", "u", "non_finite_value"),
        (None, "m", "u", "non_finite_value"),
        (1.0, "", "u", "missing_metric_or_unit"),
        (1.0, "m", "", "missing_metric_or_unit"),
    ]
    rows = spark.createDataFrame(cases, "v double, m string, u string, want string")
    got = rows.select(X.reject_reason(F.col("v"), F.col("m"), F.col("u")), "want").collect()
    assert all(a == b for a, b in got)


def test_seconds_lag_and_key(spark):
    a = datetime(2026, 1, 1, 0, 0, 0, 250000, tzinfo=UTC)
    b = datetime(2026, 1, 1, 0, 0, 2, tzinfo=UTC)
    row = (
        spark.createDataFrame([(a, b)], "a timestamp, b timestamp")
        .select(
            X.seconds_between("a", "b").alias("s"),
            X.ingest_lag(F.col("b"), F.col("a")).alias("lag"),
            X.reading_key(F.lit("a"), F.lit("bc"), F.col("a")).alias("k1"),
            X.reading_key(F.lit("ab"), F.lit("c"), F.col("a")).alias("k2"),
        )
        .first()
    )
    assert row.s == 1.75 and row.lag == 0.0
    assert row.k1 != row.k2 and len(row.k1) == 32


def test_histogram_quantile(spark):
    values = [0.2] * 50 + [3.0] * 40 + [1000.0] * 10
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    bounds = X.LAG_BOUNDS_SECONDS
    counted = rows.agg(F.count("v").alias("n"), *X.bucket_counts(F.col("v"), bounds))
    q = {p: X.histogram_quantile(p, "n", bounds) for p in (0.25, 0.5, 0.7, 0.95)}
    got = counted.select(*[c.alias(str(p)) for p, c in q.items()]).first()
    assert got["0.25"] == 0.25  # half way through [0, 0.5]
    assert got["0.5"] == 0.5
    assert got["0.7"] == 3.5  # rank 70: 20 of the 40 in (2, 5]
    assert got["0.95"] == 300.0  # beyond the last finite bound
    empty = rows.limit(0).agg(F.count("v").alias("n"), *X.bucket_counts(F.col("v"), bounds))
    assert empty.select(q[0.5]).first()[0] is None
