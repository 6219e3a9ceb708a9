from __future__ import annotations

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import READING, START
from fleetlens.operators import series


@pytest.fixture(scope="module")
def skewed(spark):
    """One series holds most readings, in bursts and with long pauses."""
    chance = random.Random(7)
    rows, number = [], 0
    for device, n in (("hot", 400), ("cold", 30), ("single", 1), ("mild", 90)):
        at = START
        for _ in range(n):
            at += timedelta(seconds=chance.choice([1, 1, 2, 5, 90, 4000]))
            rows.append((number, device, "m", round(chance.gauss(20, 5), 2), at))
            number += 1
    chance.shuffle(rows)
    return spark.createDataFrame(rows, READING).repartition(5, "reading_id").cache()


def same(left, right):
    assert left.count() == right.count()
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("most", [1, 89])
def test_sliced_windows_equal_whole_ones(skewed, most):
    assert series.hot_series(skewed, most) is not None
    for make in (series.rolling_stats, series.rolling_mean, series.gaps):
        same(make(skewed, max_rows=None), make(skewed, max_rows=most))


@pytest.mark.parametrize("n", [7, 5000])
def test_newest_equals_whole(skewed, n):
    same(series.newest(skewed, n, None), series.newest(skewed, n, 20))


def test_slices_stay_within_the_limit(skewed):
    hot = series.hot_series(skewed, 40)
    sizes = (
        series._number_slices(skewed, hot)
        .filter("_slice is not null")
        .groupBy("device", "_slice")
        .count()
        .agg(F.max("count"))
        .first()[0]
    )
    assert sizes <= 40


def test_stats_against_brute_force(skewed):
    got = {r.reading_id: r for r in series.rolling_stats(skewed, 20, 50).collect()}
    for _, rows in skewed.toPandas().sort_values("sampled_at").groupby("device"):
        values = rows.value.to_numpy()
        for i, number in enumerate(rows.reading_id):
            window = values[max(0, i - 20) : i + 1]
            assert got[number].mean == pytest.approx(window.mean(), abs=1e-9)
            assert got[number].std == pytest.approx(np.std(window), abs=1e-9)


def test_no_slicing_below_the_limit(skewed):
    assert series.hot_series(skewed, 10_000) is None
    assert series.hot_series(skewed, 400) is None
    assert series.rows_to_check(skewed, 521) is None


def test_group_limit_reaches_the_scan_side(skewed):
    plan = series.newest(skewed, 2000, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_anchor_is_null_for_short_series(spark, seed):
    rows = seed({("a", "m"): range(8), ("b", "m"): range(3)})
    marks = rows.groupBy("device", "metric").agg(F.max("sampled_at").alias("last_sampled_at"))
    got = {r.device: r.anchor for r in series.anchors(rows, marks, window=5).collect()}
    assert got["b"] is None
    assert got["a"] == (START + timedelta(seconds=4)).replace(tzinfo=None)


def test_latest_per_series_and_device(spark, seed):
    rows = seed({("a", "m"): [1.0, 2.0, 3.0], ("a", "n"): [7.0, 8.0, 9.0], ("b", "m"): [5.0]})
    latest = {(r.device, r.metric): r.value for r in series.latest_per_series(rows).collect()}
    assert latest == {("a", "m"): 3.0, ("a", "n"): 9.0, ("b", "m"): 5.0}
    per_device = {r.device: (r.metric, r.value) for r in series.latest_per_device(rows).collect()}
    assert per_device == {"a": ("n", 9.0), "b": ("m", 5.0)}  # tie: last metric by name
    changed = rows.withColumn("unit", F.when(F.col("value") > 2, "K").otherwise("C"))
    units = {(r.device, r.metric): r.unit for r in series.latest_per_series(changed).collect()}
    assert units[("a", "m")] == "K"
