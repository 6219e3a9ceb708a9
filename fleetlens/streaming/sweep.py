"""Incremental evaluation of everything ingested since the last sweep, in one job.

The state of a series is its newest readings, as many as any rule looks back on. A
sweep joins the new readings with the state of the series they belong to. A reading so
late that the state does not reach back to its window has its series looked up in the
history, on the days that hold its window; such a series is cut into slices like any
other that is too long for one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.config import Settings
from fleetlens.operators import detect
from fleetlens.operators.series import (
    MAX_ROWS,
    SERIES,
    hot_series,
    newest,
    rolling_stats,
    rows_to_check,
)
from fleetlens.sources.store import INGEST, ROLLUP, SWEEP, Store, utc_now
from fleetlens.streaming import together
from fleetlens.streaming.rollup import rollup_by_day

_CONSUMER = "processor"
_WINDOW_RULES = (detect.DRIFT, detect.OFFLINE_GAP)


def sweep(
    store: Store,
    settings: Settings,
    now: datetime | None = None,
    all_series: bool = False,
    max_rows: int | None = MAX_ROWS,
) -> bool:
    """Evaluate all new readings; False if there are none.

    Drift and gaps are re-checked for the series with new readings. The answer for the
    others cannot have changed unless someone resolved their anomaly; `all_series`
    re-checks them as well.
    """
    store.refresh()
    head, last = store.head(SWEEP), store.head(INGEST).seq
    if head.read_upto >= last and not all_series:
        return False
    now = now or utc_now()
    seq = head.seq + 1
    fresh = store.facts("reading", after=head.read_upto, upto=last)
    fresh_rows = fresh
    fresh = detect.evaluable(fresh)
    fresh = detect.with_limits(fresh, settings).select("reading_id", *SERIES, "sampled_at", "value")
    fresh = fresh.withColumn("fresh", F.lit(True))
    context, from_history = _context(store, fresh, head.read_upto, settings)
    rows = fresh.unionByName(context, allowMissingColumns=True)
    if max_rows is not None and not from_history:
        # with the state, a series has at most its new readings and its tail
        max_rows = rows_to_check(fresh_rows, max_rows - settings.tail_rows)
    if hot_series(rows, max_rows) is None:  # asked once for both windows over the rows
        max_rows = None

    stats = rolling_stats(rows, settings.spike_window, max_rows).filter("fresh").drop("fresh")
    try:
        judged = store.stage("judged", detect.judge(detect.with_limits(stats, settings)))
        together(
            lambda: store.write_facts("sweep_stage", seq, detect.evaluation_stages(judged, now)),
            lambda: store.write_state(
                "evaluated", seq, _state(store, rows, settings, now, max_rows)
            ),
        )
        points = detect.point_anomalies(judged, now)
        windows = _window_rules(store, settings, seq, now, all_series)
        store.write_facts("anomaly", seq, _with_id(points.unionByName(windows), seq))
    finally:
        store.unstage("judged")
    store.commit(SWEEP, seq, _CONSUMER, seq, now, read_upto=last)
    return True


def _context(
    store: Store, fresh: DataFrame, read_upto: int, settings: Settings
) -> tuple[DataFrame, bool]:
    """Earlier readings that the windows of the fresh ones reach back to.

    Normally these come from the state. A reading that arrived so late that the state
    no longer covers its window is judged against its true predecessors as well: the
    few series concerned are read from the stored history, which the second result tells.
    """
    state = store.state("evaluated", ("n", "tail")).join(
        fresh.select(*SERIES).distinct(), list(SERIES), "left_semi"
    )
    window = settings.spike_window
    covered_from = F.get(F.col("tail"), F.lit(window - 1))["sampled_at"]
    # a full tail counts as cut, also where its series has not one reading more
    cut = (F.col("n") > F.size("tail")) | (F.size("tail") >= settings.tail_rows)
    partial = state.filter(cut).select(*SERIES, covered_from.alias("_from"))
    very_late = (
        fresh.join(partial, list(SERIES))
        .filter(F.col("sampled_at") <= F.col("_from"))
        .groupBy(*SERIES)
        .agg(F.to_date(F.min("sampled_at")).alias("_first"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        if very_late.isEmpty():
            return _unpack(state), False
        days = _days_before(store, very_late, read_upto, window)
    finally:
        very_late.unpersist()
    chosen = None if days is None else lambda day: day.isin(days)
    history = detect.evaluable(store.facts("reading", upto=read_upto, days=chosen))
    series = very_late.select(*SERIES)
    history = history.join(series, list(SERIES), "left_semi")
    return _unpack(state.join(series, list(SERIES), "left_anti")).unionByName(
        history.select(*SERIES, "sampled_at", "value", F.lit(False).alias("fresh"))
    ), True


def _days_before(store: Store, very_late: DataFrame, read_upto: int, window: int) -> list | None:
    """The days to read so that every late reading has `window` predecessors.

    The stored rollup counts readings per hour; going back day by day from the day
    before a series' first late reading, the window is full once the counts add up to
    it. Of a series that never had so many, the days it has readings on are read. None,
    for all days, while the rollup is behind the sweep.
    """
    if store.head(ROLLUP).read_upto < read_upto:
        return None
    counts = rollup_by_day(store).groupBy(*SERIES, "day").agg(F.sum("n").alias("n"))
    known = counts.join(very_late, list(SERIES))
    backwards = Window.partitionBy(*SERIES).orderBy(F.col("day").desc())
    before = F.when(F.col("day") < F.col("_first"), F.col("n"))
    summed = known.withColumn("_n", F.sum(before).over(backwards))
    starts = summed.groupBy(*SERIES).agg(F.max(F.when(F.col("_n") >= window, F.col("day"))).alias("_start"))
    needed = known.join(starts, list(SERIES)).filter(F.col("_start").isNull() | (F.col("day") >= F.col("_start")))
    return [row.day for row in needed.select("day").distinct().collect()]  # calendar days


def _unpack(state: DataFrame) -> DataFrame:
    return state.select(*SERIES, F.inline("tail"), F.lit(False).alias("fresh"))


def _state(store: Store, rows: DataFrame, settings: Settings, now, max_rows: int | None) -> DataFrame:
    """New state of the touched series: their newest readings and their count."""
    tails = (
        newest(rows, settings.tail_rows, max_rows)
        .groupBy(*SERIES)
        .agg(F.sort_array(F.collect_list(F.struct("sampled_at", "value"))).alias("tail"))
    )
    added = rows.filter("fresh").groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_added"))
    before = store.state("evaluated", ("n",)).withColumnRenamed("n", "_n")
    return (
        tails.join(added, list(SERIES))
        .join(before, list(SERIES), "left")
        .select(
            *SERIES,
            F.element_at("tail", -1)["sampled_at"].alias("last_sampled_at"),
            (F.coalesce("_n", F.lit(0)) + F.col("_added")).alias("n"),
            "tail",
            F.lit(now).cast("timestamp").alias("updated_at"),
        )
    )


def _window_rules(store: Store, settings: Settings, seq: int, now, all_series: bool) -> DataFrame:
    """Drift and gap anomalies from the state just written, behind the guard."""
    state = store.state_with(seq, "evaluated") if all_series else store.written("evaluated", seq)
    tails = state.select(*SERIES, F.inline("tail"))
    # at most `tail_rows` readings per series, so no series needs slicing
    found = detect.window_anomalies(detect.series_condition(tails, settings, None), settings, now)
    raised = store.facts("anomaly").filter(F.col("type").isin(*_WINDOW_RULES))
    return detect.guard(found, raised)


def _with_id(anomalies: DataFrame, seq: int) -> DataFrame:
    parts = [F.col(name).cast("string") for name in ("device", "metric", "type")]
    cause = F.coalesce("reading_id", F.lit(f"sweep {seq}"))
    return anomalies.withColumn("anomaly_id", F.md5(F.concat_ws("\u0000", *parts, cause)))
