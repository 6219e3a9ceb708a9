"""Streams whose memory is Spark's own state store: no look-up in what is stored.

State lives in RocksDB on the executors, with its changes in the stream's checkpoint, so
it survives a restart and a lost executor and may be larger than memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.config import Settings
from fleetlens.operators import detect
from fleetlens.operators.ingest import NATURAL_KEY, with_validation
from fleetlens.operators.series import SERIES
from fleetlens.sources.wire import decode

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# More make the state that a reading's bucket rewrites smaller, fewer make fewer calls.
BUCKETS = 4096
EVALUATED = (
    "device string, metric string, reading_id string, sampled_at timestamp, value double, mean double, "
    "std double, covered boolean, n long, recent_mean double, max_gap_seconds double"
)


def drained(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet folder, all that is there now, and stop.

    The file sink commits each micro-batch once, also when it is run again.
    """
    return started(rows, folder, checkpoint, None)


def started(rows: DataFrame, folder: str, checkpoint: str, seconds: int | None = 5) -> StreamingQuery:
    spark = rows.sparkSession
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the settings it was started with
    try:
        writer = rows.writeStream.format("parquet").option("path", folder)
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def first_readings(raw: DataFrame, within: str = "7 days") -> DataFrame:
    """The first arrival of each reading of a stream of raw messages.

    A message that repeats within so long of the first arrival is recognised, in the
    same micro-batch, a later one or after a restart. The watermark follows arrivals,
    not sampling times, so a reading may be as late as it likes and is never dropped;
    keys older than that are forgotten, which bounds the state by what arrives in the
    time. Repeats that are later still are left to the store, which looks them up.
    """
    usable = decode(raw).filter(F.col("quarantine_reason").isNull()).drop("raw_value", "quarantine_reason")
    arrived = usable.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", within)
    return with_validation(arrived.dropDuplicatesWithinWatermark(list(NATURAL_KEY)))


class _Evaluator(StatefulProcessor):
    """Window statistics of a bucket of series; the newest readings of each are the state."""

    def __init__(self, window: int, tail_rows: int, drift_window: int, gap_lookback: int):
        self.window, self.tail_rows = window, tail_rows
        self.drift_window, self.gap_lookback = drift_window, gap_lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getListState(
            "series", "device string, metric string, n long, micros array<long>, readings array<double>"
        )

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["micros", "reading_id"], kind="stable")
        names = new[list(SERIES)].astype(object)
        names = names.where(names.notna(), None)
        held = [tuple(r) for r in self.series.get()] if self.series.exists() else []
        numbers = {r[:2]: i for i, r in enumerate(held)}
        own = np.array([numbers.setdefault(k, len(numbers)) for k in zip(*[names[c] for c in SERIES])], np.int64)
        fresh = len(numbers) - len(held)
        n_old = np.array([len(r[3]) for r in held] + [0] * fresh, np.int64)
        before = np.array([r[2] for r in held] + [0] * fresh, np.int64)
        total = before + np.bincount(own, minlength=len(numbers))

        # All rows by series and time; of equal times those held come first.
        of = np.concatenate([np.repeat(np.arange(len(numbers)), n_old), own])
        micros = np.concatenate([*[np.array(r[3], np.int64) for r in held], new["micros"].to_numpy(np.int64)])
        values = np.concatenate([*[np.array(r[4], float) for r in held], new["value"].to_numpy(float)])
        order = np.lexsort((micros, of))
        micros, values, of = micros[order], values[order], of[order]
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        at = places[n_old.sum() :]
        bounds = np.searchsorted(of, np.arange(len(numbers) + 1))
        depth = np.arange(len(of)) - bounds[of]

        sums, sizes, windows, known = self._back(values, at, depth, self.window + 1)
        means = sums / sizes
        spread = np.where(known, windows - means[:, None], 0.0)
        stds = np.sqrt((spread * spread).sum(axis=1) / sizes)
        last = bounds[1:] - 1
        recent, recent_sizes, _, _ = self._back(values, last, depth, self.drift_window)
        # A gap belongs to the later of its two readings, so a series' first has none.
        steps = np.diff(micros, prepend=0) / 1e6
        _, _, gaps, known = self._back(steps, last, depth - 1, self.gap_lookback)
        gaps = np.where(known, gaps, -1.0).max(axis=1)

        found = dict(enumerate(held))
        for pair, i in numbers.items():
            if total[i] > before[i]:
                newest = slice(max(bounds[i], bounds[i + 1] - self.tail_rows), bounds[i + 1])
                found[i] = (*pair, int(total[i]), micros[newest].tolist(), values[newest].tolist())
        self.series.put([found[i] for i in range(len(numbers))])
        yield pd.DataFrame(
            {
                **{c: names[c].to_numpy() for c in SERIES},
                "reading_id": new["reading_id"].to_numpy(),
                "sampled_at": pd.to_datetime(new["micros"].to_numpy(), unit="us"),
                "value": new["value"].to_numpy(float),
                "mean": means,
                "std": stds,
                # The window is whole, or the series has no earlier readings than it holds.
                "covered": (depth[at] >= self.window) | (before[own] <= n_old[own]),
                "n": total[own],
                "recent_mean": (recent / recent_sizes)[own],
                "max_gap_seconds": np.where(gaps >= 0, gaps, np.nan)[own],
            }
        )

    @staticmethod
    def _back(values: np.ndarray, at: np.ndarray, depth: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        """Sums and sizes of up to `most` values ending at `at` that `depth` says are there,
        the values themselves and which of them are."""
        padded = np.concatenate([np.zeros(most - 1), values])
        windows = np.lib.stride_tricks.sliding_window_view(padded, most)[at]
        known = depth[at][:, None] >= np.arange(most - 1, -1, -1)
        return np.where(known, windows, 0.0).sum(axis=1), known.sum(axis=1), windows, known


def evaluated(readings: DataFrame, settings: Settings, buckets: int = BUCKETS) -> DataFrame:
    """Every reading of a stream with its window statistics and the condition of its series.

    readings are (reading_id, device, metric, sampled_at, value); those the rules do not
    judge are left out. What a series needs of its past, its newest readings, is list
    state, so history is never read again. Rows of a micro-batch are put in order; one
    that is older than the state reaches back is judged by what is held of its window
    and has covered false, for the sweep over the store to judge. Series share the state
    of their hash bucket, so what a call costs is paid per bucket and not per series; a
    checkpoint belongs to one number of buckets. Memory of a task is bounded by what one
    micro-batch and the state hold of a bucket.
    """
    usable = detect.judgeable(readings, settings).select(
        *SERIES, F.col("reading_id").cast("string").alias("reading_id"), F.unix_micros("sampled_at").alias("micros"), "value"
    )
    dealt = usable.withColumn("bucket", F.pmod(F.xxhash64(*SERIES), F.lit(buckets)))
    made = _Evaluator(settings.spike_window, settings.tail_rows, settings.drift_window, settings.gap_lookback)
    return dealt.groupBy("bucket").transformWithStateInPandas(made, EVALUATED, "Append", "None")


def point_findings(rows: DataFrame, settings: Settings) -> DataFrame:
    """What `evaluated` has written, judged; rows it could not cover are left out."""
    return detect.judge(detect.with_limits(rows.filter("covered"), settings))


def window_findings(rows: DataFrame, settings: Settings, detected_at) -> DataFrame:
    """Drift and gap anomalies from the last condition of every series."""
    names = ("recent_mean", "max_gap_seconds")
    last = F.max_by(F.struct(*names), "n").alias("_last")
    condition = rows.groupBy(*SERIES).agg(last).select(*SERIES, "_last.*")
    return detect.window_anomalies(detect.with_limits(condition, settings), settings, detected_at)


def start_rate(
    rows: DataFrame, time: str, folder: str, checkpoint: str, minutes: int = 1, seconds: int | None = 5
) -> StreamingQuery:
    """Count the events of a stream in tumbling windows of their own time.

    Each micro-batch writes its counts into a folder of its own, so a batch that is run
    again replaces itself. Counts add up, so there is no watermark: no event is too late,
    and nothing waits for a window to close.
    """

    def count(batch: DataFrame, number: int) -> None:
        window = F.window(F.col(time), f"{minutes} minutes")
        counts = batch.groupBy(window["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    writer = rows.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def read_rate(spark: SparkSession, folder: str, minutes: int = 1) -> DataFrame:
    """Events per second by window, from all that a rate stream has written."""
    parts = spark.read.schema("window_start timestamp, n long, batch long").parquet(folder)
    summed = parts.groupBy("window_start").agg(F.sum("n").alias("n"))
    return summed.withColumn("per_second", F.col("n") / F.lit(minutes * 60.0))
