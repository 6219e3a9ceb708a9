"""Tables as Parquet folders below one shared root, written batch by batch.

Every writer (ingest, sweep, rollup) numbers its batches 1, 2, 3, ... A batch writes
its rows into folders named after its number and becomes visible through one small
commit row written last. What a batch that died half way left behind is overwritten by
the next one, which takes the same number. The commit row also names the days a batch
touched. Readers pick folders by batch and day, so neither an incremental read nor a
look at a few days lists the whole history.

Fact tables keep every row. State tables (one row per key) hold, per batch, the new
state of the keys the batch touched; the newest row of a key counts. Now and then a
batch writes the complete state, and older folders are no longer read.

One process per writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.sources import tables

INGEST, SWEEP, ROLLUP = "ingest", "sweep", "rollup"

_COMMIT = (
    "consumer string, batch_id bigint, snapshot_seq bigint, read_upto bigint, days array<date>, "
    "at timestamp"
)
_QUARANTINE = (
    "raw_value string, source_topic string, source_partition int, source_offset bigint, "
    "reason string, at timestamp"
)
STATS = (
    "arrived bigint, stored bigint, duplicates bigint, rejected bigint, quarantined bigint, "
    "consumer string, at timestamp"
)
_SERIES = (
    "device string, metric string, last_sampled_at timestamp, value double, unit string, "
    "n bigint, updated_at timestamp"
)
_EVALUATED = (
    "device string, metric string, last_sampled_at timestamp, n bigint, "
    "tail array<struct<sampled_at: timestamp, value: double>>, updated_at timestamp"
)


@dataclass(frozen=True)
class Facts:
    """An append-only table: its writer, the columns that become folders, and ids that
    single rows are looked up by (the files get Bloom filters for these)."""

    writer: str
    schema: str
    folders: tuple[str, ...] = ()
    lookup: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    """A table with one current row per key."""

    writer: str
    schema: str
    key: tuple[str, ...]


FACTS = {
    "reading": Facts(INGEST, tables.READING + ", day date", ("day",), ("reading_id",)),
    "ingest_stage": Facts(INGEST, tables.STAGE, ("stage",), ("reading_id",)),
    "quarantine": Facts(INGEST, _QUARANTINE),
    "batch_stats": Facts(INGEST, STATS),
    "sweep_stage": Facts(SWEEP, tables.STAGE, ("stage",), ("reading_id",)),
    "anomaly": Facts(SWEEP, tables.ANOMALY, ("type",)),
}
STATES = {
    "device": State(INGEST, tables.DEVICE, ("device",)),
    "heartbeat": State(INGEST, tables.HEARTBEAT, ("device",)),
    "series": State(INGEST, _SERIES, ("device", "metric")),
    "offsets": State(INGEST, tables.OFFSETS, ("consumer", "topic", "partition")),
    "evaluated": State(SWEEP, _EVALUATED, ("device", "metric")),
}


@dataclass(frozen=True)
class Head:
    """The last committed batch of a writer."""

    seq: int = 0
    snapshot_seq: int = 1
    read_upto: int = 0


class Store:
    """Reads committed batches and writes new ones."""

    def __init__(self, spark: SparkSession, root: str, snapshot_every: int = 20):
        self.spark = spark
        self.root = root.rstrip("/")
        self.snapshot_every = snapshot_every
        self._heads: dict[str, Head] = {}

    # ---- commits ----

    def _commits(self, writer: str) -> DataFrame | None:
        folder = f"{self.root}/commit/writer={writer}"
        try:
            return self.spark.read.schema(f"{_COMMIT}, seq bigint").parquet(folder)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def commit_folder(self, writer: str) -> str:
        """The folder of a writer's commits, made if the store is new."""
        folder = f"{self.root}/commit/writer={writer}"
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(path)
        return folder

    def refresh(self) -> Store:
        """Look for commits of other processes at the next read."""
        self._heads.clear()
        return self

    def head(self, writer: str) -> Head:
        """The last batch of a writer, as of the last refresh or own commit."""
        if writer not in self._heads:
            self._heads[writer], _ = self._find_head(writer)
        return self._heads[writer]

    def _find_head(self, writer: str, consumer: str | None = None) -> tuple[Head, int | None]:
        """The head of a writer and the last batch stored for a consumer."""
        commits = self._commits(writer)
        if commits is None:
            return Head(), None
        newest = F.max_by(F.struct("seq", "snapshot_seq", "read_upto"), "seq").alias("h")
        of_consumer = F.when(F.col("consumer") == F.lit(consumer), F.col("batch_id"))
        row = commits.agg(newest, F.max(of_consumer).alias("batch")).first()
        head = Head(row.h.seq, row.h.snapshot_seq, row.h.read_upto) if row.h else Head()
        return head, row.batch

    def is_committed(self, writer: str, consumer: str, batch_id: int) -> bool:
        """Whether this batch of a consumer, or a later one, is already stored."""
        self._heads[writer], batch = self._find_head(writer, consumer)
        return batch is not None and batch >= batch_id

    def commit(
        self,
        writer: str,
        seq: int,
        consumer: str,
        batch_id: int,
        at: datetime,
        read_upto: int = 0,
        days: list | None = None,
    ) -> None:
        """Make batch `seq` visible. `days` lists the day folders it has written."""
        before = self.head(writer)
        snapshot = seq if self.is_snapshot(before, seq) else before.snapshot_seq
        row = self.one_row(
            _COMMIT, consumer=consumer, batch_id=batch_id, snapshot_seq=snapshot,
            read_upto=read_upto, days=days or [], at=at,
        )
        row.write.mode("overwrite").parquet(
            f"{self.root}/commit/writer={writer}/seq={seq}"
        )
        self._heads[writer] = Head(seq, snapshot, read_upto)

    def is_snapshot(self, head: Head, seq: int) -> bool:
        return seq - head.snapshot_seq >= self.snapshot_every

    # ---- reading ----

    def _read(self, name: str, schema: str, numbers: range, head: Head) -> DataFrame:
        schema = f"{schema}, seq bigint"
        base = f"{self.root}/{name}"
        if not numbers:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", base)
        if numbers.start == 1 and numbers.stop == head.seq + 1:  # everything: one listing
            return reader.parquet(base).filter(F.col("seq") <= head.seq)
        return reader.parquet(*[f"{base}/seq={number}" for number in numbers])

    def facts(
        self,
        name: str,
        after: int = 0,
        upto: int | None = None,
        days: Callable[[Column], Column] | None = None,
    ) -> DataFrame:
        """Rows of the committed batches with number in (after, upto].

        `days` is a condition on the day, for tables kept by day; only the folders of
        matching days are listed.
        """
        table = FACTS[name]
        head = self.head(table.writer)
        last = head.seq if upto is None else upto
        if days is None:
            return self._read(name, table.schema, range(after + 1, last + 1), head)
        schema = f"{table.schema}, seq bigint"
        commits = self._commits(table.writer)
        folders = []
        if commits is not None:
            touched = commits.filter(F.col("seq").between(after + 1, last))
            touched = touched.select("seq", F.explode("days").alias("day"))
            folders = touched.filter(days(F.col("day"))).collect()  # batches times days
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}"
        paths = [f"{base}/seq={row.seq}/day={row.day}" for row in folders]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def state(self, name: str, only: tuple[str, ...] = ()) -> DataFrame:
        """The current row of every key; with `only`, just these columns beside the key."""
        table = STATES[name]
        head = self.head(table.writer)
        rows = self._read(name, table.schema, range(head.snapshot_seq, head.seq + 1), head)
        if only:
            rows = rows.select(*table.key, *only, "seq")
        if head.seq == head.snapshot_seq:
            return rows.drop("seq")
        return _newest(rows, table.key)

    def latest(self) -> DataFrame:
        """The newest reading of every series, kept up to date by ingest.

        Usable wherever a query asks for readings but needs only the latest ones, such
        as the fleet view and the device list; its size is the number of series.
        """
        rows = self.state("series", ("last_sampled_at", "value", "unit"))
        return rows.withColumnRenamed("last_sampled_at", "sampled_at")

    def written(self, name: str, seq: int) -> DataFrame:
        """The rows a batch in progress has written into a state table."""
        table = STATES[name]
        return self._read(name, table.schema, range(seq, seq + 1), Head()).drop("seq")

    def state_with(self, seq: int, name: str) -> DataFrame:
        """The current state as it will be once batch `seq` is committed."""
        return _overlay(self.state(name), self.written(name, seq), STATES[name].key)

    def stages(self) -> DataFrame:
        """The whole trail of every reading."""
        parts = [self.facts(name).drop("seq") for name in ("ingest_stage", "sweep_stage")]
        return parts[0].unionByName(parts[1])

    # ---- writing ----

    def one_row(self, schema: str, **values) -> DataFrame:
        """A single row of constants."""
        fields = [field.split() for field in schema.split(", ")]
        columns = [_constant(values[name]).cast(kind).alias(name) for name, kind in fields]
        return self.spark.range(1, numPartitions=1).select(*columns)

    def write_facts(self, name: str, seq: int, rows: DataFrame) -> None:
        table = FACTS[name]
        columns = [field.split()[0] for field in table.schema.split(", ")]
        writer = rows.select(*columns).write.mode("overwrite").partitionBy(*table.folders)
        for column in table.lookup:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.root}/{name}/seq={seq}")

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that several tables of a batch start from, written once and read back.

        Before a write Spark packs small shuffle partitions together, before caching it
        does not: the tables written from these rows get few files, however many
        partitions a shuffle has.
        """
        folder = self._staging(name)
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def unstage(self, name: str) -> None:
        """Drop staged rows; those of a batch that died are overwritten by the next one."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self._staging(name))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def _staging(self, name: str) -> str:
        return f"{self.root}/staging/{name}"

    def write_state(self, name: str, seq: int, touched: DataFrame) -> None:
        """Store the new state of the touched keys, or of all keys when it is time."""
        table = STATES[name]
        if self.is_snapshot(self.head(table.writer), seq):
            touched = _overlay(self.state(name), touched, table.key)
        touched.write.mode("overwrite").parquet(f"{self.root}/{name}/seq={seq}")


def _constant(value) -> Column:
    return F.array(*[F.lit(item) for item in value]) if isinstance(value, list) else F.lit(value)


def _newest(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    rest = [name for name in rows.columns if name not in (*key, "seq")]
    newest = F.max_by(F.struct(*rest), "seq").alias("_row")
    return rows.groupBy(*key).agg(newest).select(*key, "_row.*")


def _overlay(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    order = [rows.withColumn("seq", F.lit(place)) for place, rows in enumerate((old, new))]
    return _newest(order[0].unionByName(order[1]), key)


def utc_now() -> datetime:
    return datetime.now(UTC)
