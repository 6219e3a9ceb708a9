"""Work on texts in Arrow batches, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BYTES = 500_000

Columns = list[list]


def slices(batch: pa.RecordBatch, column: str, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most so many bytes of text; a longer text comes alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def with_columns(
    rows: DataFrame, made: str, make: Callable[[list[str]], Columns], *carried: str, text: str = "text"
) -> DataFrame:
    """The carried columns of `rows`, and those `make` gives for a list of texts.

    `made` is the DDL of the new columns. Null texts are empty. `make` gets some rows of
    a partition at a time and returns a list for each new column.
    """
    new = StructType.fromDDL(made)
    chosen = rows.select(*carried, rows[text].alias("_text"))
    schema = StructType([chosen.schema[c] for c in carried] + new.fields)
    types = [f.type for f in to_arrow_schema(new)]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = ["" if t is None else t for t in part.column("_text").to_pylist()]
                arrays = [pa.array(values, kind) for values, kind in zip(make(texts), types, strict=True)]
                kept = [part.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays(kept + arrays, names)

    return chosen.mapInArrow(run, schema)
