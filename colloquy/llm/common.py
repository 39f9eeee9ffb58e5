"""What the corpus operators share: table access, scratch tables, and maps over slices of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import ship
from colloquy.staging import scratch_path, staged, staged_with

__all__ = ["map_rows", "map_text", "read", "remainder", "scratch_path", "ship", "staged", "staged_with"]

#: Rows of an Arrow batch that a worker turns into Python objects at once.
SLICE_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``."""
    return F.crc32(key.cast("string")) % F.lit(n)


def map_rows(df: DataFrame, make: Callable, schema: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Map slices of rows in Python workers: ``make()`` runs once a task and returns ``f(columns) -> columns``,
    or that and ``rest() -> columns``, which is called after the last row.

    Slices of a few rows bound what a worker holds, whatever the size of Spark's batches.
    """
    spark = ship(df.sparkSession)
    names = spark.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        f, rest = made if isinstance(made, tuple) else (made, list)

        def batch_of(columns: list) -> Iterator[pa.RecordBatch]:
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for i in range(0, batch.num_rows, slice_rows):
                yield from batch_of(f([c.to_pylist() for c in batch.slice(i, slice_rows).columns]))
        yield from batch_of(rest())

    return df.mapInArrow(run, schema)


def map_text(df: DataFrame, make: Callable) -> DataFrame:
    """Change or drop rows by their text: ``make()`` gives ``f(texts) -> (new texts or None, rows to keep or None)``.

    The other columns pass as they are, whatever their types and names.
    """
    ship(df.sparkSession)
    place = df.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                new, keep = f(part.column(place).to_pylist())
                if new is not None:
                    part = part.set_column(place, part.schema.field(place), pa.array(new, part.schema.field(place).type))
                yield part if keep is None else part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
