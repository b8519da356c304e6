"""Helpers for functions that map Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import ship

#: Rows and bytes of an Arrow batch; long documents make batches of few rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "300", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def ready(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches, so that a worker holds few texts at once."""
    ship(spark)
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def batch_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(schema, (cols[n] for n in schema.names), strict=True)], schema=schema)


def release() -> None:
    """Give memory that a task has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def text_of(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def fresh_name(stem: str, taken: Iterable[str]) -> str:
    """A column name that no column has, whatever its case."""
    name, there = f"__{stem}", {c.lower() for c in taken}
    while name.lower() in there:
        name += "_"
    return name
