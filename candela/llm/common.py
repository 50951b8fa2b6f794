"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.storage import shared_dir, stored, written

__all__ = ["BATCH_ROWS", "appended", "ascii_lower", "fresh", "held", "n_words", "shared_dir", "short_batches", "small", "stored", "table", "written"]

#: A side is broadcast only when it was written and counted first and is no larger than this.
BROADCAST_BYTES = 8 << 20

#: The session's setting for how many rows go to a Python worker at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; every other code point stays."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def n_words(text: Column) -> Column:
    """Count of runs of anything but space, tab, line feed, vertical tab, form feed and carriage return (null: 0)."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df (written already) marked for broadcast if its rows fit BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def appended(df: DataFrame, make: Callable[[pa.RecordBatch], list], name: str, kind: T.DataType, arrow: pa.DataType) -> DataFrame:
    """df with a column that make() gives for each batch of the others, without any shuffle."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{name} is a column already")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(make(part), arrow)], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are run inside pass so many rows at most at once to a Python worker: both sides hold a batch whole."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


_held: dict = {}


def trimmed() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held(owner, make: Callable):
    """Tables that a Python worker keeps between tasks: one operator's at a time, as workers serve all of them in turn."""
    if owner not in _held:
        _held.clear()
        trimmed()
        _held[owner] = make()
    return _held[owner]
