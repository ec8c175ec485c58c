"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import string
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.staging import shared_dir, stage

__all__ = ["HOT_ROWS", "HOT_SHARE", "WORD", "WORDS", "ascii_lower", "bounded_batches", "documents", "given_out", "hot_bound", "join_counted", "map_batches", "release_memory", "shared_dir", "stage", "utf8"]

#: A key with more rows than this, and than this share of all, is hot: at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1000, 0.0005

#: A word is a run of anything but space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def release_memory() -> None:
    """Gives memory that a task has freed back to the system, as idle workers stay for the tasks to come."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hot_bound(rows: int) -> float:
    """The number of rows beyond which a key is hot, of so many rows."""
    return max(HOT_ROWS, HOT_SHARE * rows)


def join_counted(rows: DataFrame, known: DataFrame, keys: list[str], n: str, hot: float) -> DataFrame:
    """An inner join with ``known``, which has each key once and the number of its rows as ``n``.

    Keys of more than ``hot`` rows are few and go to all tasks, so that none lands in one task; the others are shuffled.
    """
    many = known.filter(F.col(n) > hot)
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(many), keys).unionByName(rest.join(known.filter(F.col(n) <= hot), keys))


def given_out(batch: dict[str, list], copies: list[int], rows: int) -> Iterator[dict[str, list]]:
    """The batch with each row as often as it has copies, in batches of ``rows`` at most."""
    each = (i for i, n in enumerate(copies) for _ in range(n))
    while some := list(islice(each, rows)):
        yield {name: [values[i] for i in some] for name, values in batch.items()}


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long, so Arrow batches get fewer rows than Spark's default, unless the session says otherwise.

    Spark reads the setting when a query runs, so it stays as set here for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str, rows: int = 2048) -> DataFrame:
    """Runs ``fn`` over column dictionaries of at most ``rows`` rows each, in Arrow batches."""
    target = None
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[dict[str, list]]:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows).to_pydict()

        try:
            for out in fn(slices()):
                if out and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out, schema=target)
        finally:
            release_memory()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    target = to_arrow_schema(parsed)
    return df.mapInArrow(run, parsed)
