"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.sources.shared import written


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Paths of tables that stored() writes while somebody records them.
RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are stored inside."""
    RECORDS.append([])
    try:
        yield RECORDS[-1]
    finally:
        RECORDS.pop()


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: cuts lineage and survives lost executors.

    The folder goes when the session's JVM ends, or by forget()."""
    found, path = written(df, name)
    for own in RECORDS[-1:]:
        own.append(path)
    return found


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, null texts as empty ones."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def trimmed(run: Callable) -> Callable:
    """A function of Arrow batches that gives memory back to the system when a task ends; workers live on between tasks."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length in few bytes: alike bytes of a column side by side, compressed."""
    head = np.array([len(columns[0]), *(c.dtype.itemsize for c in columns)], np.int64).tobytes()
    planes = (np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)
    return zstandard.compress(head + b"".join(planes), 1)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n, at, out = int(raw[:8].view(np.int64)[0]), 8 * (1 + len(types)), []
    for size, kind in zip(raw[8:at].view(np.int64).tolist(), types, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind)[:, 0] if n else np.zeros(0, kind))
        at += n * size
    return out
