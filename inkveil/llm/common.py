"""What the operators of this subpackage share: reading tables, written intermediates, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows and bytes of one Arrow batch; a batch of very long texts stays within the second.
BATCH_ROWS, BATCH_BYTES = 250, 2 << 20
U64 = np.uint64
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and in bytes, so that a Python worker's memory doesn't follow text length.

    Results that Spark computes only when they are read need it then, so it stays set in the session.
    """
    spark.conf.set(_ROWS, BATCH_ROWS)
    spark.conf.set(_BYTES, BATCH_BYTES)


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[None]:
    """Session settings for what runs inside, as they were before afterwards; names with _ for the dots."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def one_row_batches(spark: SparkSession):
    """Rows that are blocks by themselves go to Python one at a time."""
    return settings(spark, **{_ROWS.replace(".", "__"): 1})


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset: one of our own if all is one process, as in tests; on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='inkveil-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    Shuffle files go as soon as the table is there, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkveil/{name}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_written(*dfs: DataFrame) -> None:
    """Delete what written() wrote, once nothing lazy depends on it."""
    for df in dfs:
        path = getattr(df, "written_at", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def trimmed(run: Callable) -> Callable:
    """run, for mapInArrow; when its task is over, the worker, which lives on, gives free memory back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Give free memory of this process back to the system, and large tables of powers."""
    if _powers and len(_powers[0]) > _KEPT:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: Bytes up to which a table of keys and short lists is sent to every executor, by a generous width of a row.
BROADCAST_BYTES = 24 << 20


def guarded(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df, to be broadcast if it is counted and found small; else the join shuffles. row_bytes: of the widest row."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def utf8_slices(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind, count=len(col) + 1, offset=col.offset * kind().itemsize).astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))

#: An odd multiplier and its inverse modulo 2**64, for hashes of byte ranges.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
_KEPT = 1 << 20  # entries that a worker keeps between tasks


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for n bytes at least; grown by doubling and kept."""
    if not _powers or len(_powers[0]) < n:
        size = max(_KEPT, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[s:e] for each pair; equal bytes of equal length give equal hashes, wherever they are."""
    power, inverse = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * power[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD1B54A32D192ED03))
