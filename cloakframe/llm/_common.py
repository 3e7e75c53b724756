"""What the operators of this subpackage share: work tables, fresh exchanges, Arrow slicing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

_own_folders: dict[str, str] = {}
_made = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local master gets a temporary folder and a cluster a folder in
    the warehouse, which executors can reach too.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if sc.applicationId not in _own_folders:
        if sc.master.startswith("local") and "cluster" not in sc.master:
            _own_folders[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        else:
            _own_folders[sc.applicationId] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cloakframe"
    return _own_folders[sc.applicationId]


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends, or by :func:`drop_since`."""
    path = f"{shared_dir(spark)}/cloakframe-{label}-{uuid.uuid4().hex}"
    _made.__dict__.setdefault("paths", []).append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def work_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from files
    that survive the loss of any executor, and nothing upstream runs twice."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", "snappy").parquet(path)  # needs the least memory of its own
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """How many work paths this thread has made: a mark for :func:`drop_since`."""
    return len(_made.__dict__.get("paths", []))


def drop_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Delete the work paths that this thread has made since ``mark``, but for the last ``keep``. Only for
    paths that no plan reads that is still to be run."""
    paths = _made.__dict__.get("paths", [])
    last = len(paths) - keep
    for path in paths[mark:last]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del paths[mark:last]


def fresh(key: Column | str) -> Column:
    """The same value under an expression Spark cannot match to an existing partitioning.

    A join on it gets an exchange of its own on each side, which is what lets adaptive
    execution split a hot key instead of handing its rows to one task.
    """
    key = F.col(key) if isinstance(key, str) else key
    return key.bitwiseXOR(F.lit(0).cast("long"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def others(df: DataFrame, results: list[StructField]) -> list[str]:
    """Columns of ``df`` that no result has the name of, in any case."""
    taken = {f.name.lower() for f in results}
    return [c for c in df.columns if c.lower() not in taken]


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of an exchange: those of the session, or more if a task would get over ``each`` rows."""
    return max(partitions(spark), -(-rows // each))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string or binary array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64 if big else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return raw, o - o[0]


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in ``column``; a longer row comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, o = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(o, o[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back to the system: a worker serves many tasks and must stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def binary_array(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array from one buffer and its offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]).cast(pa.binary())


BROADCAST_BYTES = 16 << 20


def small_enough(table: DataFrame, size: Column, rows: int = 1_000_000) -> DataFrame:
    """``table`` (a work table) marked for broadcast if its counted rows and the summed
    ``size`` of them allow that; unchanged otherwise, to be joined by a shuffle."""
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(table) if n <= rows and total <= BROADCAST_BYTES else table
