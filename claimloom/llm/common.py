"""What the operators of this subpackage share: the cluster's shared folder, written tables, Arrow columns as NumPy arrays."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. With whole texts in the rows a batch stays small even where texts are long.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a folder of our own, which only a local master can share."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="claimloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """One size for every operator whose result is still to be computed when it returns: the same for all, so their order doesn't matter."""
    spark.conf.set(_SIZE, str(BATCH_ROWS))


_SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files of an execution go when it ends, since keep() reads each result once.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for what runs inside; the caller's come back afterwards."""
    named = {{"batch": _SIZE, "clean": _CLEAN}[k]: v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep(df: DataFrame, name: str, batch: int = BATCH_ROWS) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors. batch: rows in an Arrow batch."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, batch=str(batch), clean="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_kept_path", None)
        if not path:
            continue
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


_is_lean = False


def lean() -> None:
    """Large arrays are given back to the system as soon as they are freed, in place of being kept for later ones."""
    global _is_lean
    if _is_lean:
        return
    import ctypes

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        for parameter, size in ((-3, 1 << 20), (-1, 1 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(parameter, size)
    _is_lean = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string (or binary) column, one after the other, and n + 1 offsets into them; null counts as empty."""
    import pyarrow as pa

    lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) else column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data and len(column) else np.empty(0, np.uint8)
    return buf, offs - offs[0]


#: Up to so many ids are broadcast to pick rows; more are joined with a shuffle.
IDS = 1 << 21


def pick(rows: DataFrame, ids: DataFrame, on: str, how: str, name: str) -> DataFrame:
    """rows left_semi or left_anti ids. The ids are written and counted, and broadcast only below a fixed number."""
    ids = keep(ids.distinct(), name)
    return rows.join(F.broadcast(ids) if ids.count() <= IDS else ids, on, how)
