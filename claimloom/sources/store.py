"""Tables that are built once and read by many queries, as the ledgers of a store are: facts, judged claims, relationships."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (application, name, folder): signature of the source, path.
_PATHS: dict[tuple[str, str, str], tuple[str, str]] = {}
#: Tables that were written, and the seconds that took, in order.
BUILT: list[tuple[str, float]] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a folder of our own, which only a local master can share."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="claimloom-store-")
        atexit.register(shutil.rmtree, own, True)
        base = "file://" + own
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def signature(spark: SparkSession, source: str, tables: tuple[str, ...]) -> str:
    """Of the files that tables consist of: their paths, lengths and times, from one scan of the folders that reads no content."""
    paths = [f"{source}/{t}.parquet" for t in tables]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("of")).first()
    return f"{row['n']}-{row['of']}"


def stored_at(spark: SparkSession, name: str, source: str, write: Callable[[str], None], tables: tuple[str, ...]) -> str:
    """Where write(path) has put what belongs to the tables in `source`: written the first time that this application asks for it, and anew, the
    old one being deleted, when the files of those tables have changed."""
    key, now = (spark.sparkContext.applicationId, name, source), signature(spark, source, tables)
    old = _PATHS.get(key)
    if old is None or old[0] != now:
        path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        began = time.time()
        write(path)
        BUILT.append((name, time.time() - began))
        _PATHS[key] = now, path
        if old is not None:
            _delete(spark, old[1])
    return _PATHS[key][1]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what one run makes, deleted by clear()."""
    path = f"{folder(spark)}/{name}"
    _PATHS[spark.sparkContext.applicationId, name, ""] = "", path
    return path


def stored(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], tables: tuple[str, ...]) -> DataFrame:
    """The table `name`, which make() (the lazy form) makes of the tables in `source`."""
    return spark.read.parquet(stored_at(spark, name, source, lambda path: make().write.parquet(path), tables))


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored; what is asked for later is written anew."""
    for key in [k for k in _PATHS if k[0] == spark.sparkContext.applicationId]:
        _delete(spark, _PATHS.pop(key)[1])


def _at_end() -> None:
    """What is still stored when the program ends is deleted, as long as its JVM answers."""
    jvm = SparkContext._jvm
    if jvm is None:
        return
    with contextlib.suppress(Py4JError, OSError):
        for _, path in _PATHS.values():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


atexit.register(_at_end)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
