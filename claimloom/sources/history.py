"""Facts as a store in buckets: a batch reads and rewrites only the buckets that it touches.

A bucket is a folder of the table, chosen by a hash of one column (the entity, since facts of different entities never meet). Every change is the same step:
read the touched buckets, change them, write them by dynamic partition overwrite. Files of all other buckets are not opened. A step that is tried
again, also after it was stopped half way, ends in the same table, since replacing rows by their key twice is replacing them once.

The number of buckets is fixed when a store is made; choose it so that a bucket stays below some million rows.

Edge cases: a null key is a bucket's key like any other; no rows to merge, or no ids to delete, change nothing; a bucket whose last row goes is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .landing import upsert

BUCKETS = 64


class History:
    """A table (all columns of `schema`, and `bucket`) below a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str = "entity_key", buckets: int = BUCKETS):
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), by, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, bucket int"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by)), F.lit(self.buckets)).cast("int")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self._exists() else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows belong to: `buckets` numbers at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def around(self, rows: DataFrame) -> DataFrame:
        """What is stored of the entities that rows are about: other buckets are pruned, other entities of the same buckets are dropped."""
        own = self.read().where(F.col("bucket").isin(self.touched(rows)))
        return own.join(rows.select(self.by).distinct(), self.by, "left_semi").select(self.columns)

    def _write(self, rows: DataFrame) -> None:
        rows = rows.select(*self.columns).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def merge(self, rows: DataFrame, key: list[str], latest: str | None = None) -> list[int]:
        """Put rows in, each in place of the one with its key (which must have the bucket's column in it, or determine it). Of several new rows of a key the
        one with the greatest `latest` stays; without that one of them. Returns the buckets that were written anew."""
        rows = rows.select(*self.columns) if latest else rows.select(*self.columns).dropDuplicates(key)
        touched = self.touched(rows)
        if touched:
            self._write(upsert(self.read().where(F.col("bucket").isin(touched)).select(*self.columns), rows, key, latest))
        return touched

    def delete(self, gone: DataFrame, column: str = "doc_id") -> list[int]:
        """Drop all rows with one of the values; returns the buckets that were written anew or removed."""
        touched = sorted(r[0] for r in self.read().select(column, "bucket").join(gone.select(column).distinct(), column, "left_semi").select("bucket").distinct().collect())
        if touched:
            old = self.read().where(F.col("bucket").isin(touched))
            # rows are kept by bucket first: one that loses all its rows is not written, so its folder has to go by itself
            left = old.join(gone.select(column).distinct(), column, "left_anti").select(*self.columns, "bucket")
            stays = {r[0] for r in left.select("bucket").distinct().collect()}
            if stays:
                self._write(left)
            for b in set(touched) - stays:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return touched
