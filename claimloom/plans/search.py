"""Finding facts without scanning all: a table of trigram postings, and pages of a ledger by the bounds of sorted files.

Postings: every three characters of the small-lettered texts of a column, a row for each distinct text that has them, in folders by a hash of the three. A
search reads the folders of its own trigrams, takes the texts that have them all, checks these with the very condition that a scan would use, and then
takes the facts of these texts; so wildcards, columns and ties come out the same. A pattern without three letters in a row says nothing about trigrams and
is a scan. Facts that share a text share its postings, and no fact is dealt for a search unless more than FEW texts match in its column.

Pages: facts are written sorted, in files by ranges of the order; the least key and the number of rows of each file are a small table. A page is read from
the one or two files that it lies in, whatever its number.

Edge cases: null columns have no trigrams and match nothing; an empty pattern matches every value that is not null; patterns with an escape use what stands
outside it; letters beyond ASCII are left to the check, since languages differ in how they make them small; a page beyond the end is empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ledger import like

GRAMS = 64
#: Matching texts of a column that are sent to all facts instead of dealing facts by their texts.
FEW = 100_000
#: The order of a ledger.
ORDER = ["entity_key", "metric_key", "period_start", "fact_id"]


def grams_of(text: Column) -> Column:
    """Distinct runs of three characters."""
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(3))))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAMS)).cast("int")


def write_postings(facts: DataFrame, columns: list[str], path: str, key: str = "fact_id") -> None:
    """The table of postings of some columns: gram, of (the column), text, in folders; sorted by gram within a file, so that readers skip what they don't
    ask for."""
    texts = facts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("text")) for c in columns))).alias("x")).select("x.*").where("text is not null").distinct()
    rows = texts.select("of", "text", F.explode(grams_of(F.lower("text"))).alias("gram")).withColumn("folder", _folder(F.col("gram")))
    rows.repartition("folder", F.pmod(F.xxhash64("text"), F.lit(8))).sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(path)


def asked_grams(pattern: str) -> list[str]:
    """Trigrams that every match must have."""
    plain = re.split(r"\\.|[%_\\]", pattern.lower(), flags=re.DOTALL)
    return sorted({p[i : i + 3] for p in plain for i in range(len(p) - 2) if p[i : i + 3].isascii()})


def search(facts: DataFrame, postings: DataFrame, columns: list[str], pattern: str, key: str = "fact_id") -> DataFrame:
    """The facts of which one of the columns has the pattern in it, without regard to case; % and _ are wildcards."""
    condition = like(columns[0], pattern)
    for c in columns[1:]:
        condition = condition | like(c, pattern)
    grams = asked_grams(pattern)
    if not grams:
        return facts.where(condition)
    folders = [r[0] for r in facts.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    hits = postings.where(F.col("folder").isin(folders) & F.col("gram").isin(grams)).groupBy("of", "text").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    hits = hits.where(like("text", pattern))
    many = {r["of"]: r["count"] for r in hits.groupBy("of").count().collect()}
    out, left = None, facts
    for c in columns:
        own = hits.where(F.col("of") == c).select(F.col("text").alias("_text"))
        if many.get(c):
            found = left.join(F.broadcast(own) if many[c] <= FEW else own, F.col(c) == F.col("_text"), "left_semi")
            out = found if out is None else out.unionByName(found)
            # what this column matches is not taken again for the next
            left = left.where(~F.coalesce(like(c, pattern), F.lit(False)))
    return facts.limit(0) if out is None else out


def write_sorted(facts: DataFrame, path: str, files: int, order: list[str] = ORDER) -> None:
    """Two tables below path: `rows`, sorted by the order in some files, and `bounds` (file, begins, n): how many rows stand before each file's."""
    facts.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    spark = facts.sparkSession
    by = spark.read.parquet(f"{path}/rows").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min(F.struct(*order)).alias("least"), F.count("*").alias("n"))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    by.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"), "n").coalesce(1).write.parquet(f"{path}/bounds")


def page(spark: SparkSession, path: str, number: int, size: int, order: list[str] = ORDER) -> DataFrame:
    """The rows of a page (from 0), in order, from the files that it lies in."""
    first = number * size
    files = spark.read.parquet(f"{path}/bounds").where((F.col("begins") < first + size) & (F.col("begins") + F.col("n") > first)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    if not files:
        return rows.limit(0)
    own = spark.read.schema(rows.schema).parquet(*(f"{path}/rows/{f['file']}" for f in files))
    return own.orderBy(*order).offset(first - min(f["begins"] for f in files)).limit(size)
