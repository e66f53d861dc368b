"""The corpus pipeline: documents in, token ids of clean, distinct, uncontaminated documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, decontaminate, jaccard, perplexity
from claimloom.llm.common import forget, keep, pick


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (see perplexity.classify): also those without words. Equal rows share one verdict; ties at
    the threshold stay; a null id, language or text is judged like any other; an empty table stays empty."""
    judged = perplexity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = docs.withColumn("__row_key", perplexity.row_key(docs))
    return pick(keyed, judged.where(~F.col("keep")).select(F.col("key").alias("__row_key")), "__row_key", "left_anti", "rejected").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the least doc_id (null last), and one of equal rows.

    Rows are told apart by the hash of id, language and text, so neither a repeated nor a null id ties rows to each other.
    """
    keyed = docs.withColumn("__row_key", perplexity.row_key(docs))
    found = keep(jaccard.near_duplicates(keyed.select(F.col("__row_key").alias("doc_id"), "text")), "groups")
    tied = found.where("doc_id <> component_id")
    tied = tied.select(F.col("doc_id").alias("__row_key"), "component_id").unionByName(tied.select(F.col("component_id").alias("__row_key"), "component_id")).distinct()
    tied = keep(keyed.select("__row_key", F.col("doc_id").cast("long").alias("id")).join(tied, "__row_key").distinct(), "tied")
    first = tied.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row_key"))["__row_key"].alias("stays"))
    gone = tied.join(first, "component_id").where("__row_key <> stays").select("__row_key")
    left = pick(keyed, gone, "__row_key", "left_anti", "duplicates")
    again = keep(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__row_key")), "repeated")
    if not again.isEmpty():
        left = keep(left, "left")
        left = pick(left, again, "__row_key", "left_anti", "repeated").unionByName(pick(left, again, "__row_key", "left_semi", "repeated").dropDuplicates(["__row_key"]))
    return left.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; those without words stay, as do all if the benchmark is empty."""
    return decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids (little-endian unsigned 32-bit integers) of what is left; a text without characters has no ids."""
    return bpe.encode(docs).select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids")


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("byte_bpe", encoding)]

#: SQL can express neither the language model nor the encoding; the tests hold run() against every stage's decisions made again in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        forget(before)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
