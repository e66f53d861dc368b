"""Candidate pairs of facts: exact blocks, near-miss metrics of one entity, and the incremental form of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.names import near_miss, tokens

KEYS = ("fact_id", "doc_id", "entity_key", "metric_key")


def _pairs(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    a = x.select(*(F.col(c).alias(c if c in on else "a_" + c) for c in x.columns))
    b = y.select(*(F.col(c).alias(c if c in on else "b_" + c) for c in y.columns))
    return a.join(b, on)


def near_keys(facts: DataFrame) -> DataFrame:
    """entity_key, ka < kb: metric keys of one entity that nearly agree. Keys meet over a shared word, never facts over facts."""
    keys = facts.select("entity_key", "metric_key").distinct().withColumn("token", F.explode(tokens(F.col("metric_key"))))
    met = _pairs(keys, keys, ["entity_key", "token"]).where("a_metric_key < b_metric_key")
    return met.select("entity_key", F.col("a_metric_key").alias("ka"), F.col("b_metric_key").alias("kb")).distinct().where(near_miss(F.col("ka"), F.col("kb")))


#: Facts of a block that meet in one task; larger blocks are dealt out.
BLOCK = 2048


def block_pairs(facts: DataFrame, on: list[str], block: int = BLOCK) -> DataFrame:
    """a_*, b_* columns of all pairs of one block with a_fact_id < b_fact_id. A block of up to `block` facts meets itself where its facts are after one shuffle. A
    larger one is dealt out: each of its facts is on the left in one of its parts and on the right in all of them, so no task has more than `block` of its
    facts on the left."""
    parts = facts.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*on, F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    known = facts.join(parts, on, "left")
    plain, dealt = known.where("_parts is null").drop("_parts"), known.where("_parts is not null")
    left = dealt.withColumn("_part", F.pmod(F.xxhash64("fact_id"), F.col("_parts")).cast("int")).drop("_parts")
    right = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return _pairs(plain, plain, on).unionByName(_pairs(left, right, [*on, "_part"]).drop("_part")).where("a_fact_id < b_fact_id")


def met_pairs(facts: DataFrame, cross_document_only: bool = False, block: int = BLOCK) -> DataFrame:
    """fact_a < fact_b with both facts as structs a and b, each unordered pair once if each fact is: the two metric keys of a near pair differ, those of an exact
    one do not. Facts bring their columns to where they meet, so what is shuffled grows with facts, never with pairs; columns that nobody asks for stay behind."""
    on = ["entity_key", "metric_key"]
    # stated here, so that all uses of the facts are one plan, and one shuffle
    f = facts.where(" and ".join(f"{k} is not null" for k in on))
    exact = block_pairs(f, on, block).withColumns({f"{side}_{k}": F.col(k) for side in "ab" for k in on})
    keys = near_keys(f)
    left = f.join(keys.withColumnRenamed("ka", "metric_key"), on).select("entity_key", "kb", *(F.col(c).alias("l_" + c) for c in facts.columns))
    right = f.select("entity_key", F.col("metric_key").alias("kb"), *(F.col(c).alias("r_" + c) for c in facts.columns))
    near = left.join(right, ["entity_key", "kb"]).where("l_fact_id <> r_fact_id")
    first = F.col("l_fact_id") < F.col("r_fact_id")
    of = lambda x, y, name: [F.when(first, F.col(x + c)).otherwise(F.col(y + c)).alias(name + c) for c in facts.columns]
    both = exact.select(*(side + c for side in ("a_", "b_") for c in facts.columns)).unionByName(near.select(*of("l_", "r_", "a_"), *of("r_", "l_", "b_")))
    if cross_document_only:
        both = both.where("a_doc_id <> b_doc_id")
    return both.select(F.col("a_fact_id").alias("fact_a"), F.col("b_fact_id").alias("fact_b"), *(F.struct(*(F.col(f"{side}_{c}").alias(c) for c in facts.columns)).alias(side) for side in "ab"))


def candidate_pairs(facts: DataFrame, cross_document_only: bool = False) -> DataFrame:
    """The pairs of met_pairs() by their ids alone."""
    return met_pairs(facts.select(*KEYS), cross_document_only).select("fact_a", "fact_b")


def pairs_for_new(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs that touch a new fact: new with new, and new with old of one entity and an equal or near key. Never old with old."""
    own = candidate_pairs(new)
    n, o = new.select(*KEYS), old.select(*KEYS)
    same = _pairs(n, o, ["entity_key", "metric_key"]).select("a_fact_id", "b_fact_id")
    keys = near_keys(n.unionByName(o))
    keys = keys.select("entity_key", F.col("ka").alias("kn"), F.col("kb").alias("ko")).unionByName(keys.select("entity_key", F.col("kb").alias("kn"), F.col("ka").alias("ko")))
    near = n.withColumnRenamed("metric_key", "kn").join(keys, ["entity_key", "kn"]).select("entity_key", "ko", F.col("fact_id").alias("a_fact_id"))
    near = near.join(o.select("entity_key", F.col("metric_key").alias("ko"), F.col("fact_id").alias("b_fact_id")), ["entity_key", "ko"]).select("a_fact_id", "b_fact_id")
    met = same.unionByName(near).select(F.least("a_fact_id", "b_fact_id").alias("fact_a"), F.greatest("a_fact_id", "b_fact_id").alias("fact_b")).where("fact_a <> fact_b")
    return own.unionByName(met)


def block_stats(facts: DataFrame) -> DataFrame:
    """facts, blocks, largest_block, pairs_considered (exact blocks), pairs_naive: one row, from sums by block."""
    by = facts.groupBy("entity_key", "metric_key").agg(F.count("*").alias("n"))
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return by.agg(n.alias("facts"), F.count("*").alias("blocks"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest_block"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("pairs_considered"), F.expr("coalesce(sum(n), 0) * (coalesce(sum(n), 0) - 1) div 2").cast("long").alias("pairs_naive"))
