"""The gate: claims are admitted as facts with evidence, or refused with the first reason that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.base import strip
from claimloom.functions.names import entity_key, is_resolvable
from claimloom.functions.quantity import with_number

from .locate import locate_on
from .normalize import evidence_id, normalize, stable_id, to_facts

CLAIM = ["fact_kind", "entity", "metric", "value", "value_text", "unit", "magnitude", "period", "basis", "quote"]


def gate(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """claims (doc_id, page_no, ...) with `reason` (null if admitted) and `ground`. pages: doc_id, page_no, page_text.

    Of a value it asks only whether it holds a number: units, periods and basis, which cost most of a claim, are read for what is admitted."""
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    c = claims.withColumns({x: text(x) for x in ("quote", "entity", "metric")} | {"value_text": F.nullif(text("value_text"), F.lit("")), "fact_kind": F.coalesce(F.nullif(F.col("fact_kind"), F.lit("")), F.lit("measurement"))})
    c = locate_on(c, pages.select("doc_id", "page_no", "page_text"), ["doc_id", "page_no"])
    n = with_number(c, "_number", "value")
    reason = (
        F.when(F.col("quote") == "", "no_quote")
        .when((F.col("entity") == "") | (F.col("metric") == ""), "no_entity_or_metric")
        .when(~is_resolvable(entity_key(F.col("entity"))), "unresolvable_entity")
        .when(F.col("ground.match_type") == "failed", "quote_not_found")
        .when((F.col("fact_kind") == "measurement") & F.col("_number").isNull() & F.col("value_text").isNull(), "unparseable_value")
    )
    return n.withColumn("reason", reason).drop("_number")


def judge(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """gate() with everything normalized, of refused claims too."""
    return normalize(gate(claims, pages))


def admitted(judged: DataFrame) -> DataFrame:
    return judged.where("reason is null")


def facts_of(judged: DataFrame, fact_id: str | None = None) -> DataFrame:
    kept = judged.where("reason is null").withColumn("extraction_conf", F.lit(1.0)).withColumn("grounding_conf", F.bround("ground.confidence", 3))
    return to_facts(kept, fact_id)


def evidence_of(judged: DataFrame) -> DataFrame:
    g = judged.where("reason is null")
    return g.select(evidence_id().alias("evidence_id"), "doc_id", "page_no", "quote", F.col("ground.char_start").alias("char_start"), F.col("ground.char_end").alias("char_end"), F.col("ground.match_type").alias("match_type")).distinct()


def rejects_of(judged: DataFrame) -> DataFrame:
    """The refused claims, with the claim itself as JSON."""
    payload = F.to_json(F.struct(*CLAIM))
    return judged.where("reason is not null").select(stable_id("r", F.col("doc_id"), F.col("page_no"), F.col("reason"), payload).alias("reject_id"), "doc_id", "page_no", "reason", payload.alias("payload"))
