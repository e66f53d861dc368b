"""Raw claims to facts: keys, quantity, period, basis and scores, as staged projections.

Input columns: doc_id, page_no, fact_kind, entity, metric, value, value_text, unit, magnitude, period, basis (map), quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import basis as B
from claimloom.functions.names import entity_key, metric_key
from claimloom.functions.period import with_period
from claimloom.functions.quantity import with_quantity


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id from a natural key: the same on every run."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 12))


def normalize(claims: DataFrame) -> DataFrame:
    """Adds entity_key, metric_key, quantity, period_of, basis_of and qualifiers."""
    c = F.col
    n = with_period(claims, "period_of", "period")
    n = with_quantity(n, "quantity", "value", "unit", "magnitude", "quote")
    n = B.with_basis(n, "_stated", "basis", "quote")
    return n.withColumns(
        {"entity_key": entity_key(c("entity")), "metric_key": metric_key(c("metric")), "basis_of": B.merged(c("_stated"), B.infer_from_label(c("metric"))), "qualifiers": B.leftover(c("basis"))}
    ).drop("_stated")


def evidence_id() -> Column:
    """Evidence is a quote on a page of a document."""
    return stable_id("e", F.col("doc_id"), F.col("page_no"), F.col("quote"))


def completeness(entity: Column, metric: Column, period: Column, unit: Column, basis: Column) -> Column:
    """The share of the five parts of a frame that are there, to 3 places."""
    has = lambda x: F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0)
    parts = has(entity != "") + has(metric != "") + has(period.isNotNull()) + has((unit != "") & (unit != "unknown")) + has(F.size(basis) > 0)
    return F.bround(parts / F.lit(5.0), 3)


def confidence(extraction: Column, grounding: Column, complete: Column, period_confidence: Column) -> Column:
    return F.bround(extraction * grounding * (F.lit(0.5) + F.lit(0.5) * complete) * F.coalesce(period_confidence, F.lit(0.6)), 3)


def to_facts(admitted: DataFrame, fact_id: str | None = None) -> DataFrame:
    """Fact rows from normalized claims with extraction_conf and grounding_conf. fact_id: a column that names them; else an id of their content."""
    c = F.col
    scored = admitted.withColumn("frame_completeness", completeness(c("entity_key"), c("metric_key"), c("period_of.start"), c("quantity.unit"), c("basis_of")))
    return scored.select(
        (c(fact_id) if fact_id else stable_id("f", c("doc_id"), c("page_no"), c("entity"), c("metric"), c("value"), c("value_text"), c("period"), c("quote"))).alias("fact_id"),
        "doc_id", "page_no", "quote", evidence_id().alias("evidence_id"),
        F.when((c("fact_kind") == "measurement") & c("quantity").isNull(), "state").otherwise(c("fact_kind")).alias("fact_kind"),
        c("entity").alias("entity_raw"), "entity_key", c("metric").alias("metric_raw"), "metric_key", c("value").alias("value_raw"),
        c("quantity.value").alias("value_num"), "value_text", c("quantity.tolerance").alias("value_tol"), c("unit").alias("unit_raw"), c("quantity.unit").alias("unit_canon"),
        c("quantity.magnitude").alias("magnitude_raw"), c("period").alias("period_raw"), c("period_of.start").alias("period_start"), c("period_of.end").alias("period_end"),
        c("period_of.grain").alias("period_grain"), c("basis_of").alias("basis"), "qualifiers", "extraction_conf", "grounding_conf", "frame_completeness",
        confidence(c("extraction_conf"), c("grounding_conf"), c("frame_completeness"), c("period_of.confidence")).alias("confidence"),
    )
