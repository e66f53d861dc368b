"""Counts and rates: the one-row summary, histograms, per-document reports, and the score against labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.vocab import INTERESTING


#: Marks facts that a person stated.
HAND_LABELLED = "labelled by hand"


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part.cast("double") / whole, 4)).otherwise(0.0)


def summary(facts: DataFrame, rejects: DataFrame, rels: DataFrame) -> DataFrame:
    """Kept, rejected, emitted, ungrounded, both rates, relationships and metrics: one row from three one-row aggregates."""
    f = facts.agg(F.count("*").alias("facts_kept"), F.count_distinct("metric_key").alias("metrics_discovered"))
    r = rejects.agg(F.count("*").alias("facts_rejected"), F.count_if(F.col("reason") == "quote_not_found").alias("ungrounded"))
    s = rels.agg(F.count("*").alias("relationships"), F.count_if(F.col("decided_by") == "llm").alias("llm_decided"))
    one = f.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(s)).withColumn("facts_emitted", F.col("facts_kept") + F.col("facts_rejected"))  # single rows
    return one.withColumn("hallucination_rate", rate(F.col("ungrounded"), F.col("facts_emitted"))).withColumn("rejection_rate", rate(F.col("facts_rejected"), F.col("facts_emitted")))


def whole_summary(facts: DataFrame, rejects: DataFrame, rels: DataFrame, documents: DataFrame, cached: DataFrame) -> DataFrame:
    """summary() with documents and pages, and the counts by label and reason as maps. facts may have extraction_model."""
    by = lambda df, column, name: histogram(df, column).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(name))
    pages = documents.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("page_count", "pages_total"), ("pages_scanned", "pages_candidate"), ("pages_skipped", "pages_skipped"))))
    hand = F.count_if(F.col("extraction_model") == HAND_LABELLED) if "extraction_model" in facts.columns else F.lit(0)
    labelled = facts.agg((F.coalesce(hand, F.lit(0)) == F.count("*")).alias("all_by_hand"), F.count("*").alias("_n")).select((F.col("all_by_hand") & (F.col("_n") > 0)).alias("is_reference_set"))
    one = summary(facts, rejects, rels)
    for row in (pages, cached.agg(F.count("*").alias("pages_extracted")), labelled, by(rejects, "reason", "rejects_by_reason"), by(rels, "label", "relationships_by_label")):
        one = one.crossJoin(F.broadcast(row))  # single rows
    return one


def extraction_score(whole: DataFrame, facts: DataFrame, evidence: DataFrame, rejects: DataFrame, gold_pages: DataFrame) -> DataFrame:
    """Everything that is known of an extraction, as rows (part, name, value): rates, buckets of confidence, match types, labelled pages."""
    row = lambda df, part, name, value: df.select(F.lit(part).alias("part"), F.col(name).alias("name") if name in df.columns else F.lit(name).alias("name"), F.col(value).cast("double").alias("value"))
    names = ["facts_emitted", "facts_kept", "facts_rejected", "ungrounded", "hallucination_rate", "rejection_rate", "metrics_discovered", "llm_decided", "pages_candidate", "pages_extracted", "pages_skipped"]
    rates = whole.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("double") for n in names)))).alias("name", "value"))
    parts = [row(rates, "rate", "name", "value"), row(histogram(evidence, "match_type"), "match", "match_type", "n"), row(histogram(page_recall(gold_pages, facts, rejects), "state"), "page", "state", "n")]
    buckets = confidence_buckets(facts)
    parts += [row(buckets, part, "bucket", part) for part in ("n", "grounding", "completeness")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def notes(whole: DataFrame) -> DataFrame:
    """What a reader should know before the figures: one line for each thing that was left undone."""
    read, candidates, n = F.col("pages_extracted").cast("string"), F.col("pages_candidate").cast("string"), F.col("documents").cast("string")
    short = F.when(F.col("pages_extracted") < F.col("pages_candidate"), F.concat(F.lit("Pages read: "), read, F.lit(" of "), candidates, F.lit("; all figures are over these.")))
    hand = F.when(F.col("is_reference_set"), F.lit("All facts are labelled by hand, so rates of refusal say nothing."))
    none = F.when(F.col("facts_emitted") == 0, F.concat(F.lit("No claim was made on any page of "), n, F.lit(" documents.")))
    return whole.select(F.explode(F.array_compact(F.array(short, hand, none))).alias("note"))


def accuracy(expected: DataFrame, negatives: DataFrame, got: DataFrame) -> DataFrame:
    """One row: labelled pairs, the share of them with the right label, negative controls and those that are no finding."""
    counts = reasoning_score(expected, got)
    right = counts.agg(F.sum("n").alias("labelled_pairs"), F.sum(F.when(F.col("expected") == F.col("got"), F.col("n")).otherwise(0)).alias("_right"))
    controls = reasoning_score(negatives.withColumn("label", F.lit("none")), got)
    passed = controls.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("negative_controls"), F.coalesce(F.sum(F.when(~F.coalesce(F.col("got"), F.lit("")).isin("CORROBORATES", "CONTRADICTS"), F.col("n"))), F.lit(0)).alias("negative_controls_passed"))
    return right.withColumn("relationship_accuracy", rate(F.col("_right"), F.col("labelled_pairs"))).drop("_right").crossJoin(F.broadcast(passed))  # single rows


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def confidence_buckets(facts: DataFrame) -> DataFrame:
    bucket = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return facts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.bround(F.avg("grounding_conf"), 3).alias("grounding"), F.bround(F.avg("frame_completeness"), 3).alias("completeness"))


def documents_with_counts(documents: DataFrame, facts: DataFrame, rejects: DataFrame) -> DataFrame:
    count = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(n))
    both = documents.join(count(facts, "n_facts"), "doc_id", "left").join(count(rejects, "n_rejects"), "doc_id", "left")
    return both.fillna(0, ["n_facts", "n_rejects"])


def ingest_report(judged: DataFrame) -> DataFrame:
    """By document: emitted, kept, rejected and both rates."""
    refused = F.count_if(F.col("reason").isNotNull())
    by = judged.groupBy("doc_id").agg(F.count("*").alias("emitted"), refused.alias("rejected"), F.count_if(F.col("reason") == "quote_not_found").alias("ungrounded"))
    return by.select("doc_id", "emitted", (F.col("emitted") - F.col("rejected")).alias("kept"), "rejected", rate(F.col("rejected"), F.col("emitted")).alias("rejection_rate"), rate(F.col("ungrounded"), F.col("emitted")).alias("hallucination_rate"))


def metrics(facts: DataFrame) -> DataFrame:
    """Each metric key with the label seen first (by fact id) and its number of facts, most frequent first."""
    return facts.groupBy("metric_key").agg(F.min_by("metric_raw", "fact_id").alias("label"), F.count("*").alias("n_facts")).orderBy(F.desc("n_facts"), "metric_key")


def best_per_label(full: DataFrame, dimensions: tuple[str, ...] | None = None) -> DataFrame:
    """The best relationship of each label: across documents first, then by confidence."""
    r = full.where(F.col("dimension").isin(*dimensions)) if dimensions else full
    # an aggregate with partial results: there are few labels, and a window would put all rows of one into one task
    order = F.struct(-F.coalesce(F.col("cross_document").cast("int"), F.lit(-1)), -F.coalesce("confidence", F.lit(float("-inf"))), "rel_id")
    return r.groupBy("label").agg(F.min_by(F.struct(*(c for c in r.columns if c != "label")), order).alias("x")).select("label", "x.*").select(r.columns)


def highlight(full: DataFrame) -> DataFrame:
    """The one to show: an interesting reconciliation, else the best contradiction, corroboration, reconciliation or gap."""
    order = ["CONTRADICTS", "CORROBORATES", "CONTEXTUALLY_RECONCILED", "INSUFFICIENT_EVIDENCE"]
    rank = F.when((F.col("label") == "CONTEXTUALLY_RECONCILED") & F.col("dimension").isin(*INTERESTING), 0)
    for i, label in enumerate(order, 1):
        rank = rank.when(F.col("label") == label, i)
    return full.orderBy(rank, F.desc("cross_document"), F.desc("confidence"), "rel_id").limit(1)


def best_of_fact(rels: DataFrame) -> DataFrame:
    """For every fact the relationship with most confidence."""
    touching = rels.select(F.explode(F.array("fact_a", "fact_b")).alias("fact_id"), "rel_id", "label", "confidence")
    return touching.groupBy("fact_id").agg(F.max_by(F.struct("rel_id", "label", "confidence"), F.struct("confidence", "rel_id")).alias("x")).select("fact_id", "x.*")


def reasoning_score(expected: DataFrame, got: DataFrame) -> DataFrame:
    """expected (fact_a, fact_b, label), got (fact_a, fact_b, label): counts by expected and given label."""
    key = lambda d, n: d.select(F.least("fact_a", "fact_b").alias("x"), F.greatest("fact_a", "fact_b").alias("y"), F.col("label").alias(n))
    return key(expected, "expected").join(key(got, "got"), ["x", "y"], "left").groupBy("expected", "got").agg(F.count("*").alias("n"))


def page_recall(gold: DataFrame, facts: DataFrame, rejects: DataFrame) -> DataFrame:
    """Gold pages (doc_id, page_no): with a fact, with refused claims only, or unread."""
    pages = lambda d, n: d.select("doc_id", "page_no").distinct().withColumn(n, F.lit(True))
    seen = gold.join(pages(facts, "f"), ["doc_id", "page_no"], "left").join(pages(rejects, "r"), ["doc_id", "page_no"], "left")
    return seen.select("doc_id", "page_no", F.when(F.col("f"), "fact").when(F.col("r"), "refused").otherwise("unread").alias("state"))
