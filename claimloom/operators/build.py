"""Facts to relationships: pairs, verdicts, aliases, suppression and explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.base import U, strip

from .blocking import met_pairs
from .compare import SUPPRESSED, compare, sides
from .explain import explain, told
from .normalize import stable_id

ALIAS = "key_a string, key_b string, same boolean, rationale string, decided_by string"
BUDGET = 40


def clean_label(x):
    """A label that is safe to show to an adjudicator: one line, printable, 120 characters at most."""
    return F.substring(strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, U + r"\s", " "), r"\p{C}", ""), " +", " ")), 1, 120)


def known_aliases(aliases: DataFrame) -> DataFrame:
    """One row for each unordered pair of keys."""
    rows = aliases.select(F.least("key_a", "key_b").alias("ka"), F.greatest("key_a", "key_b").alias("kb"), "same", "rationale", "decided_by")
    return rows.groupBy("ka", "kb").agg(F.max(F.struct("same", "rationale", "decided_by")).alias("x")).select("ka", "kb", "x.*")


def judge_pairs(pairs: DataFrame, facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every pair (fact_a, fact_b) of facts with its verdict, and what is known of its two metric keys."""
    return judge(sides(pairs, facts), aliases)


def judge(two: DataFrame, aliases: DataFrame, words: bool = True) -> DataFrame:
    """The same for pairs that have both facts with them, as structs a and b. Without words (traces and questions) facts need the columns of a FRAME only.

    Aliases are what adjudicators answered, some tens for a run, and go to where the pairs are: joined by their keys, pairs would be shuffled, all of one metric to
    one task."""
    two = two.withColumns({"ka": F.least("a.metric_key", "b.metric_key"), "kb": F.greatest("a.metric_key", "b.metric_key")})
    two = two.join(F.broadcast(known_aliases(aliases)), ["ka", "kb"], "left").withColumnRenamed("same", "alias")
    return compare(two, words)


def questions(judged: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The distinct metric-key pairs that rules cannot settle; as many as may be asked, in a fixed order."""
    asked = judged.where("needs_adjudication").groupBy("ka", "kb").agg(F.min(F.struct(clean_label(F.col("a.metric_raw")).alias("label_a"), clean_label(F.col("b.metric_raw")).alias("label_b"))).alias("x"))
    return asked.select("ka", "kb", "x.*").orderBy("ka", "kb").limit(budget)


def adjudicate(judged: DataFrame, answer: Callable, budget: int = BUDGET) -> DataFrame:
    """New alias rows from a pluggable adjudicator: answer(DataFrame of questions) -> DataFrame ka, kb, same, confidence, rationale."""
    said = answer(questions(judged, budget)).where("confidence >= 0.6")
    return said.select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b"), "same", "rationale", F.lit("llm").alias("decided_by"))


def _reported(judged: DataFrame) -> DataFrame:
    """Unsettled metrics are dropped, unrelated pairs and time series suppressed."""
    return judged.where(~F.col("needs_adjudication") & ~F.col("label").isin(*SUPPRESSED))


def relationships(judged: DataFrame, *more) -> DataFrame:
    """The pairs worth reporting, in words. more: further columns of judged."""
    kept = told(_reported(judged))
    said = F.concat(explain(), F.when(F.col("alias").isNotNull() & (F.coalesce("rationale", F.lit("")) != ""), F.concat(F.lit(" "), "rationale")).otherwise(""))
    return _verdict(kept, "checks", said.alias("explanation"), *more)


def verdicts(judged: DataFrame, *more) -> DataFrame:
    """The same without words, for which judged needs none."""
    return _verdict(_reported(judged), *more)


def _verdict(kept: DataFrame, *more) -> DataFrame:
    by = F.when(F.col("decided_by") == "llm", "llm").otherwise("rule").alias("decided_by")
    return kept.select(stable_id("rel", F.col("fact_a"), F.col("fact_b")).alias("rel_id"), "fact_a", "fact_b", "label", "dimension", "confidence", "value_delta", by, *more)


def build(facts: DataFrame, aliases: DataFrame, cross_document_only: bool = False) -> DataFrame:
    """All relationships among facts (with doc_id, page_no and, for explanations, filename)."""
    return relationships(judge(met_pairs(facts, cross_document_only), aliases))


def report(judged: DataFrame) -> DataFrame:
    """One row: pairs, written, suppressed, time series, unresolved."""
    count = lambda test: F.count_if(test).cast("long")
    open_, out = F.col("needs_adjudication"), F.col("label").isin(*SUPPRESSED)
    return judged.agg(F.count("*").alias("pairs"), count(~open_ & ~out).alias("written"), count(~open_ & out).alias("suppressed"), count(F.col("label") == "TIME_SERIES").alias("time_series"), count(open_).alias("unresolved"))
