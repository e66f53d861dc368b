"""Claims as a stream: each micro-batch of new facts meets itself and the facts stored before, never old with old."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.blocking import pairs_for_new
from claimloom.operators.build import judge_pairs, relationships


def relate_new(new: DataFrame, old: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relationships that touch a new fact."""
    return relationships(judge_pairs(pairs_for_new(new, old), new.unionByName(old), aliases))


def on_batch(read_store: Callable[[], DataFrame], append: Callable[[DataFrame, DataFrame], None], aliases: DataFrame) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: facts that are stored already are dropped, so a batch that is tried again changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        old = read_store()
        new = batch.dropDuplicates(["fact_id"]).join(old, "fact_id", "left_anti").persist()
        append(new, relate_new(new, old, aliases))
        new.unpersist()

    return run


def on_history(history, append: Callable[[DataFrame, int], None], aliases: DataFrame) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch, over a history in buckets (sources.history) that has a column `batch` besides those of facts.

    A batch reads what earlier batches have stored of its own entities, and only those buckets are written anew. append(relationships, batch id) must
    replace what the same batch has appended before. What a batch itself has stored does not count as old, so one that is tried again, from before,
    between or after its two writes, ends in the same tables."""

    def run(batch: DataFrame, number: int) -> None:
        old = history.around(batch).where(F.col("batch") < number).drop("batch")
        new = batch.dropDuplicates(["fact_id"]).join(old.select("fact_id"), "fact_id", "left_anti").persist()
        append(relate_new(new, old, aliases), number)
        history.merge(new.withColumn("batch", F.lit(number).cast("long")), [history.by, "fact_id"])
        new.unpersist()

    return run


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Claims by type and window of event time, with a watermark (batch or stream)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
