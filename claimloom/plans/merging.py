"""Statistics as states that are merged: a batch adds its own, and no older fact is read again.

A state is a few rows: counters, which are added, and sketches of distinct values, which are united. Merging is associative, so batches may be merged in
any order or tree. Counters are exact. Sketches have 2 ** LG_K registers: their estimates have a standard error of about 1.04 / sqrt(2 ** LG_K), 0.8 %.

A deletion is a batch of the deleted rows with `sign` -1: counters go down; sketches cannot forget, so a distinct count after deletions is an upper
estimate until the state is made anew (exact counts by key after deletions are what streaming.intern keeps).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14


def state(rows: DataFrame, counters: dict, distinct: dict, sign: int = 1) -> DataFrame:
    """name, n, sketch: counters (name: condition) and sketches (name: column) of a batch, from one pass over it."""
    one = rows.agg(
        *(F.coalesce(F.sum(F.when(c, sign).otherwise(0)), F.lit(0)).cast("long").alias(f"n{i}") for i, c in enumerate(counters.values())),
        *(F.hll_sketch_agg(c, LG_K).alias(f"s{i}") for i, c in enumerate(distinct.values())),
    )
    entry = lambda name, n, s: F.struct(F.lit(name).alias("name"), n.cast("long").alias("n"), s.cast("binary").alias("sketch"))
    entries = [entry(k, F.col(f"n{i}"), F.lit(None)) for i, k in enumerate(counters)] + [entry(k, F.lit(None), F.col(f"s{i}")) for i, k in enumerate(distinct)]
    return one.select(F.inline(F.array(*entries)))


def merge(states: list[DataFrame]) -> DataFrame:
    """One state of several."""
    every = functools.reduce(DataFrame.unionByName, states)
    return every.groupBy("name").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def shown(merged: DataFrame) -> DataFrame:
    """name, value: counters as they are, sketches as estimates."""
    return merged.select("name", F.coalesce("n", F.hll_sketch_estimate("sketch")).alias("value"))
