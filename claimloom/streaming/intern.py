"""Metrics as they are interned: the label first seen, and how many facts there are, kept as the state of a stream of facts and deletions.

The state of a key is a map of its facts to their labels (in the state store, so it is as large as it has to be), their number, and the first fact. A change
reads and writes only the entries that it touches; only the deletion of the first fact looks for the next one. Keys are salted by fact, so a metric that
a third of all facts share is spread over SALTS states; readers add these up. "First" is the least fact_id, so the result does not depend on how changes
are split into batches; a fact that comes twice, and a deletion of an unknown fact, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SALTS = 16
STATES = "metric_key string, salt int, first string, label string, n long"
#: The store of states that changes single entries of a map.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Intern(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getMapState("facts", "fact_id string", "label string")
        self.known = handle.getValueState("known", "first string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        first, n = self.known.get() if self.known.exists() else (None, 0)
        for some in rows:
            for fact, label, gone in zip(some["fact_id"], some["label"], some["gone"], strict=True):
                there = self.facts.containsKey((fact,))
                if gone and there:
                    self.facts.removeKey((fact,))
                    n -= 1
                    if fact == first:
                        first = min((k[0] for k in self.facts.keys()), default=None)
                elif not gone and not there:
                    self.facts.updateValue((fact,), (label,))
                    n += 1
                    first = fact if first is None else min(first, fact)
        self.known.update((first, n))
        label = self.facts.getValue((first,))[0] if first is not None else None
        yield pd.DataFrame({"metric_key": [key[0]], "salt": [key[1]], "first": [first], "label": [label], "n": [n]})

    def close(self) -> None:
        pass


def interned(changes: DataFrame) -> DataFrame:
    """A stream of changes (metric_key, fact_id, label, gone; none of them null, deletions after what they delete) as a stream of states."""
    salted = changes.withColumn("salt", F.pmod(F.xxhash64("fact_id"), F.lit(SALTS)).cast("int"))
    return salted.groupBy("metric_key", "salt").transformWithStateInPandas(Intern(), outputStructType=STATES, outputMode="Update", timeMode="None")


def latest(states: DataFrame) -> DataFrame:
    """metric_key, label, n_facts from the states of all batches (with batch_id); metrics without facts are gone."""
    now = states.groupBy("metric_key", "salt").agg(F.max_by(F.struct("first", "label", "n"), "batch_id").alias("x")).select("metric_key", "x.*").where("n > 0")
    return now.groupBy("metric_key").agg(F.min_by("label", "first").alias("label"), F.sum("n").alias("n_facts"))


def run(spark: SparkSession, changes: DataFrame, folder: str) -> DataFrame:
    """Take what a stream has now and return latest(). Batches are written below the folder by their number, so one that is tried again replaces itself."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        put = lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/states/batch_id={i}")
        interned(changes).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    return latest(spark.read.schema(f"{STATES}, batch_id long").parquet(f"{folder}/states"))
