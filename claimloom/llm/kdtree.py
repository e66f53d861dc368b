"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

The dimensions are the id, the size in bytes, the language and the source. Each is written as one 62-bit number: 40 bits that sort like the
value (strings by their rank among the distinct ones, ids by their distance from the least, in units that make the largest fit) and below them
a hash of the document, so that a hot source or a group of copies can be divided anywhere. A node that is to hold k leaves is split along its
widest dimension (range of the values in the node, as a share of the whole range) at the weighted quantile floor(k/2)/k of its bytes. All nodes
of a level are split together: a histogram for each node is aggregated, the bin with the quantile is divided again, until the bin's weight
no longer matters. What reaches the driver is sums by node and bin, about a million or 16 for each node, never rows; what is known of
the nodes is joined as a broadcast table of a row each.

The order within a shard (`slot`) is counted in cells of a shard, so no shard is sorted in one task.

Edge cases: null text has no bytes; nulls in any metadata column count as their least value; rows equal in everything stay together; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IDS, forget, keep, shared_dir

SHARDS = 40
#: Bins for each node, as long as all nodes of a level have no more than SUMS together.
BINS, SUMS = 2048, 1 << 20
#: A bin is divided until it holds less than this share of its node's bytes.
FINE = 0.00002
_VALUE, _TIE = 40, 22
DIMENSIONS = ("id", "bytes", "language", "origin")


def _ranks(docs: DataFrame, column: str) -> DataFrame:
    """value, rank: the place of each distinct value in their order. Ranges are sorted by their own tasks; what is before a range is a sum over ranges."""
    values = docs.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).distinct().orderBy("value")
    values = keep(values.withColumn("part", F.spark_partition_id()), "values")
    sizes = values.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return values.withColumn("inside", inside).join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("inside")).alias("rank"))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions as numbers, one narrow row for each document."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body).alias("text_crc32"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << _TIE)).alias("tie"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
    )
    rows = keep(rows, "narrow")
    for column in ("lang", "source"):
        ranks = keep(_ranks(rows, column), "ranks")
        ranks = F.broadcast(ranks) if ranks.count() <= IDS else ranks
        rows = rows.join(ranks.withColumnsRenamed({"value": column, "rank": column + "_rank"}), column).drop(column)
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    unit = max(0, ((hi or 0) - (lo or 0)).bit_length() - _VALUE + 1)
    number = F.coalesce(F.shiftright("doc_id", unit) - ((lo or 0) >> unit) + 1, F.lit(0))
    place = lambda v: (F.shiftleft(v.cast("long"), _TIE) + F.col("tie"))
    return rows.select("doc_id", "size", "text_crc32", "tie", place(number).alias("id"), place(F.col("size")).alias("bytes"), place(F.col("lang_rank")).alias("language"), place(F.col("source_rank")).alias("origin"))


def _nodes(rows: DataFrame, known: list[tuple], columns: str) -> DataFrame:
    """What is known of nodes, a row each, to be joined."""
    return F.broadcast(rows.sparkSession.createDataFrame(known, "node int, " + columns))


#: The value of a row in the dimension numbered d.
_ALONG = f"array({', '.join(DIMENSIONS)})[d]"


def _bounds(here: DataFrame, state: dict[int, dict]) -> None:
    """Sets `bound` of each node: the value of its dimension below which its target lies."""
    while open_ := {n: s for n, s in state.items() if s["bound"] is None}:
        bins = max(16, min(BINS, SUMS // len(open_)))
        step = {n: max(1, -(-(s["hi"] - s["lo"]) // bins)) for n, s in open_.items()}
        known = _nodes(here, [(n, s["d"], s["lo"], s["hi"], step[n]) for n, s in open_.items()], "d int, lo long, hi long, step long")
        inside = here.join(known, "node").withColumn("value", F.expr(_ALONG)).where("value >= lo and value < hi")
        by: dict[int, list] = {}
        for r in inside.groupBy("node", F.expr("(value - lo) div step").alias("bin")).agg(F.sum("size").alias("w")).collect():
            by.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for n, s in open_.items():
            below, at, w = s["below"], 0, 0
            for at, w in sorted(by[n]):
                if below + w >= s["target"]:
                    break
                below += w
            else:
                below -= w  # rounding put the target beyond the last bin
            lo = s["lo"] + at * step[n]
            if step[n] == 1 or w <= FINE * s["weight"]:
                s["bound"] = lo + step[n] if below + w - s["target"] <= s["target"] - below else lo
            s |= {"lo": lo, "hi": min(s["hi"], lo + step[n]), "below": below}


def grow(rows: DataFrame, shards: int) -> DataFrame:
    """rows with `node`, the number of the leaf that each lies in. A node is named by its first leaf; sizes has how many it is to hold."""
    sizes = {0: shards}
    rows = rows.withColumn("node", F.lit(0))
    whole: dict[str, int] = {}
    while any(k > 1 for k in sizes.values()):
        here = rows.join(_nodes(rows, [(n, True) for n, k in sizes.items() if k > 1], "open boolean"), "node").drop("open")
        extent = here.groupBy("node").agg(F.sum("size").alias("weight"), *(f(d).alias(g + d) for d in DIMENSIONS for f, g in ((F.min, "lo_"), (F.max, "hi_")))).collect()
        state = {}
        for r in extent:
            width = {d: (r["hi_" + d] >> _TIE) - (r["lo_" + d] >> _TIE) for d in DIMENSIONS}
            whole = whole or {d: max(1, w) for d, w in width.items()}
            d = max(DIMENSIONS, key=lambda d, width=width: width[d] / whole[d])
            k = sizes[r["node"]]
            state[r["node"]] = {"d": DIMENSIONS.index(d), "lo": r["lo_" + d], "hi": r["hi_" + d] + 1, "below": 0, "target": r["weight"] * (k // 2) / k, "weight": r["weight"], "bound": None}
        _bounds(here, state)
        if state:
            known = _nodes(rows, [(n, s["d"], s["bound"], sizes[n] // 2) for n, s in state.items()], "d int, bound long, half int")
            moved = rows.join(known, "node", "left").withColumn("node", F.expr(f"cast(node + coalesce(if({_ALONG} >= bound, half, 0), 0) as int)")).drop("d", "bound", "half")
            moved = keep(moved, "nodes")
            forget(rows)
            rows = moved
        sizes = {n + add: k for at, size in sizes.items() for n, add, k in (((at, 0, size // 2), (at, size // 2, size - size // 2)) if size > 1 else ((at, 0, 1),))}
    return rows


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. With target_bytes as many leaves as bring each below it, else `shards`."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = keep(metadata(docs), "metadata")
    if target_bytes:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed = grow(rows, shards).withColumnRenamed("node", "shard")
    cells = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) * 4 // shards))
    placed = placed.withColumn("cell", (F.col("tie") * cells / (1 << _TIE)).cast("int")).drop(*DIMENSIONS)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("tie", "doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("own", own).join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_kd_sharding": op3}
SQL: dict[str, str] = {}
