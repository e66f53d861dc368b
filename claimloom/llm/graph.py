"""Connected components with DataFrame operations only, by alternating large-star and small-star steps.

Every step keeps the edges distributed and hangs neighbours on the least node around; it ends when a round changes nothing. Rounds grow
with the logarithm of the component size. The minimum of a node's neighbours is aggregated before the shuffle, and the joins are plain
equi-joins, so a node with very many neighbours is split by skew handling. Each round is written to the shared
folder and the one before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v); returns edges that point from the greater node to the lesser."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
    near = both if large else both.where("x < n")
    least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
    moved = near.join(least, "n")
    if large:
        made = moved.where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        made = moved.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the least node reachable. Only nodes with an edge to another node appear; nulls have no edges."""
    now = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new["n"] == 0 or new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark, last = new, now
        now = keep(_star(_star(now, True), False), "edges")
        forget(last)


def merged(group: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """group (node, component) with further links (a, b): only the components that these connect are computed anew."""
    of = lambda side: group.select(F.col("node").alias(side), F.col("component").alias("c" + side))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    new = components(ends, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("least"))
    known = group.join(new, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    alone = new.join(group.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("least").alias("component"))
    return keep(known.unionByName(alone), name)
