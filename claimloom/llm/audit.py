"""Filter interaction audit: what every filter removes at every step of every order, by long-form window evaluation.

1. Each row's failures become one mask, a bit for each filter. Filters on a text alone are expressions over the row; the filter for repeats
   fails all rows of a text but those of its least id, table-wide.
2. Rows are summed into cells (part, mask): 2 ** filters for each part at most, however hot a part or a text is.
3. Cells are unpivoted against the steps of all orders (explode of a literal). Within a cell and an order a running bit-or over the steps before
   says whether an earlier filter has removed it; conditional sums over the cells of a part give the counts of a step, and a window over
   part and filter adds up what a filter removes over all orders.

Repeats are found without meeting in one task: texts are known by two 64-bit hashes and their length, the least id of each comes from a partial
aggregate, and rows meet it by id and text, so a text with very many copies is spread over its ids.

Edge cases: a null text counts as empty (no words, so it fails LENGTH; no characters, so it does not fail CAPITALS); a null id neither repeats nor
makes others repeat, and has no labels; rows with equal id and text are no repeats of each other; of several labels for an id the greatest
counts, a null label is 0; a null part is the empty string; an empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, shared_dir

#: Words: what stands between these characters.
BLANKS = r"[\x20\x09-\x0D]+"
#: Repeated texts, or labels, that are broadcast; more are joined with a shuffle.
IDS = 1 << 18
#: Letter of the filter that fails repeated texts.
REPEATED = "E"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on a text (not null) and its words, by letter."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, part: str = "source", filters=text_filters) -> DataFrame:
    """doc_id, part, mask for each row: bit i is set if the row fails the i-th letter."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.withColumn("words", F.filter(F.split("text", BLANKS), lambda w: w != ""))
    failed = filters(F.col("text"), F.col("words"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed.values())), F.lit(0))
    own = own.select("doc_id", "part", bits.alias("mask"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit("2"), "text").alias("i"), F.octet_length("text").alias("size"))
    own = keep(own, "masks")
    same = ["h", "i", "size"]
    first = own.where("doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", *same)
    first = keep(first, "first")
    # only texts with several rows can repeat; their other rows fail
    many = first.select(*same)
    repeated = own.where("doc_id is not null").join(F.broadcast(many) if many.count() <= IDS else many, same, "left_semi")
    repeated = repeated.join(first, ["doc_id", *same], "left_anti").select("doc_id", "part", "mask", F.lit(1).alias("sign"))
    bit = 1 << len(failed)
    # a repeated row leaves the cell that its text's mask alone would give it
    moved = repeated.unionByName(repeated.withColumn("sign", F.lit(-1)))
    whole = own.select("doc_id", "part", "mask", F.lit(1).alias("sign"))
    return whole.unionByName(moved.withColumn("mask", F.when(F.col("sign") > 0, F.col("mask") + bit).otherwise(F.col("mask"))))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows with equal failures summed. rows: doc_id, part, mask, sign."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 or t = 1")
    good, toxic = (F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)) for c in "qt")
    known = keep(known.select("doc_id", good.alias("good"), toxic.alias("toxic")), "labels")
    # rows without a label need no join
    some = rows.where("doc_id is not null").join(F.broadcast(known) if known.count() <= IDS else known, "doc_id").select("part", "mask", F.lit(0).alias("n"), (F.col("sign") * F.col("good")).alias("good"), (F.col("sign") * F.col("toxic")).alias("toxic"))
    every = rows.select("part", "mask", F.col("sign").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return every.unionByName(some).groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


def audit(found: DataFrame, letters: str) -> DataFrame:
    """The long form: one row per part, order and step. found: part, mask, n, good, toxic."""
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(letters)))
    bit = F.expr(f"shiftleft(1, instr('{letters}', filter) - 1)")
    rows = found.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).withColumn("step", F.col("at") + 1).withColumn("bit", bit)
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("mask").bitwiseAND(F.col("bit")) > 0
    rows = rows.withColumn("gone", F.col("mask").bitwiseAND(F.coalesce(F.bit_or("bit").over(before), F.lit(0))) > 0).withColumn("fails", failed)
    total = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")
    now = F.col("fails") & ~F.col("gone")
    by = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(~F.col("fails") & ~F.col("gone")).alias("kept"),
        total(now).alias("removed"),
        total(F.col("fails") & F.col("gone")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(now, "good").alias("good_lost"),
        total(now, "toxic").alias("toxic_lost"),
    )
    return by.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    rows = masks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return audit(keep(cells(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")), "cells"), "ABCD" + REPEATED)


QUERIES = {"op12_filter_audit": op12}

SQL = {
    "op12_filter_audit": r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, max(quality) as q, max(toxic) as x from labels where doc_id is not null group by doc_id),
m as (
  select part, coalesce(l.q = 1, false) as good, coalesce(l.x = 1, false) as toxic,
    len(ws) < 200 as fa,
    100 * len(list_distinct(ws)) < 50 * len(ws) as fb,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) as fc,
    regexp_matches(t, '[#$%&*|]') as fd,
    coalesce(w.doc_id > first, false) as fe
  from w left join l using (doc_id)),
c as (select part, fa, fb, fc, fd, fe, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
  where a.f <> b.f and a.f <> c.f and a.f <> d.f and a.f <> e.f and b.f <> c.f and b.f <> d.f and b.f <> e.f and c.f <> d.f and c.f <> e.f and d.f <> e.f),
s as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
r as (
  select part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) as letter,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then fa when 'B' then fb when 'C' then fc when 'D' then fd else fe end) as fails
  from c, s),
g as (
  select *, list_contains(fails, letter) as now, len(list_filter(fails, lambda x: instr(filter_order, x) < step)) > 0 as gone from r),
b as (
  select part, filter_order, step, letter,
    coalesce(sum(n) filter (not now and not gone), 0) as kept,
    coalesce(sum(n) filter (now and not gone), 0) as removed,
    coalesce(sum(n) filter (now and gone), 0) as redundant,
    coalesce(sum(n) filter (fails = [letter]), 0) as unique_fails,
    coalesce(sum(good) filter (now and not gone), 0) as good_lost,
    coalesce(sum(toxic) filter (now and not gone), 0) as toxic_lost
  from g group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley
from b"""
}
