"""Accents of every script, nested periods, labels with many parentheses, hot blocks, exports as one file."""

import datetime
import itertools
import random
import unicodedata

from pyspark.sql import functions as F


def test_accents_of_every_script(spark):
    from claimloom.functions.base import strip_accents

    every = [f"x{chr(i)}y" for i in [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]] + ["한국은행", "été ﬁn ½ Å", "", None]
    got = spark.createDataFrame([(s,) for s in every], "s string").select("s", strip_accents(F.col("s")).alias("p")).collect()
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    assert [r.s for r in got if r.p != (None if r.s is None else plain(r.s))] == []


def test_periods_nested_at_any_depth(spark):
    from claimloom.functions.period import periods

    texts = ["three months ended " * k + "30 june 2024" for k in range(1, 9)] + ["for the year ended quarter ended six months ended nine months ended 31 march 2023", "year ended " * 30 + "2021-22", "ended", "year ended year ended"]
    got = {r.raw: r.period_of for r in periods(spark.createDataFrame([(t,) for t in texts], "raw string")).collect()}
    day = datetime.date
    assert all((got[t].start, got[t].end, got[t].grain) == (day(2024, 4, 1), day(2024, 6, 30), "quarterly") for t in texts[:8])
    assert got[texts[8]].end == day(2023, 3, 31) and got[texts[9]].end == day(2022, 3, 31) and got[texts[9]].grain == "annual"
    assert "ended" not in got and "year ended year ended" not in got


def test_labels_with_many_parentheses(spark):
    from claimloom.functions.names import metric_key

    labels = {"net profit margin (npm) growth": "npm_growth", "b (x) c (y) d (z) big fat thing (bft) (q) (r) net profit margin (npm)": "b_c_d_bft_npm", "open (never closed": "open_never_closed", "()" * 40 + "x": "x"}
    got = {r.s: r.k for r in spark.createDataFrame([(s,) for s in labels], "s string").select("s", metric_key(F.col("s")).alias("k")).collect()}
    assert got == labels


def test_hot_blocks_are_dealt_out(spark):
    from claimloom.operators.blocking import block_pairs, candidate_pairs

    rng = random.Random(2)
    rows = [(f"f{i:04}", f"d{i % 3}", "hot" if i < 300 else rng.choice("abc"), "m" if i % 4 else None) for i in range(420)]
    facts = spark.createDataFrame(rows, "fact_id string, doc_id string, entity_key string, metric_key string")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2:] == b[2:] and a[3] is not None}
    for block in (1, 7, 2048):
        got = [(r.a_fact_id, r.b_fact_id) for r in block_pairs(facts, ["entity_key", "metric_key"], block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {(r.fact_a, r.fact_b) for r in candidate_pairs(facts.where("metric_key is not null")).collect()} == want


def test_export_as_one_dated_file(spark, tmp_path):
    from claimloom.plans.ledger import write_dated_csv

    df = spark.range(5000).select(F.col("id").alias("n"), F.concat(F.lit('a "quoted", '), F.col("id").cast("string")).alias("said")).repartition(9)
    day = datetime.date(2024, 2, 29)
    for table in (df.limit(0), df):  # the second replaces the first
        path = write_dated_csv(table, f"file://{tmp_path}", "facts", ["n"], day)
    assert path.endswith("/facts-2024-02-29.csv") and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["facts-2024-02-29.csv"]
    lines = (tmp_path / "facts-2024-02-29.csv").read_text().splitlines()
    assert lines[0] == "n,said" and [int(x.split(",")[0]) for x in lines[1:]] == list(range(5000))
    back = spark.read.option("header", True).option("escape", "\\").csv(path)
    assert back.count() == 5000
    empty = write_dated_csv(df.limit(0), f"file://{tmp_path}", "none", ["n"], day)
    assert open(empty.removeprefix("file:")).read() == "n,said\n" if not empty.startswith("file://") else open(empty.removeprefix("file://")).read() == "n,said\n"


def test_pairs_bring_both_facts_with_them(spark):
    """Equal to the pairs of all facts looked up by id, whether blocks meet whole or are dealt out, for near metrics in either order of ids."""
    from claimloom.operators.blocking import met_pairs
    from claimloom.operators.compare import sides

    rng = random.Random(4)
    rows = [(f"f{rng.randrange(10**6):06}{i:03}", f"d{i % 3}", rng.choice("ab"), rng.choice(["revenue", "revenue_from_operations", "profit", None]), {"vintage": str(i)} if i % 5 else None, float(i)) for i in range(90)]
    facts = spark.createDataFrame(rows, "fact_id string, doc_id string, entity_key string, metric_key string, basis map<string,string>, value_num double")
    near = {("revenue", "revenue_from_operations"), ("revenue_from_operations", "revenue")}
    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if a[2] == b[2] and a[3] and b[3] and (a[3] == b[3] or (a[3], b[3]) in near)}
    shown = lambda df: sorted(map(str, df.select("fact_a", "fact_b", "a", "b").collect()))
    known = shown(sides(spark.createDataFrame(sorted(want), "fact_a string, fact_b string"), facts))
    for block in (3, 2048):
        assert shown(met_pairs(facts, block=block)) == known
    across = {(r.fact_a, r.fact_b) for r in met_pairs(facts, cross_document_only=True).collect()}
    assert across == {(a[0], b[0]) for a in rows for b in rows if (a[0], b[0]) in want and a[1] != b[1]}


def shuffled_pairs(df):
    """Lines of the plan above the place where pairs are put together: an exchange there moves pairs, one below moves facts."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    (met,) = [i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("Union")][:1]
    return [line for line in lines[:met] if "Exchange" in line]


def test_pairs_are_not_shuffled(spark):
    """Verdicts, words, both sides and their sources are made where blocks meet, also when no table is small; words are stored nowhere."""
    from claimloom.plans import queries, stored
    from claimloom.sources import store, tables

    sf = "/root/testdata/sf0.001"
    before = len(store.BUILT)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_pairs(tables.order_verdicts_lazy(spark, sf)) == []
        for make in (queries.export_relationships, stored.explanations, stored.relationship_sources):
            assert shuffled_pairs(make(spark, sf)) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {name for name, _ in store.BUILT[before:]} <= {"order-facts"}
