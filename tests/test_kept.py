"""What is kept between batches: only touched buckets change, searches equal scans, pages read their files, states merge, interning in any split."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F


def contents(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def bucket_of(f):
    return f.split("bucket=")[1].split("/")[0]


def test_history(spark, tmp_path):
    from claimloom.sources.history import History

    path = str(tmp_path / "h")
    held = History(spark, f"file://{path}", "fact_id string, entity_key string, doc_id string, n int", buckets=16)
    assert held.read().count() == 0 and held.around(held.read()).count() == 0 and held.merge(held.read(), ["entity_key", "fact_id"]) == [] and held.delete(held.read()) == []
    rows = {(f"e{i % 40}" if i % 41 else None, f"f{i}"): (f"d{i % 7}", 0) for i in range(800)}
    frame = lambda x: spark.createDataFrame([(f, e, d, n) for (e, f), (d, n) in x.items()], "fact_id string, entity_key string, doc_id string, n int")
    held.merge(frame(rows), ["entity_key", "fact_id"])
    before = contents(path)
    batch = {("e3", "f3"): ("d3", 5), ("e3", "new"): ("d1", 1), ("e9", "f9"): ("d9", 2)}
    touched = held.merge(frame(batch), ["entity_key", "fact_id"])
    after = contents(path)
    assert len(touched) <= 2
    assert {f for f in before if bucket_of(f) not in map(str, touched)} <= set(after) and all(after[f] == before[f] for f in after if bucket_of(f) not in map(str, touched))
    assert not {f for f in before if bucket_of(f) in map(str, touched)} & set(after)
    rows |= batch
    held.merge(frame(batch), ["entity_key", "fact_id"])  # once more
    got = lambda: {(r.entity_key, r.fact_id): (r.doc_id, r.n) for r in held.read().collect()}
    # a null entity is no equal of another in the join that replaces rows, so such rows are only compared by number
    assert {k: v for k, v in got().items() if k[0]} == {k: v for k, v in rows.items() if k[0]}
    assert {r.fact_id for r in held.around(frame(batch)).collect()} == {f for (e, f) in rows if e in ("e3", "e9")}
    plan = held.around(frame(batch))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    latest = held.merge(frame({("e1", "f1"): ("d1", 7)}).unionByName(frame({("e1", "f1"): ("d1", 9)})), ["entity_key", "fact_id"], latest="n")
    assert len(latest) == 1 and got()["e1", "f1"] == ("d1", 9)
    one = History(spark, f"file://{path}2", "fact_id string, entity_key string, doc_id string, n int", buckets=16)
    one.merge(frame({("a", "1"): ("x", 0), ("b", "2"): ("y", 0), ("c", "3"): ("x", 0)}), ["entity_key", "fact_id"])
    one.delete(spark.createDataFrame([("x",), ("nothing",)], "doc_id string"))
    assert [r.fact_id for r in one.read().collect()] == ["2"]


def test_batches_over_a_history_equal_the_full_build(spark, tmp_path):
    from claimloom.operators.blocking import candidate_pairs
    from claimloom.operators.build import ALIAS, judge_pairs, relationships
    from claimloom.operators.normalize import normalize, to_facts
    from claimloom.sources import gold
    from claimloom.sources.history import History
    from claimloom.streaming.incremental import on_history

    facts = to_facts(normalize(gold.claims(spark)).withColumns({"extraction_conf": F.lit(1.0), "grounding_conf": F.lit(1.0)}), "fact_id").withColumn("filename", F.col("doc_id"))
    facts.write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    none = spark.createDataFrame([], ALIAS)
    want = {(r.fact_a, r.fact_b, r.label) for r in relationships(judge_pairs(candidate_pairs(facts), facts, none)).collect()}
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in facts.schema.fields) + ", batch long"
    held = History(spark, f"file://{tmp_path}/history", ddl, buckets=4)
    run = on_history(held, lambda rels, i: rels.select("fact_a", "fact_b", "label").write.mode("overwrite").parquet(f"{tmp_path}/rels/batch={i}"), none)
    parts = facts.withColumn("part", F.pmod(F.xxhash64("fact_id"), F.lit(2)))
    for i in (0, 1, 1):  # the second batch comes again after both its writes
        run(parts.where(F.col("part") == i).drop("part"), i)
    assert {(r.fact_a, r.fact_b, r.label) for r in spark.read.parquet(f"{tmp_path}/rels").collect()} == want
    assert {r.fact_id: r.batch for r in held.read().collect()} == {r.fact_id: r.part for r in parts.collect()}


def test_search_equals_a_scan(spark, tmp_path):
    from claimloom.plans import search
    from claimloom.plans.ledger import like

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcABC é%_#1") for _ in range(rng.randint(0, 9)))
    rows = [(str(i), word(), word() + " " + word() if i % 9 else None) for i in range(700)] + [("x", None, None), ("y", "", ""), ("z", "a" * 5000, "İSTANBUL ΣΑΣ straße")]
    facts = spark.createDataFrame(rows, "fact_id string, one string, two string")
    search.write_postings(facts, ["one", "two"], f"{tmp_path}/p")
    postings = spark.read.parquet(f"{tmp_path}/p")
    patterns = ["abc", "ABC", "ab", "", "%", "a%b", "abc%abc", "b_ca", "é", "bcé", "1#a", "a\\%b", "bca\\_", "istan", "İST", "σας", "aaaa", "STRAß", "bc abc"]
    for p in patterns:
        want = {r.fact_id for r in facts.where(like("one", p) | like("two", p)).collect()}
        assert {r.fact_id for r in search.search(facts, postings, ["one", "two"], p).collect()} == want, p
    assert search.asked_grams("Ab%cdE_fghi") == ["cde", "fgh", "ghi"] and search.asked_grams("ab\\%cde") == ["cde"] and search.asked_grams("éab") == []
    plan = search.search(facts, postings, ["one", "two"], "abca")._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan or "EqualTo(gram" in plan


def test_pages_read_their_files(spark, tmp_path):
    from claimloom.plans import search

    rng = random.Random(7)
    rows = [(f"f{i:05}", rng.choice("abc"), rng.choice(["m", None]), None if i % 5 == 0 else i % 11) for i in range(3000)]
    rng.shuffle(rows)
    facts = spark.createDataFrame(rows, "fact_id string, entity_key string, metric_key string, period_start int")
    search.write_sorted(facts, f"{tmp_path}/s", 12)
    none_first = lambda x: (x is not None, x)
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], none_first(r[2] or None) if r[2] else (False, ""), none_first(r[3]) if r[3] is not None else (False, 0), r[0]))]
    for n in (0, 1, 17, 29, 30, 500):
        got = search.page(spark, f"{tmp_path}/s", n, 100)
        assert [r.fact_id for r in got.collect()] == order[n * 100 : n * 100 + 100]
        assert n >= 30 or len(got.inputFiles()) <= 2


def test_states_merge(spark):
    from claimloom.plans import merging

    df = spark.range(30_000).select("id", (F.col("id") % 9000).alias("key"), F.when(F.col("id") % 3 == 0, "x").alias("kind"))
    counters, distinct = {"all": F.lit(True), "x": F.col("kind") == "x"}, {"keys": F.col("key").cast("string")}
    states = [merging.state(df.where(F.col("id") % 6 == i), counters, distinct) for i in range(6)] + [merging.state(df.limit(0), counters, distinct)]
    whole = {r.name: r.value for r in merging.shown(merging.state(df, counters, distinct)).collect()}
    tree = merging.merge([merging.merge(states[:2]), merging.merge([merging.merge(states[2:5]), states[5]]), states[6]])
    assert {r.name: r.value for r in merging.shown(tree).collect()} == whole
    assert whole["all"] == 30_000 and whole["x"] == 10_000 and abs(whole["keys"] - 9000) < 0.03 * 9000
    gone = merging.state(df.where("id < 100"), {"all": F.lit(True)}, {}, sign=-1)
    assert {r.name: r.n for r in merging.merge([tree, gone]).collect()}["all"] == 29_900


def test_interning_in_any_split(spark, tmp_path):
    from claimloom.streaming import intern

    rng = random.Random(1)
    facts = {f"f{i:03}": (rng.choice(["revenue", "profit", "rare"] if i % 50 == 0 else ["revenue", "profit"]), f"Label {i}") for i in range(200)}
    gone = set(rng.sample(sorted(facts), 90)) | {"f000", "f001", "unknown"} | {f for f, (m, _) in facts.items() if m == "rare"}
    changes = [(m, f, label, False) for f, (m, label) in facts.items()]
    changes += rng.sample(changes, 40)
    rng.shuffle(changes)
    changes += [(facts.get(f, ("revenue", ""))[0], f, "", True) for f in gone]
    cuts = sorted(rng.sample(range(1, len(changes)), 2))
    for lo, hi in zip([0, *cuts], [*cuts, len(changes)], strict=True):
        spark.createDataFrame(changes[lo:hi], "metric_key string, fact_id string, label string, gone boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        stream = spark.readStream.schema("metric_key string, fact_id string, label string, gone boolean").parquet(f"{tmp_path}/changes")
        out = intern.run(spark, stream, f"file://{tmp_path}")
    want = {}
    for f in sorted(set(facts) - gone):
        m, label = facts[f]
        want[m] = (want[m][0], want[m][1] + 1) if m in want else (label, 1)
    assert {r.metric_key: (r.label, r.n_facts) for r in out.collect()} == want


def test_extractor_as_a_table_function(spark):
    from claimloom.sources import said

    def answer(page):
        if "bad" in page:
            raise ValueError(page)
        return page.upper()

    said.register(spark, answer)
    rows = [("a", 1, "one", 5), ("a", 2, "one", 6), ("a", 3, None, 7), ("b", 1, "bad 1", 1), ("b", 2, "fine", 1), ("b", 3, "bad 2", 1), ("b", 4, "bad 3", 1), ("b", 5, "bad 4", 1), ("b", 6, "late", 1)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, page_text string, other int")
    got = spark.sql("SELECT * FROM extract_pages(TABLE({p}) PARTITION BY doc_id ORDER BY page_no)", p=pages)
    assert got.columns == ["doc_id", "page_no", "page_text", "other", "response", "attempts"]
    found = {(r.doc_id, r.page_no): (r.response, r.attempts, r.other) for r in got.collect()}
    assert found["a", 1] == ("ONE", 1, 5) and found["a", 2] == ("ONE", 0, 6) and found["a", 3] == (None, 0, 7)
    assert [found["b", i][:2] for i in range(1, 7)] == [(None, 1), ("FINE", 1), (None, 1), (None, 1), (None, 1), (None, 0)]
    assert spark.sql("SELECT * FROM extract_pages(TABLE({p}) PARTITION BY doc_id)", p=pages.limit(0)).count() == 0
    with pytest.raises(Exception, match="page_text is needed"):
        spark.sql("SELECT * FROM extract_pages(TABLE(SELECT 1 AS x))").collect()


def test_queries_without_words_build_none(spark):
    """Labels, confidences and sources come from the table of verdicts; traces and explanations are not made for them."""
    import __spark_entry__ as entry
    from claimloom.sources import store

    store.clear(spark)
    before = len(store.BUILT)
    for name in ("relationships_by_label", "relationship_deltas", "best_per_label", "best_of_fact", "facts_of_label", "relationship_ledger", "relationship_sources", "fact_lookup", "highlight"):
        entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert [name for name, _ in store.BUILT[before:]] == ["order-facts", "order-verdicts"]


def test_best_of_each_label_is_an_aggregate(spark):
    from claimloom.plans import stats

    rows = [("A", True, 0.5, "r2"), ("A", True, 0.5, "r1"), ("A", False, 0.9, "r0"), ("B", False, 0.1, "r4"), ("B", None, 0.9, "r3"), (None, True, None, "r5")]
    full = spark.createDataFrame(rows, "label string, cross_document boolean, confidence double, rel_id string")
    best = stats.best_per_label(full)
    assert sorted((r.label or "", r.rel_id) for r in best.collect()) == [("", "r5"), ("A", "r1"), ("B", "r4")]
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_counted_without_facts(spark):
    import __spark_entry__ as entry
    from claimloom.sources import store

    store.clear(spark)
    before = len(store.BUILT)
    for name in ("blocking_stats", "order_claim_pairs", "order_pairs_across_documents"):
        entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert [name for name, _ in store.BUILT[before:]] == ["order-keys"]


def test_claims_of_one_row_group_are_read_by_many_tasks(spark, tmp_path):
    """A file of many splits and one row group: all its rows are in one of the splits."""
    from claimloom.sources import tables

    spark.read.parquet("/root/testdata/sf0.01/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.01/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "16384")
        rows = tables.order_claims(spark, str(tmp_path)).rdd.glom().map(len).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(rows) == 15000 and max(rows) < 15000 / 2


def test_postings_are_of_distinct_texts(spark, tmp_path):
    """Many facts of few texts have few postings, and a text that many share is found in either column, once."""
    from claimloom.plans import search

    facts = spark.range(3000).selectExpr("cast(id as string) AS fact_id", "concat('name of ', id % 3) AS one", "CASE WHEN id % 2 = 0 THEN 'the name of all' END AS two")
    search.write_postings(facts, ["one", "two"], f"{tmp_path}/p")
    postings = spark.read.parquet(f"{tmp_path}/p")
    assert postings.count() == 3 * len({"name of x"[i : i + 3] for i in range(7)}) + len({"the name of all"[i : i + 3] for i in range(13)})
    for pattern, n in (("name OF", 3000), ("the name", 1500), ("of 1", 1000), ("name%2", 1000), ("nobody", 0)):
        found = [r.fact_id for r in search.search(facts, postings, ["one", "two"], pattern).collect()]
        assert len(found) == len(set(found)) == n, pattern
    old, search.FEW = search.FEW, 0
    try:
        assert search.search(facts, postings, ["one", "two"], "name of").count() == 3000
    finally:
        search.FEW = old
