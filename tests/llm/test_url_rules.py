"""Addresses, links and tables of rules of the URL filter."""

import random

from pyspark.sql import functions as F

from claimloom.llm import urls


def page(to, how="canonical"):
    return f"<link rel='canonical' href='{to}'>" if how == "canonical" else f"<meta http-equiv=refresh content='0; url={to}'>"


def test_relative_targets_and_comments(spark):
    base = "http://d.org/a/b/c.html?q=1#top"
    targets = {
        "../c": "d.org/a/c", "./x": "d.org/a/b/x", "..": "d.org/a/", ".": "d.org/a/b/", "../../../up": "d.org/up", "/r/./s/../t": "d.org/r/t", "?z=2": "d.org/a/b/c.html?z=2", "#part": None, "//E.org/p/../q": "e.org/q",
        "https://f.org/a/../b?x=../y": "f.org/b?x=../y", "plain": "d.org/a/b/plain", "d/./e/.": "d.org/a/b/d/e/", "a//b/../c": "d.org/a/b/a//c", "x://nothing/../to": "nothing/to", "mail:some": "d.org/a/b/mail:some", "/..": "d.org/", "/": "d.org/",
    }
    rows = [(i, base, page(t)) for i, t in enumerate(targets)]
    rows += [(100, "http://a.net/1", f"<!-- {page('http://f.net/es/1')} -->"), (101, "http://a.net/2", f"<!-- {page('http://f.net/es/2')}"), (102, "http://a.net/3", f"<!-- x -->{page('http://f.net/es/3')}<!-- y -->"), (103, "http://a.net/4", page("http://f.net/es/4") + "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in urls.links(df).collect()}

    want = {("d.org/a/b/c.html?q=1", to) for to in targets.values() if to} | {("a.net/3", "f.net/es/3"), ("a.net/4", "f.net/es/4")}
    assert got == want
    verdicts = {r.page_id: r.verdict for r in urls.judge(df, urls.RULES).collect()}
    assert [verdicts[i] for i in range(100, 104)] == ["allow", "allow", "block", "block"]


def test_cycles_of_redirects(spark):
    rows = [(i, f"http://c.org/{i}", page(f"/{(i + 1) % 6}", "refresh")) for i in range(6)] + [(10, "http://o.org/1", page("http://o.org/1"))]
    edges = spark.createDataFrame([("c.org/3", "x.net/fr/9"), ("lone.org/", "lone.org/")], "src string, dst string")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.RULES, edges).collect()}
    assert got == dict.fromkeys(range(6), "block") | {10: "allow"}


def test_rules_as_a_table_equal_rules_as_a_list(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "www.x.net", ""]
    path = lambda: "/" + "/".join(rng.choice(["en", "es", "e", "", "deep"]) for _ in range(rng.randint(0, 3)))
    rules = sorted({(rng.choice(["allow", "block"]), rng.choice(hosts[:-1]) + path()) for _ in range(60)} | {("block", "com"), ("allow", "com/"), ("allow", "net/es"), ("block", "net/es")})
    rules = [r for r in rules if "/" in r[1]]
    pages = [(i, None if i % 40 == 7 else f"http://{rng.choice(['', 'q.', 'W.q.'])}{rng.choice(hosts)}{path()}?k", None) for i in range(400)] + [(900, "no url", ""), (901, None, None), (901, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"rule": F.lit("clash"), "_h": F.lit(1)})
    some = [r for r in rules if ({"allow": "block", "block": "allow"}[r[0]], r[1]) not in rules or r[0] == "allow"]
    by_list, by_table = (sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge(df, x).collect()) for x in (some, urls.rule_table(spark, rules)))
    assert by_list == by_table and len({r[3] for r in by_table}) > 10
    none = urls.judge(df, urls.rule_table(spark, rules).limit(0))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
