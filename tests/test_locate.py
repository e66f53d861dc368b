"""Quotes on pages against a scan of each page, character by character; rectangles; stored tables whose sources change."""

import difflib
import random

from pyspark.sql import functions as F

FOLDS = {"­": "", "ﬁ": "fi", "ﬂ": "fl", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " "}


def plain(page):
    """The folded page and where each of its characters stands."""
    text, at = [], []
    for i, c in enumerate(page):
        for x in FOLDS.get(c, c).lower():
            x = " " if x.isspace() else x
            if x == " " and text and text[-1] == " ":
                continue
            text.append(x)
            at.append(i)
    return "".join(text), at


def scanned(page, quote):
    if page is None or quote is None or len(quote.strip()) < 12:
        return "failed", None, None, 0.0
    if quote in page:
        i = page.index(quote)
        return "exact", i, i + len(quote), 1.0
    text, at = plain(page)
    q = plain(quote)[0].strip()
    span = lambda i: (at[i], at[min(i + len(q), len(at)) - 1] + 1)
    if q and q in text:
        return "normalized", *span(text.index(q)), 0.97
    if len(q) < 12 or not text:
        return "failed", None, None, 0.0
    begins = range(0, max(1, len(text) - len(q)), max(1, len(q) // 8))
    best, i = max((difflib.SequenceMatcher(None, text[i : i + len(q)], q, autojunk=False).ratio(), -i) for i in begins)
    return ("fuzzy", *span(-i), 0.75 * best) if best >= 0.9 else ("failed", None, None, 0.0)


def quoted(seed=3, n=180):
    rng = random.Random(seed)
    words = ["profit", "of", "the ﬁrst", "ﬂow", "year", "Rev­enue", "grew", "by", "12.5%", "to", "₹", "“net”", "don’t", "—", "and", "total", "İzmir", "ΣΑΣ", "über", "x"]
    rows = []
    for k in range(n):
        page = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "  ", "­ ", " ­ ", "\x1c"]) for _ in range(rng.choice([5, 40, 300])))
        s = rng.randrange(max(1, len(page) - 60))
        q = page[s : s + rng.choice([15, 40, 90])]
        if k % 6 == 1:
            q = q.upper()
        elif k % 6 == 2:
            q = q.replace("“", '"').replace("ﬁ", "fi").replace("’", "'").replace("­", "")
        elif k % 6 in (3, 4, 5):
            rate = {3: 0.03, 4: 0.04, 5: 0.1}[k % 6]
            q = "".join(c if rng.random() > rate else "" if k % 6 == 4 else rng.choice("abxyz") for c in q)
        rows.append((k, page, q))
    blanks = " " * 1_000_000
    rows += [(900, None, "a quote that is long"), (901, "a page", None), (902, "", "a quote that is long"), (903, "short page", "a quote that is long"), (907, "abcdefghijklmn", "abcdefghijklmnop"), (908, "ab " * 9, "ab ab ab ab ab ax ab"), (909, "abcdefghijkl" * 300, "abcdefghijklabcdefghijkxabcdefghijkl")]
    rows += [(904, f"begin {blanks}then the end of it", "begin then the end of it"), (905, f"begin {blanks}then the end of it", "begin than the end of it"), (906, "begin" + "\n­" * 500_000 + "then the end", "nothing of this is there at all")]
    return rows


def same(found, page, quote):
    want = scanned(page, quote)
    assert (found.match_type, found.char_start, found.char_end) == want[:3] and abs(found.confidence - want[3]) < 1e-9, (found, want, quote)
    assert found.located_text is None if want[1] is None else found.located_text == page[want[1] : want[2]]


def test_all_rungs_against_a_scan(spark):
    from claimloom.operators.locate import locate, locate_on

    rows = quoted()
    df = spark.createDataFrame(rows, "i int, page_text string, quote string")
    one = {r.i: r.ground for r in locate(df.withColumn("gram", F.lit("clash"))).collect()}
    for i, page, quote in rows:
        same(one[i], page, quote)
    kinds = [g.match_type for g in one.values()]
    assert min(kinds.count(k) for k in ("exact", "normalized", "fuzzy", "failed")) >= 15
    claims = df.select("i", "quote").union(df.select("i", "quote").limit(20)).withColumn("n", F.lit(1))
    by_page = locate_on(claims, df.select("i", "page_text"), ["i"]).collect()
    assert len(by_page) == len(rows) + 20 and all(one[r.i] == r.ground for r in by_page)


def test_many_quotes_of_one_page_and_claims_without_one(spark):
    from claimloom.operators import locate

    page = " ".join(f"the {i}th sum was {i * 37} crore," for i in range(900))
    quotes = [f"THE {i}TH  SUM WAS {i * 37} CRORE" for i in range(900)]
    claims = spark.createDataFrame([("d", 1, q) for q in quotes] + [("d", 2, quotes[0]), (None, 1, quotes[0]), ("d", None, None)], "doc_id string, page_no int, quote string")
    got = locate.locate_on(claims, spark.createDataFrame([("d", 1, page), ("e", 2, page)], "doc_id string, page_no int, page_text string"), ["doc_id", "page_no"]).collect()
    assert sum(r.ground.match_type == "normalized" for r in got) == 900 and sum(r.ground.match_type == "failed" for r in got) == 3
    empty = locate.locate_on(claims.limit(0), spark.createDataFrame([], "doc_id string, page_no int, page_text string"), ["doc_id", "page_no"])
    assert empty.count() == 0


def test_bound_of_shared_runs_holds():
    """No stretch that is alike shares fewer runs, within their places, than `needed` asks for: by random edits."""
    rng = random.Random(8)
    tried = 0
    for _ in range(4000):
        q = "".join(rng.choice("abcd ") for _ in range(rng.randint(12, 70)))
        s = list(q)
        for _ in range(rng.randint(1, max(1, len(q) // 8))):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], [rng.choice("xyz")], [s[i], rng.choice("xyz")]])
        s = "".join(s)[: len(q)]
        if difflib.SequenceMatcher(None, s, q, autojunk=False).ratio() < 0.9:
            continue
        tried += 1
        n, m = len(q), len(s)
        both = -(-(n + m) * 45 // 100)
        enough, off = both - 2 * (n + m - 2 * both + 1), max(n, m) - both
        shared = sum(q[i : i + 3] == s[p : p + 3] and abs(i - p) <= off for i in range(n - 2) for p in range(m - 2))
        assert shared >= enough, (q, s)
    assert tried > 500


def test_misspelt_quotes_of_whole_texts(spark, tmp_path):
    from claimloom.plans import queries

    rng = random.Random(4)
    texts = [(i, " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 7))) for _ in range(rng.choice([1, 9, 200])))) for i in range(0, 600, 10)] + [(601, None), (602, ""), (None, "a text without an id that is long enough")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["ground_misspelt"](spark, str(tmp_path)).collect()
    assert len(got) == len([t for _, t in texts if t is not None])
    by = dict(texts)
    for r in got:
        if r.doc_id is not None and r.doc_id % 50 == 0:
            want = scanned(by[r.doc_id], r.quote)
            assert (r.match_type, r.char_start, r.char_end) == want[:3] and abs(r.confidence - want[3]) < 1e-5


def test_span_boxes(spark):
    from claimloom.operators.pages import boxes, span_boxes
    from claimloom.sources import landing

    rng = random.Random(6)
    texts = [(i, "\n".join(" ".join("w" * rng.choice([1, 3, 9, 700]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9)))) for i in range(12)]
    words = landing.page_words(spark.createDataFrame(texts, "doc_id long, text string")).withColumns({"y0": F.col("y0") * 4, "y1": F.col("y1") * 4 - 1})
    spans = [(f"{i}-{k}", i, 1, k * 90, k * 90 + size) for i in range(12) for k, size in enumerate((0, 1, 90, 400, 5000, -5))]
    df = spark.createDataFrame(spans, "span_id string, doc_id long, page_no int, start long, end long")
    got: dict = {}
    for r in span_boxes(df, words).collect():
        got.setdefault(r.span_id, []).append((r.line, [r.x0, r.y0, r.x1, r.y1]))
    whole = landing.text_pages(words)
    want = df.join(whole, ["doc_id", "page_no"]).select("span_id", boxes(F.col("words"), F.col("start"), F.col("end")).alias("b")).collect()
    assert {k: [b for _, b in sorted(v)] for k, v in got.items()} == {r.span_id: r.b for r in want if r.b and not r.span_id.endswith(("-0", "-5"))}


def test_stored_tables_follow_their_source(spark, tmp_path):
    from claimloom.sources import store

    source, made = str(tmp_path), []

    def make():
        made.append(1)
        return spark.read.parquet(f"{source}/numbers.parquet")

    ask = lambda: store.stored(spark, "numbers", source, make, ("numbers",)).count()
    spark.range(1).write.parquet(f"{source}/numbers.parquet")
    assert (ask(), ask(), len(made)) == (1, 1, 1)
    spark.range(5).write.mode("overwrite").parquet(f"{source}/numbers.parquet")
    assert (ask(), ask(), len(made)) == (5, 5, 2)
    store.clear(spark)
    assert (ask(), len(made)) == (5, 3)


def test_postings_of_pages_are_not_shuffled(spark):
    """What a page's runs meet stays in its row: rows with their pages need no exchange, and hits are taken in bounded numbers."""
    from claimloom.operators import locate

    rows = spark.createDataFrame([(1, "ab cd " * 2_000, "ab cd " * 20 + "x" + "ab cd " * 20)], "i int, page_text string, quote string")
    found = locate.locate(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    ground = found.first().ground
    assert (ground.match_type, ground.char_start) == ("fuzzy", 0) and ground.confidence > 0.7


def test_a_place_costs_no_walk_over_the_page(spark):
    """Quotes of a long page whose blanks are all doubled: places are led back by a search in a running sum, so 256 of them take seconds and not minutes."""
    import time

    from claimloom.operators import locate

    words = [f"w{i}" for i in range(120_000)]
    page, quotes = "  ".join(words), [" ".join(words[i : i + 9]) for i in range(100, 120_000, 470)]
    claims = spark.createDataFrame([("d", 1, q) for q in quotes], "doc_id string, page_no int, quote string")
    began = time.time()
    got = locate.locate_on(claims, spark.createDataFrame([("d", 1, page)], "doc_id string, page_no int, page_text string"), ["doc_id", "page_no"]).collect()
    assert time.time() - began < 20
    assert len(got) == len(quotes) and all((r.ground.match_type, r.ground.located_text) == ("normalized", r.quote.replace(" ", "  ")) and page[r.ground.char_start : r.ground.char_end] == r.ground.located_text for r in got)


def test_folded_texts_and_their_places():
    from claimloom.operators import locate

    rng = random.Random(9)
    for n in [0, 1, 2, *range(3, 300, 7)]:
        page = "".join(rng.choice("aBé ΣςİﬁﬂŒ\t\n\x1c\u00ad\u00ad\u2028–—’“₹😀𐐀𝒜中") for _ in range(n))
        text, ends = locate.folded(page)
        want, at = plain(page.replace("ς", "σ"))
        assert text == want
        assert [int(i) for i in __import__("numpy").searchsorted(ends, range(len(text)), "right")] == at


def test_spans_and_words_meet_in_the_row_of_their_page(spark, tmp_path):
    """Documents are spread over the cores, if at all, and nothing else of the query is shuffled; rows without an id give nothing, as in its SQL."""
    from claimloom.plans import stored

    texts = [(1, "one two\n\nthree  four " + "x" * 300), (2, ""), (3, None), (4, " \n "), (None, "no id"), (5, "a page\fand another")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, most in (("span_boxes", 1), ("page_words", 1)):
        assert stored.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange") <= most
    got = sorted(tuple(r) for r in stored.QUERIES["span_boxes"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 0.0, 0.0, 7.0), (1, 0, 8.0, 0.0, 312.0), (1, 1, 8.0, 12.0, 312.0)]


def test_boxes_of_words_in_any_order():
    """Against each span's own words, one by one: also where offsets go up and down, words overlap, and few hits are held at once."""
    import numpy as np

    from claimloom.operators import pages

    rng, held = random.Random(12), pages.HITS
    try:
        for k in range(300):
            pages.HITS = rng.choice([1, 7, 1 << 20])
            words = [(s, s + rng.randint(0, 9), *(rng.randrange(40) for _ in range(4))) for s in (rng.randrange(80) for _ in range(rng.randint(0, 25)))]
            if k % 2:
                words = [(10 * i, 10 * i + 9, *w[2:]) for i, w in enumerate(words)]
            spans = [(s, s + rng.randint(-3, 60)) for s in (rng.randrange(-5, 100) for _ in range(rng.randint(0, 9)))]
            want = []
            for n, (s, e) in enumerate(spans):
                lines = []
                for w in [w for w in words if s < e and w[0] < e and w[1] > s]:
                    if not lines or abs(lines[-1][-1][3] - w[3]) >= pages.LINE:
                        lines.append([])
                    lines[-1].append(w)
                want += [(n, i, min(w[2] for w in x), min(w[3] for w in x), max(w[4] for w in x), max(w[5] for w in x)) for i, x in enumerate(lines)]
            found = pages.lines_of(*np.array(spans, float).reshape(-1, 2).T, *np.array(words, float).reshape(-1, 6).T)
            assert list(zip(*(x.tolist() for x in found), strict=True)) == want
    finally:
        pages.HITS = held
