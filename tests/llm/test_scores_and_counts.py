"""Toxicity, the filter audit and collocations against brute force, on edge cases and on random rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from claimloom.llm import audit, collocations, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, key long, ratio string, mask string, part string, word string, n int"
LABELS = "doc_id long, quality int, toxic int, text string, source string, n int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, 1, 2, "x", "y", "z", "w", 3) for i, t, lang, source in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, t, "text", "other", 7) for i, q, t in rows], LABELS)


def invented(seed=5, n=260):
    """Rows (id, text, lang, source) and labels: ordinary prose, and prose with rude words, some of them copies."""
    rng = random.Random(seed)
    syllables = ["an", "er", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 1, 2, 2, 3])))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.choice([3, 40, 120]))]
        toxic = i % 4 == 0
        if toxic:
            w = [rng.choice(["moron", "Scum,", "clown"]) if rng.random() < 0.12 else x for x in w] + ["scum!"]
        rows.append((i, " ".join(w) + ("\n" if i % 3 else ". "), ["en", None, "fr"][i % 3], f"src{i % 3}"))
        if i % 5 != 3:
            labels.append((i, int(not toxic), int(toxic)))
    rows += [(1000 + j, rows[8][1], "en", "src0") for j in range(30)] + [(2000, None, None, None), (2001, "", "en", "src1"), (2002, " \t\n", "en", "src1"), (2003, "mixed ÜBER 中文 \x00\x01 text", "de", "src1"), (None, "scum moron", "en", "src1"), (7, rows[7][1], "en", "src0"), (2004, "word " * 30_000, "en", "src2")]
    labels += [(1003, 0, 1), (1004, 0, 1), (2000, None, None), (2001, 1, 0), (2003, 1, 0), (2004, 1, None), (None, 1, 1), (12, 1, 0), (12, None, 1)]
    return rows, labels


def folded(t):
    b = re.sub(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", b" ", (t or "").encode()).lower()
    return b"\0" * 4 + b + b"\x01"


def grams(t, n):
    b = folded(t)
    return [b[i - n + 1 : i + 1] for i in range(4, len(b))]


def kneser_ney(texts, order=5):
    """prob(order)(gram, lower probability) of one class, straight from the definition."""
    count = {order: Counter(g for t in texts for g in set(grams(t, order)))}
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    by, gone, d = {}, {}, {}
    for n, c in count.items():
        f = Counter(c.values())
        y = f[1] / (f[1] + 2 * f[2]) if f[1] + f[2] else 0.5
        d[n] = [0.0] + [min(max(j - (j + 1) * y * f[j + 1] / f[j] if f[j] else j / 2, 0.05), j - 0.05) for j in (1, 2, 3)]
        by[n], gone[n] = Counter(), defaultdict(float)
        for g, k in c.items():
            by[n][g[:-1]] += k
            gone[n][g[:-1]] += d[n][min(k, 3)]

    def p(g, low):
        for n in range(1, order + 1):
            x, context = g[-n:], g[-n:-1]
            total = by[n][context]
            if total:
                k = count[n][x]
                low = (k - d[n][min(k, 3)]) / total + gone[n][context] / total * low
        return low

    return p, count


def expected_ratios(rows, labels):
    known = {}
    for i, _, t in labels:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(known.get(i, 0), t)
    texts = {(t or "", known[i]) for i, t, *_ in rows if i in known}
    return known, texts


def test_toxicity_against_the_definition(spark):
    rows, labels = invented()
    docs, lab = docs_of(spark, rows), labels_of(spark, labels)
    made, rest, known = toxicity.model(docs, lab)
    assert rest is None
    seen = {(r.doc_id, r.toxic): r.tune for r in known.collect()}
    by_id = {i: t for i, t, *_ in rows}
    by_label, texts = expected_ratios(rows, labels)
    assert {(by_id[i] or "", t) for i, t in seen} == texts
    fit = [[by_id[i] or "" for (i, t), tune in seen.items() if not tune and t == c] for c in (0, 1)]
    (po, co), (pt, ct) = (kneser_ney(x) for x in fit)
    shared = Counter(g[1:] for g in set(co[2]) | set(ct[2]))
    total, kinds = sum(shared.values()), len(shared)
    base = lambda b: ((shared[b] - 0.5 if b in shared else 0) + 0.5 * kinds / 256) / total

    def ratio(t):
        gs = grams(t, 5)
        return sum(math.log(pt(g, base(g[-1:]))) - math.log(po(g, base(g[-1:]))) for g in gs) / len(gs)

    got = toxicity.ratios(docs, made, None).select("doc_id", "ratio").collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(ratio(t))
    for r in got:
        assert any(abs(r.ratio - x) < 1e-9 for x in want[r.doc_id]), (r, want[r.doc_id])
    # the same with a head of 200 n-grams: all others are asked for at the table
    small, rest, _ = toxicity.model(docs, lab, head=200)
    assert rest is not None and len(small.keys) <= 200
    again = {(r.doc_id, round(r.ratio, 9)) for r in toxicity.ratios(docs, small, rest).collect()}
    assert again == {(r.doc_id, round(r.ratio, 9)) for r in got}


def test_toxicity_scores(spark):
    rows, labels = invented(9, 900)
    got = toxicity.score(docs_of(spark, rows), labels_of(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    right = [r.predicted == (r.doc_id % 4 == 0) for r in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.95


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = invented(3, 40)
    nothing = labels_of(spark, [])
    assert {r.score for r in toxicity.score(docs_of(spark, rows), nothing).collect()} == {0.5}
    only = labels_of(spark, [(i, 1, 0) for i in range(40)])
    assert {(r.score, r.predicted) for r in toxicity.score(docs_of(spark, rows), only).collect()} == {(0.0, 0)}
    assert toxicity.score(docs_of(spark, []), labels_of(spark, labels)).count() == 0


def brute_audit(rows, labels):
    def fails(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}

    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    mark = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            mark[i] = [max(mark[i][0], q or 0), max(mark[i][1], t or 0)]
    out, removed_by = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for i, t, _, source in rows:
            t, part = t or "", source or ""
            f = fails(t) | {"E": i is not None and i > first[t]}
            gone = False
            for step, x in enumerate(order, 1):
                o = out.setdefault((part, order, step), [0] * 6)
                o[0] += not gone and not f[x]
                if f[x]:
                    o[3] += sum(f.values()) == 1
                    if gone:
                        o[2] += 1
                    else:
                        o[1] += 1
                        o[4] += mark[i][0] == 1 if i in mark else 0
                        o[5] += mark[i][1] == 1 if i in mark else 0
                        removed_by[part, x] += 1
                    gone = True
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rows, labels = invented(4, 60)
    rng = random.Random(1)
    rows += [(3000 + j, " ".join(f"w{rng.randint(0, 90)}" for _ in range(250)), "en", "src1") for j in range(8)]
    rows += [(3100 + j, " ".join(f"w{k}" for k in range(250)), "en", "src1" if j else None) for j in range(4)] + [(3100, " ".join(f"w{k}" for k in range(250)), "en", "src1"), (None, " ".join(f"w{k}" for k in range(250)), "en", "src1"), (3200, "A#", "en", "src2"), (3200, "A#", "en", "src2")]
    labels += [(3101, 1, 0), (3102, 1, 1), (3102, 0, None), (3001, 1, 0)]
    got = audit.audit(audit.cells(audit.masks(docs_of(spark, rows).drop("part")), labels_of(spark, labels)), "ABCDE")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, labels)
    clashing = audit.masks(docs_of(spark, rows), part="part")
    assert {r.part for r in clashing.collect()} == {"z"}
    assert audit.audit(audit.cells(audit.masks(docs_of(spark, [])), labels_of(spark, labels)), "ABCDE").count() == 0


def brute_collocations(rows, least, inside=50, first=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        longer, found = Counter(), []
        for p, a in c.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        for p, a in c.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= inside * a):
                s, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    rng = random.Random(1)
    words = ["the", "of", "The", "a", "über", "中文", "-x-", "\x01", "rare", "New", "york", "new"] + [f"w{i}" for i in range(30)]
    weights = [30, 20, 10, 20, 5, 5, 5, 2, 1, 9, 9, 9] + [1] * 30
    rows = []
    for i in range(150):
        w = rng.choices(words, weights, k=rng.choice([0, 1, 2, 30, 90]))
        rows.append((i, "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " ! "]) for x in w), ["en", None, "und", "EN"][i % 4], "s"))
    rows += [(500, None, "en", "s"), (501, "", None, "s"), (502, "the the the the the the", "en", "s"), (503, "york york a york york", "en", "s"), (503, "york york a york york", "en", "s"), (None, "new york " * 4000, "en", "s")]
    monkeypatch.setattr(collocations, "block_keys", lambda shards: 700)  # blocks that cut texts
    monkeypatch.setattr(collocations, "shards_for", lambda docs: 5)
    for least, first in ((3, 2000), (10, 7)):
        got = collocations.collocations(docs_of(spark, rows), least=least, first=first)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, first=first)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None, None), (2, "one two", "en", "s")])).count() == 0


def test_scores_beyond_64_bits(spark):
    """Exact where products pass 64 bits: the expression of the scores on large counts."""
    rows = [(10**12 + 7, 3 * 10**12 + 1, 10**13 + 9), (999_999_999_989, 999_999_999_989, 999_999_999_989)]
    df = spark.createDataFrame(rows, "a long, f1 long, f2 long").select("a", "f1", "f2", collocations.score("f1", "f2").alias("s"))
    assert [r.s for r in df.collect()] == [10**6 * a * a // (x * y) for a, x, y in rows]
    assert df.agg(F.count("s")).first()[0] == 2
