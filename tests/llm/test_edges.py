"""Every operator on nulls, empty and long texts, repeated rows, clashing extra columns and empty tables, against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import bpe, chat, decontaminate, idfiles, jaccard, kdtree, perplexity, urls, webp, wrappers

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
TEXTS = [
    (1, None), (2, ""), (3, "One two"), (4, LONG), (5, LONG + " tail"), (6, "one TWO"), (7, f"before {PASSAGE} after"), (8, PASSAGE), (8, PASSAGE), (9, " \t\n "), (10, "Ünïcode — “quoted” 中文 text, with 3 numbers: 1 22 333!"),
    (None, "a text without an id of its own"), (11, PASSAGE + " rho sigma"), (12, "two"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, items string, cover int, n_words int, component_id int, size int, node int, cell int"


def rows(texts=TEXTS):
    return [(i, t, None if i == 3 else "en", "src", None if t is None else len(t), "r", "i", 1, 2, 3, 4, 5, 6) for i, t in texts]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_jaccard(docs, nothing):
    def shingles(t):
        w = words(t, r"[^\x20\x09-\x0D]+")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    group = {i: i for i, _ in TEXTS} | {5: 4, 6: 3, 8: 7, 11: 7}
    assert got == {(i, len(shingles(t)), group[i]) for i, t in TEXTS}
    assert jaccard.near_duplicates(nothing).count() == 0


def test_jaccard_of_chains_and_random_groups(spark):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"g{g}x{rng.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(9):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(60)] = f"n{rng.randint(0, 10**9)}"
            texts.append((len(texts), " ".join(base) + " " + PASSAGE))
    rng.shuffle(texts)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts for w in [t.split()]}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and find(i) != find(j):
                group[max(find(i), find(j))] = min(find(i), find(j))
    got = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_kd_tree(docs, nothing, spark):
    got = kdtree.shard(docs, 3).collect()
    assert len(got) == len(TEXTS)
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert sorted(((r.doc_id or -1), r.size, r.text_crc32) for r in got) == sorted(((i or -1), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    many = spark.createDataFrame([(i, "x" * (i % 50), "en", "hot" if i % 3 else f"s{i}") for i in range(2000)], "doc_id long, text string, lang string, source string")
    sizes = {}
    for r in kdtree.shard(many, 7).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(sizes) == 7 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert kdtree.shard(nothing, 3).count() == 0
    fine = {r.shard for r in kdtree.shard(many, target_bytes=500).collect()}
    assert len(fine) == -(-sum(sizes.values()) // 500)


@pytest.mark.parametrize("origin", [lambda i: f"www.{i * 7919 % 1000:04}", lambda i: f"www.{i * 7919 % 1000 // 500}"])
def test_kd_tree_equals_brute_force(spark, monkeypatch, origin):
    """The tree, built again in Python: widest dimension, weighted quantile. Sources share more than five bytes; ids lie 2**62 apart."""
    monkeypatch.setattr(kdtree, "FINE", 0.0)
    rng = random.Random(9)
    docs = [(rng.choice([1, -1]) * rng.randrange(2**61) if i % 5 else i, "x" * rng.randrange(40), rng.choice(["en", "fr"]), origin(i)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = [tuple(r) for r in kdtree.metadata(df).select("doc_id", "size", *kdtree.DIMENSIONS).collect()]
    for k, column in ((4, 2), (5, 3)):  # ranks sort like the strings
        value = {d[0]: d[column] for d in docs}
        by = sorted(rows, key=lambda r: r[k])
        assert [value[r[0]] for r in by] == sorted(value[r[0]] for r in rows)
    whole = [max(1, (max(r[d] for r in rows) >> 22) - (min(r[d] for r in rows) >> 22)) for d in range(2, 6)]

    def split(rows, first, k):
        if k == 1 or not rows:
            return {r[0]: first for r in rows}
        width = [((max(r[d] for r in rows) >> 22) - (min(r[d] for r in rows) >> 22)) / whole[d - 2] for d in range(2, 6)]
        d = width.index(max(width)) + 2
        rows = sorted(rows, key=lambda r: r[d])
        target, below = sum(r[1] for r in rows) * (k // 2) / k, 0
        for i, r in enumerate(rows):  # noqa: B007
            if below + r[1] >= target:
                break
            below += r[1]
        i += below + r[1] - target <= target - below
        return split(rows[:i], first, k // 2) | split(rows[i:], first + k // 2, k - k // 2)

    assert {r.doc_id: r.shard for r in kdtree.shard(df, 7).collect()} == split(rows, 0, 7)


def test_perplexity(docs, nothing, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in (3, 4, 8)] + [(8, 0, 0), (7, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = perplexity.classify(docs, labels).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.perplexity is None) == (r.doc_id in (1, 2, 9)) and (r.perplexity is not None or not r.keep)
    assert perplexity.classify(nothing, labels).count() == 0
    untrained = perplexity.classify(docs, labels.where("false")).collect()
    assert {r.keep for r in untrained if r.n_words} == {True}


@pytest.mark.parametrize("head", [1 << 20, 0])
def test_perplexity_equals_brute_force(spark, monkeypatch, head):
    """More different words than 2**20 symbols keep apart (some hundreds would share one), with all keys and with none in the cache."""
    import math
    from collections import Counter, defaultdict

    monkeypatch.setattr(perplexity, "HEAD", head)
    rng = random.Random(6)
    texts = [(i, " ".join([f"w{rng.randrange(40_000)}" for _ in range(300)] + [f"c{int(rng.expovariate(0.1))}" for _ in range(60)])) for i in range(160)] + [(900, "unheard of"), (901, "c1"), (902, "c1 c2 never c3")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in perplexity.held_out(docs, labels).collect()}
    pairs = lambda t: list(zip([None, *t.split()], t.split()))  # noqa: E731, B905
    n = Counter(p for i, t in texts if i < 120 and i not in held for p in pairs(t))
    follow, total, c = defaultdict(list), Counter(), Counter()
    for (u, v), k in n.items():
        follow[u].append(k)
        total[u] += k
        c[v] += 1

    def discounts(counts):
        y = Counter(counts)
        a = y[1] / (y[1] + 2 * y[2])
        return [0, *(min(max(j - (j + 1) * a * y[j + 1] / y[j] if y[j] else j / 2, 0.05), j - 0.05) for j in (1, 2, 3))]

    d, low = discounts(n.values()), discounts(c.values())
    left = sum(low[min(x, 3)] for x in c.values()) / len(n) / (len(c) + 1)

    def p(u, v):
        lower = (c[v] - low[min(c[v], 3)]) / len(n) + left
        gamma = sum(d[min(k, 3)] for k in follow[u]) / total[u] if total[u] else 1
        return ((n[u, v] - d[min(n[u, v], 3)]) / total[u] if n[u, v] else 0) + gamma * lower

    assert abs(sum(p("c1", v) for v in c) + p("c1", "?") - 1) < 1e-9
    for r in perplexity.classify(docs, labels).collect():
        own = [math.log(p(u, v)) for u, v in pairs(dict(texts)[r.doc_id])]
        assert abs(math.log(r.perplexity) + sum(own) / len(own)) < 1e-4


def test_perplexity_thresholds_of_rare_languages(spark):
    """Every language with trusted documents is judged by its own held-out ones, however few; others by all."""
    rng = random.Random(4)
    kinds = [("en", 300, 20), ("fr", 12, 2000), (None, 3, 500), ("", 2, 500), ("xx", 1, 50)]
    texts = [(lang, " ".join(f"{lang}{rng.randrange(size)}" for _ in range(60))) for lang, n, size in kinds for _ in range(n)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(999, "who knows", "zz")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in perplexity.held_out(docs, labels).collect()}
    got = perplexity.classify(docs, labels).collect()
    by = {lang: [r.perplexity for r in got if r.lang == lang and r.doc_id in held] for lang, _, _ in kinds}
    assert all(by.values()) and 30 <= len(by["en"]) <= 80 and len(by["fr"]) < 12
    for r in got:
        own = by.get(r.lang, sum(by.values(), []))
        assert r.threshold == max(own) if len(own) < 20 else min(own) <= r.threshold <= max(own)


def test_bpe(docs, nothing):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS for x in [e.encode_ordinary(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()) == want
    assert bpe.digests(nothing).count() == 0
    c, rng = bpe.Codec(*bpe._load(None, None)), random.Random(1)
    parts = ["a", "b", " ", " ", "'", "ll", "'s", "\n", "  ", "\t", "é", "1", "23", "!", "中", "😀", "\x1c", "don't", "ve", "　"]
    for _ in range(1500):
        x, leaf = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))), rng.choice([1, 2, 3, 5, 8, 20])
        assert c.encode_tree(x, leaf).tolist() == e.encode_ordinary(x) and c.decode_tree(c.encode_tree(x, leaf), 3) == x.encode()


def test_webp(docs, nothing):
    got = webp.store(docs).mapInArrow(webp._load, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()
    want = []
    for i, t in TEXTS:
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((str(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(want)
    assert webp.store(nothing).count() == 0


def test_webp_forms_of_stored_texts(spark):
    """Texts that repeat themselves are stored with back-references, those of few different characters with a palette; both are read back."""
    texts = [(1, "The quick brown fox jumps over the lazy dog, 0123456789.\n" * 500), (2, "0123 " * 3000), (3, " ".join(f"w{i * 7919 % 5000}" for i in range(3000)))]
    media = {r.doc_id: bytes(r.media) for r in webp.store(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    first = {i: [(webp._lane(x) is None, webp.body(x)[5] & 7) for x in webp.split(m)] for i, m in media.items()}
    assert first[1][0] == (True, 1 | webp.GREEN << 1) and first[2][0] == (True, 1 | webp.PALETTE << 1) and not any(general for general, _ in first[3])
    for i, t in texts:
        assert b"".join(x.tobytes() for x in webp.decode_tiles(webp.split(media[i]))) == webp.payload(t.encode())
    assert sum(map(len, (media[1], media[2]))) < 2500


def test_webp_features():
    # a picture of one transparent pixel, often used to find out whether a browser reads lossless pictures
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[[0, 0, 0, 0]]]
    rng = np.random.RandomState(1)

    def picture(h, w, n):
        return np.concatenate([np.full((h, w, 1), 255), rng.randint(0, n, (h, w, 3))], -1)

    def check(p, **how):
        assert (webp.decode(webp.encode(p, **how)) == p).all()

    for h, w in ((1, 1), (3, 5), (17, 33)):
        p = picture(h, w, 5)
        for how in ({}, {"cache_bits": 4}, {"references": True}, {"cache_bits": 3, "references": True}, {"transforms": ((webp.GREEN,),)}):
            check(p, **how)
        p = picture(h, w, 200)
        small = lambda s: (-(-h >> s), -(-w >> s))  # noqa: E731, B023
        for m in range(14):
            check(p, transforms=((webp.PREDICTOR, 2, np.full(small(2), m)),))
        check(p, transforms=((webp.PREDICTOR, 3, rng.randint(0, 14, small(3))), (webp.CROSS, 2, picture(*small(2), 256)), (webp.GREEN,)), references=True)
        for n in (1, 2, 4, 15, 100):
            check(picture(1, n, 256)[0][rng.randint(0, n, (h, w))], transforms=((webp.PALETTE,),))
    tiles = [np.full(192, 32, np.uint8), np.array([1, 255] * 96, np.uint8), rng.randint(0, 256, 576).astype(np.uint8)]
    assert all((a == b).all() for a, b in zip(tiles, webp.decode_tiles(webp.encode_tiles(tiles)), strict=True))
    with pytest.raises(ValueError):
        webp.decode(webp.encode(picture(9, 9, 200))[:60])


def test_webp_tiles_of_prose_have_back_references(spark):
    """Ordinary texts, not only those of long runs, are stored with back-references; steady steps with the predictor. All come back, and a cut is seen."""
    rng = np.random.RandomState(5)
    vocabulary = ["".join(chr(97 + c) for c in rng.randint(0, 26, n)) for n in rng.randint(3, 9, 400)]
    prose = [" ".join(rng.choice(vocabulary, n)) for n in (40, 300, 900, 5000)]
    tiles = [p[i : i + 6144] for t in prose for p in [np.frombuffer(webp.payload(t.encode()), np.uint8)] for i in range(0, len(p), 6144)]
    tiles += [np.full(192, 7, np.uint8), np.arange(6144).astype(np.uint8), rng.randint(0, 256, 6144).astype(np.uint8)]
    plain = webp.encode_tiles(tiles)
    for t, data in zip(tiles, plain, strict=True):
        assert (webp.decode(data)[..., 2].ravel() == t).all()

    def lengths(data):
        bits = webp.Bits(webp.body(data))
        webp.header(bits)
        assert bits.read(6) == 1 | webp.GREEN << 1
        return webp.read_lengths(bits, 280)[256:]

    assert all(lengths(x).any() for x in plain[1:-1]) and not lengths(plain[-1]).any()
    assert all((a == b).all() for a, b in zip(tiles, webp.decode_tiles(plain), strict=True))
    steady = np.cumsum(rng.randint(0, 3, 6144)).astype(np.uint8)
    stored = webp.fitting(steady, webp.encode_tiles([steady])[0])
    assert webp.body(stored)[5] & 7 == 1 | webp.PREDICTOR << 1 and (webp.decode_tiles([stored])[0] == steady).all()
    for data in plain[1:4]:
        own = webp.body(data)
        with pytest.raises(ValueError):
            webp.decode_tiles([webp.riff(own[: len(own) * 3 // 4])])


def test_id_files(docs, nothing, spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = [*TEXTS, (13, "a <|endoftext|> b"), (14, "<|endoftext|>"), (15, "x<|endoftext|><|endoftext|>  y <|endof text|>")]
    docs = spark.createDataFrame(rows(special), SCHEMA)
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    path = f"file://{tmp_path}/ids"
    idfiles.write_ids(docs, path, shard_ids=500)
    order = sorted(special, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for i, text in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, idfiles.read_all(spark, path).collect()), key=lambda r: r[1]) == want
    assert idfiles.lookup(spark, path, 3) == [[*t.encode("One two", add_special_tokens=False).ids, 0]]
    assert len(idfiles.lookup(spark, path, 8)) == 2 and idfiles.lookup(spark, path, 777) == []
    idfiles.write_ids(nothing, path + "0")
    assert idfiles.read_all(spark, path + "0").count() == 0


def test_key_index():
    keys = np.sort(np.random.RandomState(2).randint(-(2**62), 2**62, 5000))
    index = idfiles.KeyIndex.load(idfiles.KeyIndex.build(keys, np.arange(5001)).dump())
    row, n = index.find(keys)
    assert (row == np.arange(5000)).all() and (n == 1).all()
    assert index.find(keys + 1)[1].sum() <= 1


def test_decontamination(docs, nothing, spark, monkeypatch):
    bench = [(1, PASSAGE), (2, None), (3, ""), (4, "One, two"), (None, "two"), (5, "one two"), (5, "one two"), (6, "nowhere to be found in any of these texts at all indeed")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = []
    for i, t in TEXTS:
        w, hit, items = words(t, pattern), set(), set()
        for item, bt in bench:
            bw = words(bt, pattern)
            k = min(10, len(bw))
            for at in {x for x in range(len(w) - k + 1) for s in range(len(bw) - k + 1) if k and w[x : x + k] == bw[s : s + k]}:
                hit.update(range(at, at + k))
                items.update([] if item is None else [str(item)])
        want.append((str(i), len(w), len(hit), sorted(items)))
    for block in (4 << 20, 40):  # one block, then several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = [(str(r["row"].doc_id), r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.find_leaks(docs, b).collect()]
        assert sorted(got) == sorted(want)
    assert decontaminate.find_leaks(nothing, b).count() == 0 and decontaminate.find_leaks(docs, b.where("false")).where("n_hit > 0").count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "a <|end|> & &lt; b", 9), (1, 1, "user", None, 9), (1, 2, "assistant", "x", 9), (1, 2, "assistant", "y", 9), (1, 3, None, "z", 9), (None, 0, "r|o<le", "t", 9), (2, None, "assistant", "", 9), (2, None, "assistant", "", 9)]
    done = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int"))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.said) for r in done.select("conv_id", chat.read_turns(done["formatted"]).alias("turns"), chat.read_loss(done["formatted"], done["loss"]).alias("said")).collect()}
    assert got == {1: ([("user", "a <|end|> & &lt; b"), ("user", ""), ("assistant", "x"), ("assistant", "y"), ("", "z")], "xy"), None: ([("r|o<le", "t")], ""), 2: ([("assistant", ""), ("assistant", "")], "")}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_very_long(spark):
    """Thousands of turns, and a turn of a million characters, over several chunks of places."""
    said = [(7, i, ("user", "assistant", "assistant")[i % 3], f"t{i}<" * (i % 4) if i != 100 else "<x" * 500_000) for i in range(3000)]
    done = chat.format_chats(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    (r,) = done.select(chat.read_turns(done["formatted"]).alias("turns"), chat.read_loss(done["formatted"], done["loss"]).alias("said"), F.size("loss").alias("n")).collect()
    assert [tuple(t) for t in r.turns] == [t[2:] for t in said] and r.said == "".join(t[3] for t in said if t[2] == "assistant") and r.n == 2000


def test_urls(spark):
    link = lambda u: f'<html><head><link href="{u}" rel="canonical"></head></html>'
    pages = [
        (1, "http://a.net/es/1", link("http://b.org/2"), 0), (2, "http://b.org/2#x", None, 0), (3, "http://C.com/x", link("//b.org/2"), 0), (4, None, "", 0), (5, "no scheme", None, 0), (6, "http://www.example.com/en/1", None, 0),
        (7, "http://x.example.com/en/1?q", None, 0), (8, "http://d.org/a/b", '<meta http-equiv="refresh" content="0; url=../c">', 0), (9, "http://com", None, 0), (9, "http://com", None, 0), (10, "http://e.org/", link("/self"), 0),
    ]
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string, host int"), urls.RULES).collect()}
    assert got == {
        1: ("a.net", "/es/1", "net/es/", "block"), 2: ("b.org", "/2", None, "block"), 3: ("c.com", "/x", "com/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 7: ("x.example.com", "/en/1", "example.com/en/", "block"), 8: ("d.org", "/a/b", None, "allow"), 9: ("com", "", None, "allow"), 10: ("e.org", "/", None, "allow"),
    }
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "src string, dst string")
    from claimloom.llm.graph import components

    assert {r.component for r in components(chain, "src", "dst").collect()} == {"n000"}


def test_html(spark):
    page = (
        '<head><title>t</title></head><body><header><h1>Site</h1></header><nav><a>m</a></nav><div class="cookie-notice">we</div><main><article><h1>T &lt;b&gt;</h1><p>a<b>b</b>c  d&nbsp;e</p><form><p>f</p></form>'
        '<aside>s</aside><p>x<script>var a="</p>";</script>y</p><!-- c --><section id="comments"><article><p>no</p></article></section><ul><li>one<li>two</ul></article></main><footer>f</footer>'
    )
    pages = [(1, "http://h.org/1", page, "x"), (2, None, None, "x"), (3, "http://h.org/3", "", "x"), (3, "http://h.org/3", "", "x"), (4, "http://o.org/1", "<p>cut &amp; <b", "x"), (5, "u", "just < text", "x")]
    pages += [(10 + i, f"http://p.org/{i}", f"<div>the same everywhere</div><p>page {i}</p>", "x") for i in range(4)]
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    want = {1: "T <b> abc d e xy one two", 2: "", 3: "", 4: "cut &", 5: "just < text"} | {10 + i: f"page {i}" for i in range(4)}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_copies_of_one_page(spark):
    """Copies of a page, under one url or several or none, are no evidence that its text is the host's own."""
    page = "<div>all of this</div><p>is what the page says</p>"
    pages = [(i, f"http://c.org/{i % 2}", page) for i in range(5)] + [(10 + i, None, page) for i in range(4)]
    pages += [(20 + i, f"http://t.org/{i}", f"<div>the same everywhere</div><p>page {i % 3}</p>") for i in range(6)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "all of this is what the page says" for i in (*range(5), *range(10, 14))} | {20 + i: f"page {i % 3}" for i in range(6)}


def test_html_slots_of_the_wrapper_decide(spark):
    """Template text within articles goes, by the slot that it fills; prose under a class word stays; near copies are no evidence."""
    rng = random.Random(7)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    pages, want = [], {}
    for i in range(12):
        a, b, c = prose(40), prose(30), prose(5)
        extra = f"<p>{c}</p>" if i % 3 == 0 else ""
        pages.append((i, f"http://a.org/{i}", f'<article><p>Welcome to our site</p><h1>{a}</h1><p>{b}</p>{extra}<div class="legal">{c} {b}</div><div class="ad">{a}</div></article>'))
        want[i] = " ".join(x for x in (a, b, c if extra else "", f"{c} {b}") if x)
    words = prose(200).split()
    for i in range(3):
        near = " ".join([*words[:-1], f"end{i}"])
        pages.append((20 + i, f"http://n.org/{i}", f"<article><p>{near}</p><h2>stays as it is</h2></article>"))
        want[20 + i] = near + " stays as it is"
    assert {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == want
    wrapper = wrappers.align(wrappers.stream("<p>a</p><ul><li>x</li><li>y</li></ul>"), wrappers.stream("<p>a</p><div>b</div><ul><li>x<li>y<li>z</ul>"))
    leaves = list(wrappers._leaves(wrapper))
    tree = wrappers.stream("<p>a</p><ul><li>x</li><li>y</li></ul>")
    assert [leaves[p] for p in wrappers.match(tree, wrapper)] == list(wrappers._leaves(tree))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [(i, prose(80)) for i in range(400)]
    texts += [(400, texts[10][1]), (401, texts[11][1] + " more"), (402, " ".join(f"@@{rng.randint(0, 10**9)}%%" for _ in range(80))), (403, prose(40) + " " + PASSAGE), (404, None), (405, ""), (12, texts[12][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: bytes(r.ids) for r in C.run(spark, str(tmp_path)).collect()}
    clean = set(range(400))
    assert not set(got) & set(range(400, 406)) and len(got) >= 390 and set(got) <= clean
    codec = bpe.Codec(*bpe._load(None, None))
    assert all(codec.decode_tree(np.frombuffer(ids, "<u4")).decode() == dict(texts)[i] for i, ids in got.items())


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() on repeated and null ids, null languages, ties, empty texts and clashing columns: every stage's decisions made again in Python."""
    import corpus_pipeline as C
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(200)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [(i, prose(60), rng.choice(["en", "fr", None])) for i in range(150)]
    texts += [(150 + i, texts[i][1] + (" more" if i % 2 else ""), texts[i][2]) for i in range(12)]
    texts += [(3, prose(60), "en"), (3, prose(50), "en"), (None, prose(60), "en"), (None, texts[20][1] + " x", None), (5, texts[5][1], texts[5][2]), (200, "", "en"), (201, None, None), (202, "%% @@ " * 30, "en"), (203, prose(30) + " " + PASSAGE, "fr"), (204, PASSAGE, "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, keep boolean, items string, component_id long, n_words int"
    docs = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "r", 1, False, "i", 2, 3) for i, t, lang in texts], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    held = {(r.doc_id, r.lang, r.perplexity): r.keep for r in perplexity.classify(docs, labels).collect()}
    assert len({k[:2] for k in held}) == len({(i, lang) for i, _, lang in texts})
    keyed = docs.withColumn("own", perplexity.row_key(docs))
    kept = {r.key for r in perplexity.classify(docs, labels).collect() if r.keep}
    left = [(r.doc_id, r.text, r.lang) for r in keyed.collect() if r.own in kept]
    assert any(i is None for i, _, _ in left) and not any(i in (200, 201) for i, _, _ in left)

    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for _, t, _ in left for w in [words(t, r"[^\x20\x09-\x0D]+")]]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, row in zip(group, left, strict=True):
        best.setdefault(g, []).append(row)
    passages = [words(PASSAGE, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]
    windows = {tuple(w[k : k + 10]) for w in passages for k in range(len(w) - 9)}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for rows_ in best.values():
        i = min((r[0] is None, r[0] or 0) for r in rows_)
        own = [r for r in rows_ if (r[0] is None, r[0] or 0) == i]
        assert len({r[1:] for r in own}) == 1
        w = words(own[0][1], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            want.append((str(own[0][0]), str(own[0][2]), tuple(e.encode_ordinary(own[0][1]))))
    got = [(str(r.doc_id), str(r.lang), tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in C.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_stages_on_empty_tables(spark, nothing, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in C.STAGES:
        done = stage(spark, nothing, str(tmp_path))
        assert done.count() == 0 and (name == "byte_bpe" or done.columns == nothing.columns)


def test_pipeline_near_duplicates_of_repeated_and_null_ids(spark):
    import corpus_pipeline as C

    rng = random.Random(8)
    prose = lambda: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    # id 1 has a near copy of 2's text and one text of its own; 3 has two different texts; copies without an id; equal rows
    texts = [(0, b + " x"), (1, b), (1, a), (3, c), (3, d), (None, e), (None, e + " y"), (None, a + " z"), (4, ""), (5, None), (3, c), (6, prose())]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], schema)
    got = [(r.doc_id, r.text) for r in C.near_duplicates(spark, docs, "").collect()]
    e_left = [t for i, t in got if i is None]
    assert len(e_left) == 1 and e_left[0] in (e, e + " y")
    order = lambda x: (x[0], x[1] or "")
    assert sorted((x for x in got if x[0] is not None), key=order) == sorted([(0, b + " x"), (1, a), (3, c), (3, d), (4, ""), (5, None), texts[-1]], key=order)
