"""Benchmark decontamination: a prefix-filtered join of item windows against whole documents.

A window is ten consecutive words of a benchmark item (an item of fewer words is one window). Seen as a set of shingles (three words,
fewer where the window is shorter) a window occurs in a text only if all its shingles do, so one of them is enough to find every
candidate: the prefix of length one. The shingles are ordered by rarity, that is by their count over all documents (first pass), and the
rarest stands for its window. The second pass joins the document's shingles with these tokens; the token's offset gives the only
possible start (positional bound), the window must fit into the text (length bound), and all its words are then compared.

The benchmark is the stated query set: it is measured, cut into blocks of at most BLOCK_BYTES of text, and each block is broadcast and
run against all documents. With one block documents are neither shuffled nor written. With more, each block leaves a narrow table of what it
finds in different texts; these are put together by text and joined with the documents (broadcast below a checked number). A benchmark of
any size needs one block's memory at a time.

Edge cases: null or empty text (or item) has no words; repeated rows are judged each for itself; items with a null id cause hits but are
not listed; empty tables give empty results or no hits; other columns of the documents pass through `row` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IDS, forget, keep, shared_dir, small_batches, union
from .words import ALNUM, Lookup64, inner, text_words, windows

WINDOW = 10
SHINGLE = 3
#: Text of one block of benchmark items: what is collected and broadcast at once.
BLOCK_BYTES = 4 << 20
#: Candidates compared at once.
_CHUNK = 1 << 20


class Block:
    """Windows of some items: per window length the words of each distinct window, and which items have it."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        import pyarrow as pa

        h, first = text_words(pa.array([t for _, t in items], pa.string()), ALNUM)
        by_length: dict[int, dict[bytes, set[str]]] = {}
        for (key, _), s, e in zip(items, first[:-1], first[1:], strict=True):
            k = min(window, int(e - s))
            for i in range(s, e - k + 1) if k else ():
                by_length.setdefault(k, {}).setdefault(h[i : i + k].tobytes(), set()).update([] if key is None else [key])
        self.lengths = {}
        for k, found in sorted(by_length.items()):
            words = np.frombuffer(b"".join(found), np.uint64).reshape(-1, k)
            self.lengths[k] = words, [sorted(x) for x in found.values()]

    def shingles(self, k: int) -> np.ndarray:
        """Hash of every shingle of every window of k words: one row a window."""
        words, _ = self.lengths[k]
        s = min(SHINGLE, k)
        return np.stack([np.asarray([windows(row[j : j + s], s)[0] for row in words], np.uint64) for j in range(k - s + 1)], 1) if len(words) else np.empty((0, k - s + 1), np.uint64)


def _count(lookups):
    """First pass: how often each shingle of the block occurs in the documents."""

    def run(batches):
        import pyarrow as pa

        total = {s: np.zeros(len(x.values), np.int64) for s, x in lookups.items()}
        for b in batches:
            h, first = text_words(b.column(0), ALNUM)
            for s, x in lookups.items():
                at = inner(first, s)
                if len(at):
                    _, i = x.hits(windows(h, s)[at])
                    total[s] += np.bincount(i, minlength=len(x.values))
        for s, n in total.items():
            i = np.flatnonzero(n)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s), pa.int32()), pa.array(i, pa.int64()), pa.array(n[i], pa.int64())], ["s", "i", "n"])

    return run


def _plan(block: Block, docs: DataFrame) -> list[tuple]:
    """For each window length: its prefix tokens (sorted), and for each token the windows that it stands for and its offset in them."""
    spark = docs.sparkSession
    made = {k: block.shingles(k) for k in block.lengths}
    values: dict[int, np.ndarray] = {}
    for k, sh in made.items():
        s = min(SHINGLE, k)
        values[s] = np.union1d(values.get(s, np.empty(0, np.uint64)), sh.ravel())
    lookups = {s: Lookup64(v) for s, v in values.items()}
    seen = spark.sparkContext.broadcast(lookups)
    rare = {s: np.zeros(len(v), np.int64) for s, v in values.items()}
    counted = docs.select("text").mapInArrow(lambda batches: _count(seen.value)(batches), "s int, i long, n long").groupBy("s", "i").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most one row for each shingle of the block
        rare[r["s"]][r["i"]] = r["n"]
    seen.unpersist()
    out = []
    for k, sh in made.items():
        s = min(SHINGLE, k)
        count = rare[s][np.searchsorted(values[s], sh)]
        best = np.lexsort((sh, count), axis=1)[:, 0] if sh.shape[1] > 1 else np.zeros(len(sh), np.int64)
        token = sh[np.arange(len(sh)), best]
        order = np.argsort(token, kind="stable")
        tokens, start = np.unique(token[order], return_index=True)
        out.append((k, s, Lookup64(tokens), np.append(start, len(order)), order, best[order], *block.lengths[k]))
    return out


def match(h: np.ndarray, first: np.ndarray, plan: list[tuple]):
    """Yields (start, length, window's items) arrays of all occurrences: for each window length, start positions and window numbers."""
    shingles: dict[int, tuple] = {}
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, s, tokens, start, window, offset, words, items in plan:
        if s not in shingles:
            at = inner(first, s)
            shingles[s] = at, windows(h, s)[at] if len(at) else np.empty(0, np.uint64)
        at, sh = shingles[s]
        pos, tok = tokens.hits(sh)
        if not len(pos):
            continue
        pos = at[pos]
        many = start[tok + 1] - start[tok]
        for lo, hi in _chunks(many):
            n = many[lo:hi]
            p, t = np.repeat(pos[lo:hi], n), np.repeat(start[tok[lo:hi]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            w, begin = window[t], p - offset[t]
            text = text_of[p]
            ok = (begin >= first[text]) & (begin + k <= first[text + 1])  # position and length
            w, begin, text = w[ok], begin[ok], text[ok]
            same = np.ones(len(w), bool)
            for j in range(k):
                same &= h[begin + j] == words[w, j]
            if same.any():
                yield k, begin[same], text[same], w[same], items


def _chunks(many: np.ndarray):
    total = np.cumsum(many)
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _CHUNK, "right")))
        yield lo, hi
        lo = hi


def _judged(column, plan) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Of a batch of texts: the index of each one's first word, which words are hit, and the items of each text."""
    h, first = text_words(column, ALNUM)
    edge = np.zeros(len(h) + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(len(column))]
    for k, begin, text, w, whose in match(h, first, plan):
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + k, -1)
        for i, x in set(zip(text.tolist(), w.tolist(), strict=True)):
            items[i].update(whose[x])
    return first, np.cumsum(edge[:-1]) > 0, items


def _scan(plan):
    """Second pass, columns row, text: what the only block finds in each document."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            first, hit, items = _judged(b.column(1), plan)
            total = np.concatenate([[0], np.cumsum(hit)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(np.diff(first).astype(np.int64)), pa.array((total[first[1:]] - total[first[:-1]]).astype(np.int64))], ["row", "items", "n_words", "n_hit"]
            )

    return run


def _findings(plan):
    """Second pass, columns k1, k2, text: of the documents in which a block finds something the words that are hit (a bit each) and the items."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            first, hit, items = _judged(b.column(2), plan)
            some = [i for i in range(len(b)) if hit[first[i] : first[i + 1]].any()]
            cover = pa.array([np.packbits(hit[first[i] : first[i + 1]]).tobytes() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), b.column(1).take(pa.array(some, pa.int64())), cover, pa.array([sorted(items[i]) for i in some], pa.list_(pa.string()))], ["k1", "k2", "cover", "items"])

    return run


def _together(pdf):
    """What all blocks find in one text."""
    import pandas as pd

    bits = np.bitwise_or.reduce([np.frombuffer(c, np.uint8) for c in pdf["cover"]])
    return pd.DataFrame({"k1": pdf["k1"].iloc[:1], "k2": pdf["k2"].iloc[:1], "items": [sorted(set().union(*pdf["items"]))], "n_hit": [int(np.unpackbits(bits).sum())]})


def _counted(batches):
    import pyarrow as pa

    for b in batches:
        _, first = text_words(b.column(3), ALNUM)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(first).astype(np.int64))], ["row", "k1", "k2", "n_words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document: `row` (the whole input row), `items` (sorted ids with occurring windows), `n_words`, `n_hit`."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    text = F.col("text").cast("string").alias("text")
    row = F.struct("*").alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()

    def plan(part: DataFrame):
        return spark.sparkContext.broadcast(_plan(Block([(r[0], r[1]) for r in part.collect()], window), docs.select(text)))

    if blocks == 1:
        only = plan(bench)
        return docs.select(row, text).mapInArrow(lambda batches: _scan(only.value)(batches), f"row {kind}, items array<string>, n_words long, n_hit long")
    # what blocks find is narrow and known by two hashes of the text, so no block writes the documents anew
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2")]
    found = []
    for n in range(blocks):
        part = plan(bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n))
        here = docs.select(*keys, text).mapInArrow(lambda batches, part=part: _findings(part.value)(batches), "k1 long, k2 long, cover binary, items array<string>")
        found.append(keep(here.groupBy("k1", "k2").agg(F.first("cover").alias("cover"), F.first("items").alias("items")), "found"))
        part.destroy()
    every = keep(union(found).groupBy("k1", "k2").applyInPandas(_together, "k1 long, k2 long, items array<string>, n_hit long"), "leaks")
    forget(*found)
    counted = docs.select(row, *keys, text).mapInArrow(_counted, f"row {kind}, k1 long, k2 long, n_words long")
    all_ = counted.join(F.broadcast(every) if every.count() <= IDS >> 4 else every, ["k1", "k2"], "left")
    return all_.select("row", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, item_id, i, k FROM dw JOIN bw USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op10_decontaminate": op10}
SQL = {"op10_decontaminate": OP10_SQL}
