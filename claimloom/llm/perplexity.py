"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Words are known by 64-bit hashes, a bigram by the hashes of its two words. The log probability of a word v after u,
max(n - D, 0) / total(u) + gamma(u) lower(v), is log lower(v) + log gamma(u) and, for a seen bigram, log1p of the first part by the second:
a sum of values that each belong to one word or one bigram.

Bigrams lie in a square grid of shards: a shard has the contexts of one range of hashes and the words of another, so a word before or after
which very many others occur is spread over a whole row or column. Words lie in shards of their own, by ranges of the same hashes. Shards
follow the size of the input; whatever moves between passes is packed by block and shard (see packing).

1. Counting. Tasks gather blocks of trusted documents that are not held out and send each shard its bigrams with their counts.
2. Words. Each shard of bigrams sends what it knows of contexts (total, how many bigrams with count 1, 2, more) and of words (how many
   contexts) to the shards of words, which add up. Discounts come from sums over all shards.
3. Values. Each shard of bigrams asks the shards of words for what belongs to its contexts and words, and computes its bigrams' values.
   The most frequent keys with their values (HEAD at most: an exact cache) and filters of a fixed number of bits are broadcast.
4. Scoring, in ROUNDS passes over a part of the documents each (as 3 is over parts of the bigrams), which bounds what lies on disk at once. Every word counts as unknown at
   first. Keys that the head knows are added there; those that a filter passes are asked for at their shard, which returns what they add for
   each document. The filters have no false negatives, so the result is exact whatever their load.
5. A document is kept if its perplexity is at most the QUANTILE of the held-out trusted documents of its language. Every language with
   trusted documents has held-out ones: a tenth, but LEAST of them (half, if there are fewer than twice as many; one in any case) where
   that is more. Only languages without any trusted document are judged by the quantile of all languages.

Edge cases: null or empty text, or text without words, has no perplexity (null) and is rejected; a null language is a language of its own;
repeated rows get equal scores; labels that contradict each other for one document make it untrusted; without any trusted document
nothing can be judged and all documents with words are kept; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep, lean, shared_dir, small_batches, union
from .packing import BLOCK_DOCS, block_keys, cuts, pack, shard_of, shards_for, squeeze, thick, thin, unpack, widen
from .words import SPACED, mix, text_words

#: The share of held-out trusted documents that a language's threshold keeps.
QUANTILE = 0.995
#: Held-out trusted documents that each language is to have.
LEAST = 50
#: The most frequent keys that are broadcast with their values: an exact cache.
HEAD = 1 << 20
#: Bits of the filter of bigrams, and of that of words.
FILTER_BITS, WORD_BITS = 27, 24
#: Bigrams are valued, and documents scored, in so many passes.
ROUNDS = 3
#: Up to so many trusted ids (or thresholds) are broadcast; beyond that documents and labels are joined with a shuffle.
IDS = 1 << 20
#: Shards of words for each row of the grid.
_WORDS = 4
#: What a key says: a bigram, a word followed by another, a word that ends its text.
_PAIR, _INNER, _LAST = 11, 12, 13
START = np.uint64(0)


def _bigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word (64-bit hashes) of every word of each text (the first follows START), and the index of each text's first word."""
    v, first = text_words(column, SPACED)
    u = np.concatenate([[START], v[:-1]])[: len(v)].astype(np.uint64)
    at = first[:-1]
    u[at[at < first[1:]]] = START
    return u, v, first


def _key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Keys of bigrams: 56 bits are as many as a shard needs to tell its own apart."""
    with np.errstate(over="ignore"):
        return mix(mix(u, _PAIR) * np.uint64(0x9E3779B97F4A7C15) + v, _PAIR) >> np.uint64(8)


def _word_key(w: np.ndarray, what: int) -> np.ndarray:
    return mix(w, what) >> np.uint64(8)


class Grid:
    """Numbers of shards: side * side of bigrams, then those of words."""

    def __init__(self, side: int):
        self.side, self.pairs, self.words = side, side * side, _WORDS * side
        self.all = self.pairs + self.words

    def of_pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (shard_of(u, self.side) * np.uint64(self.side) + shard_of(v, self.side)).astype(np.int64)

    def of_word(self, w: np.ndarray) -> np.ndarray:
        return self.pairs + shard_of(w, self.words).astype(np.int64)

    def stretch(self, shard) -> int:
        """Bits that a shard has in its filter (a whole number of bytes)."""
        return max(8, (1 << FILTER_BITS) // self.pairs & ~7) if shard < self.pairs else max(8, (1 << WORD_BITS) // self.words & ~7)


def _runs(*sorted_columns) -> np.ndarray:
    """Where a new combination of values begins."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _lengths(at: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(at, n))


def _matrix(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted bigrams and their counts as one cell."""
    at = _runs(u)
    return pack(len(at), *squeeze(u[at]), thin(_lengths(at, len(u))), v.astype("<u8").tobytes(), thin(n))


def _entries(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, the index of each bigram's, words, counts."""
    k, first, width, data, lengths, v, n = unpack(cell)
    return widen(first, width, data, k), np.repeat(np.arange(k), thick(lengths)), np.frombuffer(v, "<u8"), thick(n)


def _counting(side: int):
    """Column text: blocks' bigrams by shard."""
    grid = Grid(side)
    full = block_keys(grid.pairs)

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def send():
            u, v = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            where = grid.of_pair(u, v)
            by = np.lexsort((v, u, where))
            u, v, where = u[by], v[by], where[by]
            at = _runs(where, u, v)
            n, u, v, where = _lengths(at, len(u)), u[at], v[at], where[at]
            cut = np.searchsorted(where, np.arange(grid.pairs + 1))
            some = [s for s in range(grid.pairs) if cut[s] < cut[s + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_matrix(*(x[cut[s] : cut[s + 1]] for x in (u, v, n))) for s in some], pa.binary())], ["shard", "cell"])

        for b in batches:
            u, v, _ = _bigrams(b.column(0))
            if len(u):
                held.append((u, v))
            if sum(len(x[0]) for x in held) >= full:
                yield send()
        if held:
            yield send()

    return run


def _four(n: np.ndarray) -> list[int]:
    """How often the counts 1, 2, 3 and 4 are there."""
    return [int((n == j).sum()) for j in (1, 2, 3, 4)]


_FOUR = ["one", "two", "three", "four"]


def _added(pdf):
    """A shard's bigrams with their counts over all blocks."""
    import pandas as pd

    parts = [_entries(c) for c in pdf["cell"]]
    u, v, n = np.concatenate([p[0][p[1]] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64)
    parts.clear()
    by = np.lexsort((v, u))
    u, v, n = u[by], v[by], n[by]
    at = _runs(u, v)
    n, u, v = np.add.reduceat(n, at), u[at], v[at]
    return pd.DataFrame([(int(pdf["shard"].iloc[0]), _matrix(u, v, n), *_four(n))], columns=["shard", "cell", *_FOUR])


def _by_word(grid: Grid, w: np.ndarray):
    """Ranges of sorted words by shard of words: (shard, from, to)."""
    cut = cuts(w, grid.words)
    return [(grid.pairs + s, cut[s], cut[s + 1]) for s in range(grid.words) if cut[s] < cut[s + 1]]


def _margins(side: int):
    """Of each shard of bigrams: its contexts' totals and counts of counts, its words' numbers of contexts, by shard of words."""
    grid = Grid(side)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for cell in b.column(0).to_pylist():
                us, i, v, n = _entries(cell)
                cols = [np.bincount(i, weights, len(us)).astype(np.int64) for weights in (n, n == 1, n == 2, n > 2)]
                vs, c = np.unique(v, return_counts=True)
                out = [(s, pack(True, z - a, *squeeze(us[a:z]), *(thin(x[a:z]) for x in cols))) for s, a, z in _by_word(grid, us)]
                out += [(s, pack(False, z - a, *squeeze(vs[a:z]), thin(c[a:z]))) for s, a, z in _by_word(grid, vs)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["shard", "cell"])

    return run


def _word_table(pdf):
    """A shard's words: total and counts of counts as contexts, number of contexts as words."""
    import pandas as pd

    w, cols = [], []
    for cell in pdf["cell"]:
        as_context, k, first, width, data, *x = unpack(cell)
        w.append(widen(first, width, data, k))
        x = [thick(y).astype(np.int64) for y in x]
        cols.append(np.stack([*x, np.zeros(k, np.int64)] if as_context else [np.zeros(k, np.int64)] * 4 + x))
    w, cols = np.concatenate(w), np.concatenate(cols, axis=1)
    by = np.argsort(w, kind="stable")
    w, cols = w[by], cols[:, by]
    at = _runs(w)
    w, cols = w[at], np.add.reduceat(cols, at, axis=1)
    c = cols[4]
    return pd.DataFrame([(int(pdf["shard"].iloc[0]), pack(len(w), *squeeze(w), *map(thin, cols)), int((c > 0).sum()), int(c.sum()), *_four(c))], columns=["shard", "cell", "kinds", "types", *_FOUR])


def _discounts(n: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the numbers of keys with count 1 to 4; index 0 is for count 0."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    d = [j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] else j / 2 for j in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), j - 0.05) for j, x in zip((1, 2, 3), d, strict=True))])


class Smoothing:
    """The numbers that hold for the whole model: discounts, and what an unknown word gets."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray, kinds: int, types: int):
        self.d, self.low, self.types = _discounts(pairs), _discounts(words), types
        left = self.low[1] * words[0] + self.low[2] * words[1] + self.low[3] * (kinds - words[0] - words[1])
        # unknown words share what the known ones leave as one more word would
        self.spread = left / types / (kinds + 1) if kinds else 1.0

    def words(self, cell: bytes):
        """Words, frequency as contexts, discounts taken of each, lower-order probability (spread where not seen as a word)."""
        k, first, width, data, *cols = unpack(cell)
        total, n1, n2, n3, c = (thick(x).astype(np.float64) for x in cols)
        lower = (c - self.low[np.minimum(c, 3).astype(int)]) / (self.types or 1) + self.spread
        return widen(first, width, data, k), total, self.d[1] * n1 + self.d[2] * n2 + self.d[3] * n3, lower


_REPLY = "shard int, by int, as_context boolean, cell binary"


def _asking(side: int):
    """Columns shard, cell of bigrams: the contexts and words that the shard needs to know of."""
    grid = Grid(side)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for shard, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                us, _, v, _ = _entries(cell)
                out = [(s, shard, what, pack(z - a, *squeeze(w[a:z]))) for what, w in ((True, us), (False, np.unique(v))) for s, a, z in _by_word(grid, w)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], ["shard", "by", "as_context", "cell"])

    return run


def _replying(smoothing: Smoothing):
    def run(asked, table):
        import pandas as pd

        w, _, gone, lower = smoothing.words(table["cell"].iloc[0])
        out = []
        for shard, by, what, cell in asked.itertuples(index=False):
            k, *x = unpack(cell)
            at = np.searchsorted(w, widen(*x, k))
            out.append((by, shard, what, (gone if what else lower)[at].astype("<f4").tobytes()))
        return pd.DataFrame(out, columns=["shard", "by", "as_context", "cell"])

    return run


_VALUES = "shard int, cell binary, bits binary, head binary"


def _valued(shard: int, stretch: int, k: np.ndarray, x: np.ndarray, n: np.ndarray, head: int) -> tuple:
    """A shard's table: keys and what they add; its stretch of the filter; its most frequent keys."""
    by = np.argsort(k)
    k, x, n = k[by], x[by].astype("<f4"), n[by]
    bits = np.zeros(stretch, bool)
    bits[(k >> np.uint64(24)) * np.uint64(stretch) >> np.uint64(32)] = True
    top = np.sort(np.argpartition(n, len(n) - head)[len(n) - head :]) if 0 < head < len(n) else np.arange(min(head, len(n)))
    return shard, pack(len(k), *squeeze(k), x.tobytes()), np.packbits(bits).tobytes(), pack(k[top].tobytes(), x[top].tobytes())


def _pair_values(side: int, smoothing: Smoothing, head: int):
    grid = Grid(side)

    def run(table, replies):
        import pandas as pd

        us, i, v, n = _entries(table["cell"].iloc[0])
        rows = sorted(replies[["as_context", "by", "cell"]].itertuples(index=False))
        gone, lower = (np.concatenate([np.frombuffer(c, "<f4") for what, _, c in rows if what == side_]).astype(np.float64) for side_ in (True, False))
        _, j = np.unique(v, return_inverse=True)
        d = smoothing.d[np.minimum(n, 3).astype(int)]
        shard = int(table["shard"].iloc[0])
        return pd.DataFrame([_valued(shard, grid.stretch(shard), _key(us[i], v), np.log1p((n - d) / (gone[i] * lower[j])), n, head // grid.pairs)], columns=["shard", "cell", "bits", "head"])

    return run


def _word_values(side: int, smoothing: Smoothing, head: int):
    grid = Grid(side)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for shard, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w, total, gone, lower = smoothing.words(cell)
                last = np.log(lower / smoothing.spread)
                inner = last + np.log(np.where(total > 0, gone / np.maximum(total, 1), 1))
                row = _valued(shard, grid.stretch(shard), np.concatenate([_word_key(w, _INNER), _word_key(w, _LAST)]), np.concatenate([inner, last]), np.concatenate([total, np.zeros(len(w))]), head // grid.words)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "cell", "bits", "head"])

    return run


class Model:
    """What is broadcast: the head, the filters, what an unknown word gets. Sizes do not depend on the input."""

    def __init__(self, rows, side: int, unknown: float):
        self.grid, self.unknown = Grid(side), unknown
        self.bits = [np.zeros(max(1, n * self.grid.stretch(s) // 8), np.uint8) for n, s in ((self.grid.pairs, 0), (self.grid.words, self.grid.pairs))]
        heads = []
        for shard, bits, head in rows:
            words = shard >= self.grid.pairs
            size = self.grid.stretch(shard) // 8
            lo = (shard - self.grid.pairs * words) * size
            self.bits[words][lo : lo + size] = np.frombuffer(bits, np.uint8)
            k, x = unpack(head)
            heads.append((np.frombuffer(k, "<u8"), np.frombuffer(x, "<f4")))
        k = np.concatenate([k for k, _ in heads]) if heads else np.empty(0, np.uint64)
        by = np.argsort(k)
        self.head, self.head_value = k[by], np.concatenate([x for _, x in heads])[by] if heads else np.empty(0, np.float32)

    def may_know(self, k: np.ndarray, shard: np.ndarray, words: bool) -> np.ndarray:
        stretch = self.grid.stretch(self.grid.pairs if words else 0)
        bit = (shard - (self.grid.pairs if words else 0)) * stretch + ((k >> np.uint64(24)) * np.uint64(stretch) >> np.uint64(32)).astype(np.int64)
        return ((self.bits[words][bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)


def _find(keys: np.ndarray, values: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and their values (0 where not)."""
    if not len(keys):
        return np.zeros(len(k), bool), np.zeros(len(k), np.float64)
    i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    there = keys[i] == k
    return there, np.where(there, values[i], 0).astype(np.float64)


REQUEST = "flush long, shard int, own binary, cell binary"
_OWN = [("key", "<i8"), ("n", "<i8"), ("base", "<f8")]


def _ask(model):
    """Columns key, text: the documents' own sums (as a row of any shard, without keys), and requests to the tables."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        m: Model = model.value
        full = block_keys(m.grid.all)
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def send():
            nonlocal seq, size
            flush = (part << 32) | seq
            keys, words, base = (np.concatenate([x[i] for x in held]) for i in range(3))
            shift = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            doc = np.concatenate([x[3] + s for x, s in zip(held, shift, strict=True)]).astype("<u2")
            k, shard = (np.concatenate([x[i] for x in held]) for i in (4, 5))
            seq, size = seq + 1, 0
            held.clear()
            by = np.lexsort((k, shard))
            doc, k = doc[by], k[by]
            cut = np.searchsorted(shard[by], np.arange(m.grid.all + 1))
            out = [(flush, s, None, pack(len(keys), z - a, *squeeze(k[a:z]), doc[a:z].tobytes())) for s, a, z in zip(range(m.grid.all), cut, cut[1:], strict=False) if a < z]
            out.append((flush, flush % m.grid.all, np.rec.fromarrays([keys, words, base], dtype=_OWN).tobytes(), None))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["flush", "shard", "own", "cell"])

        for b in batches:
            u, v, first = _bigrams(b.column(1))
            last = np.zeros(len(v), bool)
            last[first[1:][first[1:] > first[:-1]] - 1] = True
            n = np.diff(first)
            of = np.repeat(np.arange(len(b)), n)
            base, asked = n * m.unknown, []
            starts = np.flatnonzero(n)
            start = np.zeros(len(starts), np.uint64)
            for k, shard, doc, words in (
                (_key(u, v), m.grid.of_pair(u, v), of, False),
                (np.where(last, _word_key(v, _LAST), _word_key(v, _INNER)), m.grid.of_word(v), of, True),
                (_word_key(start, _INNER), m.grid.of_word(start), starts, True),
            ):
                at = np.flatnonzero(m.may_know(k, shard, words))
                there, x = _find(m.head, m.head_value, k[at])
                base = base + np.bincount(doc[at], x, minlength=len(b))
                at = at[~there]
                asked.append((doc[at], k[at], shard[at]))
            held.append((b.column(0).to_numpy(zero_copy_only=False), n, base, *(np.concatenate(x) for x in zip(*asked, strict=True))))
            size += len(held[-1][3])
            if size >= full or sum(len(x[0]) for x in held) >= BLOCK_DOCS:
                yield send()
        if held:
            yield send()

    return run


def _answer(asked, table):
    """A shard's requests and its table: what the known keys add, for each flush and document. Own sums are passed on."""
    import pandas as pd

    keys, values = np.empty(0, np.uint64), np.empty(0, np.float32)
    if len(table):
        n, *x, data = unpack(table["cell"].iloc[0])
        keys, values = widen(*x, n), np.frombuffer(data, "<f4")
    out = []
    for flush, own, cell in zip(asked["flush"], asked["own"], asked["cell"], strict=True):
        if cell is None:
            out.append((flush, own, None))
            continue
        docs, n, *x, doc = unpack(cell)
        there, x = _find(keys, values, widen(*x, n))
        gain = np.bincount(np.frombuffer(doc, "<u2")[there], x[there], minlength=docs).astype("<f4")
        at = np.flatnonzero(gain)
        if len(at):
            out.append((flush, None, pack(None, gain.tobytes()) if 6 * len(at) > 4 * docs else pack(at.astype("<u2").tobytes(), gain[at].tobytes())))
    return pd.DataFrame(out, columns=["flush", "own", "gain"])


def _total(pdf):
    import pandas as pd

    own = np.frombuffer(next(x for x in pdf["own"] if x is not None), _OWN)
    total = own["base"].copy()
    for x in sorted(x for x in pdf["gain"] if x is not None):  # in a fixed order, so that sums are the same every time
        at, gain = unpack(x)
        total[slice(None) if at is None else np.frombuffer(at, "<u2")] += np.frombuffer(gain, "<f4")
    with np.errstate(divide="ignore", invalid="ignore"):
        each = -total / own["n"]
    return pd.DataFrame({"key": own["key"], "n_words": own["n"], "nats": np.where(own["n"] > 0, each, np.nan)})


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that are labelled good and not toxic."""
    by = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return by.where("q = 1 and t = 0").select(F.col("doc_id").cast("long").alias("doc_id"))


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of the trusted documents that set the thresholds, of every language its own."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).join(trusted_ids(labels), "doc_id").distinct()
    known = keep(known.withColumn("at", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(1 << 30))), "trusted")
    by = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    share = by.select(F.col("lang").alias("l"), "first", (F.greatest(F.lit(0.1), F.least(F.lit(0.5), LEAST / F.col("n"))) * (1 << 30)).alias("below"))
    return known.join(share, F.col("lang").eqNullSafe(F.col("l"))).where("at < below or at = first").select("doc_id").distinct()


def _training(docs: DataFrame, labels: DataFrame, held: DataFrame) -> DataFrame:
    """The texts that the model is made of."""
    ids = keep(trusted_ids(labels).join(held, "doc_id", "left_anti"), "training")
    return docs.join(F.broadcast(ids) if ids.count() <= IDS else ids, "doc_id", "left_semi").select("text")


def train(docs: DataFrame, labels: DataFrame, held: DataFrame) -> tuple[list[DataFrame], Model]:
    """The written tables of values (shard, cell, bits, head) and what is broadcast."""
    side = max(1, int(np.ceil(shards_for(docs) ** 0.5)))
    four = ", ".join(f"{x} long" for x in _FOUR)
    counted = _training(docs, labels, held).mapInArrow(_counting(side), "shard int, cell binary")
    counts = keep(counted.groupBy("shard").applyInPandas(_added, f"shard int, cell binary, {four}"), "counts")
    totals = lambda df, *names: [x or 0 for x in df.agg(*(F.sum(n) for n in names)).first()]
    seen = np.array(totals(counts, *_FOUR), np.float64)
    made = counts.select("cell").mapInArrow(_margins(side), "shard int, cell binary").groupBy("shard").applyInPandas(_word_table, f"shard int, cell binary, kinds long, types long, {four}")
    words = keep(made, "words", batch=1)
    kinds, types, *low = totals(words, "kinds", "types", *_FOUR)
    smoothing = Smoothing(seen, np.array(low, np.float64), kinds, types)
    asked = counts.select("shard", "cell").mapInArrow(_asking(side), _REPLY)
    replies = keep(asked.groupBy("shard").cogroup(words.select("shard", "cell").groupBy("shard")).applyInPandas(_replying(smoothing), _REPLY), "replies", batch=1)
    tables = []
    for r in range(ROUNDS):
        part = lambda df, r=r: df.where(F.col("shard") % ROUNDS == r).groupBy("shard")
        tables.append(keep(part(counts.select("shard", "cell")).cogroup(part(replies)).applyInPandas(_pair_values(side, smoothing, HEAD // 2), _VALUES), "pairs", batch=1))
    forget(counts, replies)
    tables.append(keep(words.select("shard", "cell").mapInArrow(_word_values(side, smoothing, HEAD // 2), _VALUES), "word-values", batch=1))
    forget(words)
    rows = union(tables).select("shard", "bits", "head").toLocalIterator()  # fixed size
    return tables, Model(((r["shard"], bytes(r["bits"]), bytes(r["head"])) for r in rows), side, float(np.log(smoothing.spread)))


def scores(docs: DataFrame, labels: DataFrame, held: DataFrame) -> DataFrame:
    """key, n_words, nats (mean negative log probability of a word; null without words) for each row of docs (key, doc_id, text)."""
    spark = docs.sparkSession
    lean()
    tables, made = train(docs, labels, held)
    model = spark.sparkContext.broadcast(made)
    del made
    values = union(tables).select("shard", "cell").groupBy("shard")
    done = []
    for r in range(ROUNDS):
        asked = docs.where(F.pmod("key", F.lit(ROUNDS)) == r).select("key", "text").mapInArrow(_ask(model), REQUEST)
        answered = asked.groupBy("shard").cogroup(values).applyInPandas(_answer, "flush long, own binary, gain binary")
        done.append(keep(answered.groupBy("flush").applyInPandas(_total, "key long, n_words long, nats double"), "round"))
    forget(*tables)
    model.destroy()
    return union(done)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """key, doc_id, lang, n_words, perplexity, threshold, keep for each row of docs. `key` hashes the row's id, language and text."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    own = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    held = keep(held_out(own, labels), "held-out")
    scored = keep(scores(own, labels, held).groupBy("key").agg(F.first("n_words").alias("n_words"), F.first(F.nanvl("nats", F.lit(None))).alias("nats")), "scores")
    rows = own.select("key", "doc_id", "lang").join(scored, "key", "left").withColumn("perplexity", F.exp("nats"))
    sample = rows.where(F.col("perplexity").isNotNull()).join(held, "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", quantile, 10000)
    anywhere = sample.agg(limit).first()[0]
    by = keep(sample.groupBy(F.col("lang").alias("l")).agg(limit.alias("own")), "thresholds")
    rows = rows.join(F.broadcast(by) if by.count() <= IDS else by, F.col("lang").eqNullSafe(F.col("l")), "left")
    rows = rows.withColumn("threshold", F.coalesce("own", F.lit(float("inf") if anywhere is None else anywhere)))
    return rows.select("key", "doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))


def row_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["text"].cast("string"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("key")


QUERIES = {"op4_quality_classifier": op4}
SQL: dict[str, str] = {}
