"""Phrase collocation mining by pivot partitioning: fragments of rewritten text go to each n-gram's rarest word and are mined there.

1. Words. Blocks of texts send their words with counts; (language, word) and its occurrences are a table of words that occur LEAST times or more.
   A word is known by a 64-bit hash of language and word from here on, so everything after is by language by itself.
2. Order. A table of 2 ** LEVEL_BITS bytes is broadcast, of a fixed size: for a hash, the greatest logarithm of a count among the words that share its
   upper bits; 0 where no frequent word has them. A word is rarer than another if its level is less, or its hash at the same level: one
   order of all words, which follows their counts as closely as words do not share a byte of the table. Any order gives the same result.
3. Fragments. Around each occurrence of a word, the pivot, the text is cut at piece borders, at words of level 0 (too rare for any phrase) and at
   words rarer than the pivot, at most LONGEST - 1 words to either side. Equal fragments of a block are counted once, then sent to the
   pivot's shard with their number. A pivot that is frequent has few frequent neighbours, so its fragments are mostly equal ones; it sends one
   row for each different one and block.
4. Mining. A shard counts the n-grams that contain the pivot in the middle of its fragments, and no earlier occurrence of it: each occurrence of an
   n-gram belongs to one pivot and one place, so counts are whole where they are made, and nothing else is emitted.
5. Scores. Parts of a phrase are words or phrases of the same table; they meet by joins on hashes. Scores are exact in decimal(38), which holds them
   up to 10^15 occurrences of a phrase. The first rows of a language come from SPREAD ranges first, then from those that are left.

Edge cases: null or empty text has no words; a null language is `und` and one with the language of that name; repeated rows count each; words and
phrases that tie are ordered by their UTF-8 bytes; an empty table, or one without phrases that are frequent enough, gives no rows; columns
other than text and lang are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, shared_dir, small_batches, utf8
from .packing import block_keys, pack, shard_of, shards_for, squeeze, thick, thin, unpack, widen
from .words import LOWER, delimiters, find, hashes, mix

#: A phrase has to occur so often; words in a phrase; rows of a language.
LEAST, LONGEST, FIRST = 10, 3, 2000
#: Percent of a phrase's occurrences that a longer one holds where the shorter one is dropped.
INSIDE = 50
#: Bits of the table that orders words, and the base of its logarithms.
LEVEL_BITS, LEVEL_BASE = 24, 1.12
#: Ranges of a language from which the first rows are taken before they meet.
SPREAD = 64

_WORD = delimiters((0x20, 0x20), (0x09, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_BREAK = ~delimiters((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))


def _tokens(texts, langs):
    """Of all words: hash of language and word, whether it begins a piece, start and end; the folded bytes, and the index of each text's first word."""
    buf, offs = utf8(texts)
    starts, ends, first = find(buf, offs, _WORD)
    h = hashes(buf, starts, ends)
    names = [x if x is not None else "und" for x in langs.to_pylist()]
    salt = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(names)}
    h = mix(h ^ np.repeat(np.array([salt[x] for x in names], np.uint64), np.diff(first)), 31)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[buf])])
    begins = np.ones(len(h), bool)
    begins[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    begins[first[:-1][first[:-1] < len(h)]] = True
    return h, begins, starts, ends, LOWER[buf], first, names


_WORDS = "lang string, word string, h long, n long"


def _count_words(batches):
    """Columns lang, text: words of blocks with their counts, and for each language a row without a word for all of its occurrences."""
    import pyarrow as pa

    held: dict = {}
    size = 0

    def send():
        rows = [(lang, word, int(np.uint64(h).astype(np.int64)) if word is not None else 0, n) for (lang, word), (h, n) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "word", "h", "n"])

    for b in batches:
        h, _, starts, ends, low, first, names = _tokens(b.column(1), b.column(0))
        if not len(h):
            continue
        k, at, n = np.unique(h, return_index=True, return_counts=True)
        text = low.tobytes()
        of = np.searchsorted(first, at, "right") - 1
        for x, s, e, d, c in zip(k, starts[at].tolist(), ends[at].tolist(), of.tolist(), n.tolist(), strict=True):
            key = names[d], text[s:e].decode("utf-8", "replace")
            old = held.get(key)
            held[key] = (x, c + (old[1] if old else 0))
        for d, c in enumerate(np.diff(first).tolist()):
            held[names[d], None] = (0, c + held.get((names[d], None), (0, 0))[1])
        if len(held) >= _GATHER:
            yield send()
    if held:
        yield send()


#: Words that a task gathers before it sends their counts.
_GATHER = 400_000


def _level(n):
    return F.least(F.lit(255), 1 + F.floor(F.log(n.cast("double")) / float(np.log(LEVEL_BASE)))).cast("int")


#: Ranges in which the table of levels is made.
_RANGES = 256


def _range_levels(pdf):
    import pandas as pd

    out = np.zeros((1 << LEVEL_BITS) // _RANGES, np.uint8)
    out[pdf["at"].to_numpy() % len(out)] = pdf["level"].to_numpy()
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "levels": [out.tobytes()]})


def levels(words: DataFrame) -> np.ndarray:
    """The table of step 2; words: h, n."""
    width = (1 << LEVEL_BITS) // _RANGES
    cell = F.shiftrightunsigned("h", 64 - LEVEL_BITS)
    rows = words.groupBy(cell.alias("at")).agg(F.max(_level(F.col("n"))).alias("level")).withColumn("part", (F.col("at") / width).cast("int"))
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    for r in rows.groupBy("part").applyInPandas(_range_levels, "part int, levels binary").toLocalIterator():  # 2 ** LEVEL_BITS bytes in all
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out


def _around(h: np.ndarray, begins: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each word the indexes of up to two words on its left and right that belong to its fragment (-1 where none): columns 0, 1, 3, 4; itself in 2.

    A neighbour belongs to it if nothing between ends the fragment and it is not rarer than the pivot.
    """
    n = len(h)
    out = np.full((2 * LONGEST - 1, n), -1, np.int64)
    mid = LONGEST - 1
    pivot = np.arange(n)
    out[mid] = pivot
    for step in (-1, 1):
        goes = level > 0
        for j in range(1, LONGEST):
            at = pivot + step * j
            ok = goes & (at >= 0) & (at < n)
            at = np.where(ok, at, 0)
            ok &= ~begins[at if step > 0 else np.minimum(at + 1, n - 1)]
            ok &= (level[at] > level) | (level[at] == level) & (h[at] >= h)
            out[mid + step * j] = np.where(ok, at, -1)
            goes = ok
    return out


def _fragments(shards: int, table):
    """Columns lang, text: cells of a block's different fragments with their numbers, by shard of the pivot."""

    full = block_keys(shards)

    def run(batches):
        import pyarrow as pa

        level_of = table.value
        held: list[tuple] = []

        def cells(h, begins, level, lo, hi):
            """Of the pivots from lo to hi."""
            mid = LONGEST - 1
            near = _around(h, begins, level)[:, lo:hi]
            near = near[:, (near[mid - 1] >= 0) | (near[mid + 1] >= 0)]
            known, ids = np.unique(h, return_inverse=True)
            near = np.concatenate([ids + 1, [0]])[near]  # index -1: no word
            by = np.lexsort(near[[j for i in range(1, LONGEST) for j in (mid - i, mid + i)][::-1] + [mid]])
            near = near[:, by]
            new = np.ones(near.shape[1], bool)
            new[1:] = (near[:, 1:] != near[:, :-1]).any(axis=0)
            at = np.flatnonzero(new)
            near, number = near[:, at], np.diff(np.append(at, len(new)))
            where = shard_of(known, shards).astype(np.int64)[near[mid] - 1]
            cut = np.searchsorted(where, np.arange(shards + 1))
            out = []
            for s in np.flatnonzero(cut[1:] > cut[:-1]):
                own = near[:, cut[s] : cut[s + 1]]
                used, inside = np.unique(np.concatenate([[0], own.ravel()]), return_inverse=True)
                out.append((int(s), pack(len(used) - 1, *squeeze(known[used[1:] - 1]), *(thin(x) for x in inside[1:].reshape(own.shape)), thin(number[cut[s] : cut[s + 1]]))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["shard", "cell"])

        def send():
            h, begins, level = (np.concatenate([x[i] for x in held]) for i in range(3))
            held.clear()
            for lo in range(0, len(h), full):  # a part of a very long batch sees the words around it
                left, right = max(0, lo - LONGEST), min(len(h), lo + full + LONGEST)
                yield cells(h[left:right], begins[left:right], level[left:right], lo - left, min(len(h), lo + full) - left)

        for b in batches:
            h, begins, *_ = _tokens(b.column(1), b.column(0))
            held.append((h, begins, level_of[(h >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]))
            if sum(len(x[0]) for x in held) >= full:
                yield from send()
        if held:
            yield from send()

    return run


_PHRASES = "w1 long, w2 long, w3 long, a long"


def _mine(least: int):
    def run(pdf):
        """A shard's n-grams that its pivots own, with whole counts."""
        import pandas as pd

        parts = [unpack(c) for c in pdf["cell"]]
        words = [np.concatenate([np.zeros(1, np.uint64), widen(first, width, data, k)]) for k, first, width, data, *_ in parts]
        known, ids = np.unique(np.concatenate(words), return_inverse=True)
        shift = np.cumsum([0, *(len(w) for w in words[:-1])])
        span = 2 * LONGEST - 1
        near = [np.concatenate([ids[thick(p[4 + j]).astype(np.int64) + s] for p, s in zip(parts, shift, strict=True)]).astype(np.uint32) for j in range(span)]
        number = np.concatenate([thick(p[4 + span]).astype(np.int64) for p in parts])
        parts.clear()
        mid, out = LONGEST - 1, []
        for size in range(2, LONGEST + 1):
            keys, counts = [], []
            for lo in range(mid - size + 1, mid + 1):
                cols = near[lo : lo + size]
                ok = np.ones(len(number), bool)
                for j, x in enumerate(cols, lo):
                    ok &= x > 0
                    if j < mid:
                        ok &= x != near[mid]
                keys.append([x[ok] for x in cols])
                counts.append(number[ok])
            cols, n = [np.concatenate([k[j] for k in keys]) for j in range(size)], np.concatenate(counts)
            keys.clear()
            if not len(n):
                continue
            by = np.lexsort(cols[::-1])
            cols, n = [x[by] for x in cols], n[by]
            new = np.zeros(len(n), bool)
            new[0] = True
            for x in cols:
                new[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(new)
            a = np.add.reduceat(n, at)
            at, a = at[a >= least], a[a >= least]
            w = [known[x[at]].astype(np.int64) for x in cols]
            out.append(pd.DataFrame({"w1": w[0], "w2": w[1], "w3": pd.arrays.IntegerArray(w[2] if size > 2 else np.zeros(len(a), np.int64), np.full(len(a), size == 2)), "a": a}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.array([], "Int64") for c in ("w1", "w2", "w3", "a")})

    return run


def score(left: str, right: str):
    """Exact: floor(1000000 * a * a / (left * right)) of columns a, left, right."""
    squared = "cast(1000000 as decimal(7, 0)) * cast(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) as decimal(30, 0))"
    return F.expr(f"({squared}) div (cast({left} as decimal(18, 0)) * cast({right} as decimal(18, 0)))")


def phrases(docs: DataFrame, least: int = LEAST, inside: int = INSIDE) -> tuple[DataFrame, DataFrame]:
    """Written tables: lang, phrase, a, l, r, score of all phrases that stay; lang, n."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = own.mapInArrow(_count_words, _WORDS).groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))
    counted = keep(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = counted.where("word is null").select("lang", "n")
    words = counted.where("word is not null")
    table = spark.sparkContext.broadcast(levels(words.select("h", "n")))
    shards = shards_for(docs)
    found = keep(own.mapInArrow(_fragments(shards, table), "shard int, cell binary").groupBy("shard").applyInPandas(_mine(least), _PHRASES), "phrases")
    table.destroy()
    two = found.where("w3 is null").select("w1", "w2", "a")
    three = found.where("w3 is not null")
    count = lambda i: words.select(F.col("h").alias(f"w{i}"), F.col("n").alias(f"f{i}"), F.col("word").alias(f"t{i}"), *([F.col("lang")] if i == 1 else []))
    named = lambda df, n: df.select("*") if not n else named(df, n - 1).join(count(n), f"w{n}")
    pair = lambda x, y, name: two.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name))
    long = three.join(pair("w1", "w2", "f12"), ["w1", "w2"]).join(pair("w2", "w3", "f23"), ["w2", "w3"])
    long = keep(named(long, 3), "three")
    first, second = score("f1", "f23"), score("f12", "f3")
    long_rows = long.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.struct(first.alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")).alias("x"), F.struct(second.alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r")).alias("y"))
    long_rows = long_rows.select("lang", "phrase", "a", F.least("x", "y").alias("z")).select("lang", "phrase", "a", "z.l", "z.r", "z.score")
    longer = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("most"))
    short = two.join(longer, ["w1", "w2"], "left").where(f"most is null or cast(100 as decimal(20, 0)) * most < {int(inside)} * cast(a as decimal(20, 0))").drop("most")
    short_rows = named(short, 2).select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    return keep(short_rows.unionByName(long_rows), "scored"), totals


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language."""
    rows, totals = phrases(docs, least, inside)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_collocations": op13}
SQL: dict[str, str] = {}
