"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and their components.

Multiple-global-order filtering. Under any one order of all shingles, two sets that are similar enough share a shingle among the first
n - ceil(0.8 n) + 1 of each (n: the set's size). Three global orders are used; all begin with the rarest shingles, the first by the exact count,
the others by its magnitude with hashes of their own between. Candidates share a prefix shingle under the first order; they must share enough
of them under each of the three; what all filters leave is verified on the whole sets.

1. Counting. Every text's shingles are counted by a sharded join: a task gathers blocks of documents, sends each shard the shingles that it owns
   (one that several documents of the block have only once, with its count) and gets back those that occur anywhere else, with their counts.
   A shingle that only one set has can make no link, so all that follows works on the shared ones: a set is its size and its shared shingles.
   Texts are read once and never shuffled.
2. Equal sets are tied to one of them, which stands for all: within a task at once, over tasks by a digest of the set.
3. Only components are asked for, so no link between sets that are known to be connected is made again, and no group is expanded into all its
   pairs: every set is compared with the set that has the largest share of shared shingles among those of its prefix shingles' (a hub: the
   original of a group of near copies), links are contracted to components, then once more with all hubs of prefix shingles whose sets still lie
   in several components.
4. What then shares a prefix shingle across components is compared pair by pair. So every candidate pair has been verified or lies within one
   component, and the components are exact.

Edge cases: null or empty text, or text without words, has an empty set and no links; with fewer than five words the whole sequence is the
only shingle; rows with equal doc_id count as one node of the graph, each with its own set size; a null doc_id is returned with itself
(null) as component and no links; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep, shared_dir
from .graph import components, merged
from .packing import BLOCK_DOCS, block_keys, cuts, pack, shards_for, squeeze, unpack, widen
from .words import SPACED, inner, mix, text_words, windows

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NEAR, OF = 4, 5


def shingle_sets(column) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, first = text_words(column, SPACED)
    at, sh = inner(first, WORDS), windows(h, WORDS)
    sh = sh[at]
    cut = np.searchsorted(at, first)
    out = []
    for i in range(len(first) - 1):
        n = first[i + 1] - first[i]
        if n >= WORDS:
            out.append(np.unique(sh[cut[i] : cut[i + 1]]))
        elif n:
            out.append(windows(np.append(h[first[i] : first[i + 1]], np.full(WORDS, n, np.uint64)), int(n) + WORDS))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    return n - -(-NEAR * n // OF) + 1 if n else 0


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.asarray([s.sum(), mix(s, 3).sum()], np.uint64).tobytes()


_CELL = "block long, shard int, own binary, cell binary"


def _asked(shards: int):
    """Rows (doc_id, text) to cells of shingles by block and shard, and for each block one cell of its own, which passes through a shard."""
    full = block_keys(shards)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, size = TaskContext.get().partitionId(), 0, 0
        stands: dict[bytes, int] = {}
        rows: list[tuple] = []  # id, set size, the id that stands for it, digest, whether it is the one that stands
        sets: list[np.ndarray] = []
        of: list[int] = []

        def send():
            nonlocal seq, size
            block = (part << 32) | seq
            t = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            doc = np.repeat(np.array(of, np.uint16), [len(s) for s in sets]) if sets else np.empty(0, np.uint16)
            by = np.argsort(t)
            t, doc = t[by], doc[by]
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
            n = np.diff(np.append(at, len(t)))
            one, some = at[n == 1], at[n > 1]
            single, several, count = t[one], t[some], n[n > 1].astype(np.uint32)
            c1, c2 = cuts(single, shards), cuts(several, shards)
            out = [(block, s, None, pack(c1[s + 1] - c1[s], *squeeze(single[c1[s] : c1[s + 1]]), doc[one][c1[s] : c1[s + 1]], several[c2[s] : c2[s + 1]], count[c2[s] : c2[s + 1]])) for s in range(shards) if c1[s] < c1[s + 1] or c2[s] < c2[s + 1]]
            inside = np.repeat(n > 1, n)
            out.append((block, block % shards, pack(list(rows), several, count, doc[inside]), None))
            seq, size = seq + 1, 0
            rows.clear()
            sets.clear()
            of.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "shard", "own", "cell"])

        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                key = _digest(s)
                first = i is not None and len(s) > 0 and key not in stands
                one = None if i is None or not len(s) else stands.setdefault(key, i)
                if first:
                    of.append(len(rows))
                    sets.append(s)
                    size += len(s)
                rows.append((i, len(s), one, key, first))
                if size >= full or len(rows) >= BLOCK_DOCS:
                    yield send()
        if rows:
            yield send()

    return run


def _answered(pdf):
    """A shard's cells: for each block the shingles that occur more than once in all, with their counts. Blocks' own cells are passed on."""
    import pandas as pd

    cells = [(block, unpack(c)) for block, c in zip(pdf["block"], pdf["cell"], strict=True) if c is not None]
    out = [(block, own, None) for block, own in zip(pdf["block"], pdf["own"], strict=True) if own is not None]
    shard = int(pdf["shard"].iloc[0])
    if cells:
        singles = [widen(first, width, data, n) for _, (n, first, width, data, *_) in cells]
        keys = np.concatenate([*singles, *(c[5] for _, c in cells)])
        weight = np.concatenate([np.ones(sum(map(len, singles)), np.int64), *(c[6] for _, c in cells)])
        by = np.argsort(keys)
        keys, weight = keys[by], weight[by]
        run = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
        total = np.empty(len(by), np.int64)
        total[by] = np.bincount(run, weight).astype(np.int64)[run]
        at, end = 0, sum(map(len, singles))
        for (block, c), t in zip(cells, singles, strict=True):
            n = total[at : at + len(t)]
            again = n > 1
            several = total[end : end + len(c[5])]
            at, end = at + len(t), end + len(c[5])
            if again.any() or len(several):
                t = t[again]
                out.append((block, None, pack(shard, len(t), *squeeze(t), c[4][again], n[again].astype(np.uint32), several.astype(np.uint32))))
    return pd.DataFrame(out, columns=["block", "own", "found"])


_SET = "doc_id long, n long, stands long, d1 long, d2 long, t array<long>, c array<long>"


def _collected(pdf):
    """A block's own cell and its answers: each document's shared shingles, sorted, and their counts (null where another one stands for it)."""
    import pandas as pd

    rows, several, times, inside = unpack(next(x for x in pdf["own"] if x is not None))
    found = sorted((unpack(x) for x in pdf["found"] if x is not None), key=lambda x: x[0])
    t = [widen(first, width, data, n) for _, n, first, width, data, *_ in found]
    doc, count = [x[5] for x in found], [x[6] for x in found]
    if len(several):
        local = np.concatenate([x[7] for x in found])  # in the order of shards, which is that of the shingles
        t, doc, count = [*t, np.repeat(several, times)], [*doc, inside], [*count, np.repeat(local, times)]
    t, doc, count = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((t, np.uint64), (doc, np.uint16), (count, np.uint32)))
    by = np.lexsort((t, doc))
    t, doc, count = t[by].view(np.int64), doc[by], count[by].astype(np.int64)
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    d = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(-1, 2)
    return pd.DataFrame(
        {
            "doc_id": pd.array([r[0] for r in rows], "Int64"), "n": [r[1] for r in rows], "stands": pd.array([r[2] for r in rows], "Int64"), "d1": d[:, 0], "d2": d[:, 1],
            "t": [t[cut[i] : cut[i + 1]] if r[4] else None for i, r in enumerate(rows)], "c": [count[cut[i] : cut[i + 1]] if r[4] else None for i, r in enumerate(rows)],
        }
    )


def _ordered(batches):
    """Rows (doc_id, n, d1, d2, t, c): the shared shingles in the prefix under each order, for the sets that have any."""
    import pyarrow as pa

    for b in batches:
        ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
        shingles, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in (b.column(4), b.column(5)))
        lengths = np.diff(np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in b.column(4)])]))
        out, end = [], 0
        for i, (n, k) in enumerate(zip(sizes, lengths, strict=True)):
            t, c = shingles[end : end + k], counts[end : end + k]
            end += k
            take = prefix_size(n) - (n - k)  # the n - k unshared ones come first under every order
            if take > 0 and k:
                u, big = t.view(np.uint64), np.frexp(c.astype(np.float64))[1]
                orders = (np.lexsort((u, c)), np.lexsort((mix(u, 41), big)), np.lexsort((mix(u, 42), big)))
                out.append((i, int(k), *(t[o[:take]] for o in orders)))
        pick = [r[0] for r in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for i in pick], pa.int64()) for x in (ids, sizes, b.column(2).to_pylist(), b.column(3).to_pylist())] + [pa.array([r[1] for r in out], pa.int64())] + [pa.array([r[j] for r in out], pa.list_(pa.int64())) for j in (2, 3, 4)],
            ["doc_id", "n", "d1", "d2", "k", "p1", "p2", "p3"],
        )


def shared_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), stands (the id of an equal set that stands for it within a task), a digest, t and c: shared shingles and their counts."""
    spark = docs.sparkSession
    shards = shards_for(docs)
    asked = docs.mapInArrow(_asked(shards), _CELL)
    answered = asked.groupBy("shard").applyInPandas(_answered, "block long, own binary, found binary")
    return keep(answered.groupBy("block").applyInPandas(_collected, _SET), "sets")


def _reach(nx: str, ny: str) -> str:
    return f"least({nx}, {ny}) * {OF} >= greatest({nx}, {ny}) * {NEAR}"


def _enough(nx: str, ny: str, both: str) -> str:
    """Whether an intersection of that size is large enough."""
    return f"{NEAR + OF} * ({both}) >= {NEAR} * ({nx} + {ny})"


def _verified(pairs: DataFrame, heads: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The links among candidate pairs (a, b): those that pass the three orders' filters, and of these the similar ones."""
    h = {s: heads.select(F.col("doc_id").alias(s), *(F.col(c).alias(c + s) for c in ("n", "p1", "p2", "p3"))) for s in "ab"}
    # what two sets share up to the lesser of their prefixes' ends is in both prefixes; beyond it lie at most as many as the greater has left
    rest = f"ceil({NEAR} * greatest(na, nb) / {OF}) - 1"
    filtered = pairs.join(h["b"], "b").join(h["a"], "a").where(_reach("na", "nb"))
    for k in (1, 2, 3):
        both = f"size(array_intersect(p{k}a, p{k}b))"
        filtered = filtered.where(f"{both} > 0 and {_enough('na', 'nb', f'{both} + {rest}')}")
    filtered = keep(filtered.select("a", "b").distinct(), name + "-filtered")
    s = {x: sets.where("t is not null").select(F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("t").alias("t" + x)) for x in "ab"}
    links = filtered.join(s["b"], "b").join(s["a"], "a").where(_enough("na", "nb", "size(array_intersect(ta, tb))"))
    links = keep(links.select("a", "b").distinct(), name)
    forget(filtered)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = shared_sets(docs)
    key = ["d1", "d2", "n"]
    equal = keep(sets.where("stands is not null").groupBy(*key).agg(F.min("stands").alias("one"), F.count_distinct("stands").alias("tasks")).where("tasks > 1").drop("tasks"), "equal")
    tied = keep(sets.where("t is not null").select("doc_id", *key).join(equal, key).where("doc_id <> one"), "tied")
    links = sets.where("doc_id <> stands").select(F.col("stands").alias("a"), F.col("doc_id").alias("b")).unionByName(tied.select(F.col("one").alias("a"), F.col("doc_id").alias("b")))
    heads = sets.where("t is not null").select("doc_id", "n", "d1", "d2", "t", "c").mapInArrow(_ordered, "doc_id long, n long, d1 long, d2 long, k long, p1 array<long>, p2 array<long>, p3 array<long>")
    heads = keep(heads.join(tied.select("doc_id", *key), ["doc_id", *key], "left_anti").drop("d1", "d2"), "heads")
    # of a set: its place in the order of hubs (by the share of shared shingles); of a shingle: how many of the set's shared ones come before it
    rank = F.struct(F.round(1 - F.col("k") / F.col("n"), 6).alias("alone"), "doc_id")
    posted = heads.select("doc_id", "n", "k", rank.alias("rank"), F.posexplode("p1").alias("before", "t"))
    hubs = keep(posted.groupBy("t").agg(F.min(F.struct("rank", "n", "k", "before")).alias("h"), F.count("*").alias("sets")).where("sets > 1").select("t", "h.*"), "hubs")
    hub = hubs.select("t", F.col("rank.doc_id").alias("hub"), F.col("rank").alias("hub_rank"), F.col("n").alias("hn"), F.col("k").alias("hk"), F.col("before").alias("hbefore"))
    # if nothing before a shared shingle is shared, two sets share at most what the lesser of them has from there on
    fits = lambda x, y: f"{_reach('n' + x, 'n' + y)} and {_enough('n' + x, 'n' + y, f'least(k{x} - before{x}, k{y} - before{y})')}"
    near = posted.drop("rank").join(hub, "t").where("doc_id <> hub").withColumnsRenamed({"hn": "nh", "hk": "kh", "hbefore": "beforeh"}).where(fits("", "h"))
    best = keep(near.groupBy("doc_id").agg(F.min("hub_rank").alias("r")).select(F.col("r.doc_id").alias("a"), F.col("doc_id").alias("b")), "best")
    nearest = _verified(best, heads, sets, "nearest")
    links = keep(links.unionByName(nearest), "links")
    group = keep(components(links, "a", "b"), "components")

    def lying(rows: DataFrame, group: DataFrame) -> DataFrame:
        return rows.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")

    apart = lying(near.select("doc_id", "hub").distinct(), group).join(group.select(F.col("node").alias("hub"), F.col("component").alias("hc")), "hub", "left").where("c <> coalesce(hc, hub)")
    apart = keep(apart.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).join(best, ["a", "b"], "left_anti"), "apart")
    further = _verified(apart, heads, sets, "further")
    first, group = group, merged(group, further, "components")
    forget(first)

    known = lying(posted.select("t", "doc_id", "n", "k", "before"), group)
    several = keep(known.groupBy("t").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("t"), "several")
    open_ = keep(known.join(several, "t"), "open")
    x, y = (open_.select("t", *(F.col(c).alias(c + s) for c in ("doc_id", "n", "k", "before", "c"))) for s in "xy")
    across = x.join(y, "t").where("doc_idx < doc_idy and cx <> cy").where(fits("x", "y"))
    across = keep(across.select(F.col("doc_idx").alias("a"), F.col("doc_idy").alias("b")).distinct(), "across")
    last = _verified(across, heads, sets, "last")
    own = keep(sets.select("doc_id", F.col("n").alias("n_shingles")), "own")
    forget(sets, heads, equal, tied, hubs, best, apart, several, open_, across)
    if not last.isEmpty():
        group = merged(group, last, "components")
    forget(links, nearest, further, last)
    return own.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_ngram_jaccard_join": op2}
SQL: dict[str, str] = {}
