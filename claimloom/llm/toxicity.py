"""Toxicity: two Kneser-Ney models, one of toxic and one of ordinary labelled texts, and the length-normalised ratio of their likelihoods.

The unit of the models is a byte of the folded text: A-Z lower-cased, runs of ASCII that is neither digit nor letter as one blank, START and END
around it. So a word that was never seen is still known by its parts. An n-gram counts once for each text that has it, and equal texts of a
class count once, so neither a repeated line nor a large group of copies makes an expression typical of a class.

Each class has an interpolated modified Kneser-Ney model of ORDER bytes: discounts and continuation counts of its own at every order,
and at the end the continuation counts of both classes together, so what one class never had is smoothed by counts that both share.
The log ratio of the two, log p_toxic(b | context) - log p_ordinary(b | context), is a sum with one term for each n-gram that ends at b and is
known: what the n-gram adds over its suffix, and, as a context, what the two models leave to lower orders. So a text's log ratio is a sum
of weights of its n-grams, and that sum by the number of its bytes (END counts) is what is compared.

1. Counting. Tasks gather the n-grams of highest order of labelled texts with their numbers of texts by class; all lower orders, contexts,
   discounts and weights are DataFrame aggregations and joins (an n-gram has at most 256 extensions on either side, so no key is hot).
2. Scoring, one pass over all documents. The HEAD most frequent n-grams with their weights (an exact cache) and a filter of FILTER_BITS bits
   over all others are broadcast: fixed sizes. What the filter passes is joined with the table of weights.
3. Calibration. A fifth of the labelled texts (by a hash of the text, so copies stay together) is not counted but used to fit a logistic curve
   from the ratio to a probability, on a histogram of BINS classes. Without texts of both kinds there, all labelled texts are used.

Edge cases: null counts as empty; an empty text is its END and is scored; a null or repeated doc_id gives a row for each row, held_out is false for
a null id; null labels are no labels, the greatest of several counts; without labels of both classes all scores are the share of toxic
labels (0.5 without any label); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, keep, shared_dir, small_batches, union, utf8
from .words import ALNUM, LOWER, mix

#: Bytes of an n-gram of highest order (5 at most: an n-gram and its order are one 64-bit number).
ORDER = 5
#: N-grams that are broadcast with their weights, and bits of the filter of all others.
HEAD, FILTER_BITS = 1 << 20, 25
#: Labels that are broadcast; beyond that texts and labels are joined with a shuffle.
IDS = 1 << 20
#: Classes of the histogram of ratios.
BINS = 4096
#: One labelled text in so many is kept for calibration.
TUNE = 5
#: Bytes taken at once, and n-grams that a task gathers before it sends their counts.
_SLICE, _GATHER = 1 << 19, 1 << 20
_END = 1

_FOLD = np.where(ALNUM, LOWER, 32).astype(np.uint8)


def _framed(column, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts one after the other, each with order - 1 START (0) before it and END after it, and where each begins (n + 1 values)."""
    buf, offs = utf8(column)
    b = _FOLD[buf]
    blank = b == 32
    stays = np.ones(len(b), bool)
    stays[1:] = ~(blank[1:] & blank[:-1])
    at = offs[:-1][offs[:-1] < offs[1:]]
    stays[at] = True
    count = np.concatenate([[0], np.cumsum(stays)])
    n = np.diff(count[offs])
    begin = np.concatenate([[0], np.cumsum(n + order)])
    out = np.zeros(begin[-1], np.uint8)
    place = np.arange(count[-1]) + np.repeat(np.arange(len(n)) * order + order - 1, n)
    out[place] = b[stays]
    out[begin[1:] - 1] = _END
    return out, begin


def _slices(framed: np.ndarray, begin: np.ndarray, order: int):
    """N-grams of all texts in sorted runs: (n-gram << 20 | text) and the number of the slice's first text."""
    n = len(framed)
    for lo in range(order - 1, n, _SLICE):
        hi = min(n, lo + _SLICE)
        g = np.zeros(hi - lo, np.uint64)
        for j in range(order - 1, -1, -1):
            g = g << np.uint64(8) | framed[lo - j : hi - j]
        doc = np.searchsorted(begin, np.arange(lo, hi), "right") - 1
        inside = np.arange(lo, hi) - begin[doc] >= order - 1
        first = int(doc[0])
        yield np.sort(g[inside] << np.uint64(20) | (doc[inside] - first).astype(np.uint64)), first


def _counting(order: int):
    """Columns toxic, text: n-grams of highest order with the number of texts of each class that have them."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def send():
            g = np.concatenate([x[0] for x in held])
            by = np.argsort(g, kind="stable")
            g = g[by]
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            cols = [np.add.reduceat(np.concatenate([x[i] for x in held])[by], at) for i in (1, 2)]
            held[:] = [(g[at], *cols)]

        def out():
            g, o, t = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(o), pa.array(t)], ["g", "o", "t"])

        for b in batches:
            toxic = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            framed, begin = _framed(b.column(1), order)
            last, before = -1, np.empty(0, np.uint64)  # the n-grams so far of the text that goes on in the next slice
            for packed, first in _slices(framed, begin, order):
                packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
                g, doc = packed >> np.uint64(20), (packed & np.uint64((1 << 20) - 1)).astype(np.int64) + first
                if not len(g):
                    continue
                if first == last and len(before):
                    new = ~((doc == first) & np.isin(g, before))
                else:
                    new = np.ones(len(g), bool)
                end = int(doc.max())
                more = g[doc == end]
                before = np.union1d(before, more) if end == last else more
                last = end
                g, of = g[new], toxic[doc[new]]
                if not len(g):
                    continue
                at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                t = np.add.reduceat(of, at)
                held.append((g[at], np.diff(np.append(at, len(g))) - t, t))
                if sum(len(x[0]) for x in held) >= _GATHER:
                    send()
                    if len(held[0][0]) >= _GATHER // 2:
                        yield out()
        if held:
            send()
            yield out()

    return run


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h, i (hashes of the text), times (the most rows with one id and this text), toxic, tune of one row for each different text of a class among the rows
    with a label that may be learned from."""
    by = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    by = keep(by.where(~_held_out()), "toxic-labels")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("2"), text).alias("i"))
    own = own.join(F.broadcast(by) if by.count() <= IDS else by, "doc_id").groupBy("doc_id", "h", "i", "toxic").agg(F.count("*").alias("times"))
    one = own.groupBy("h", "i", "toxic").agg(F.min("doc_id").alias("doc_id"), F.max("times").alias("times"))
    return one.select("doc_id", "h", "i", "times", "toxic", (F.pmod("h", F.lit(TUNE)) == 0).alias("tune"))


def _texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """toxic, text of labelled(), each once though rows may repeat."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("2"), text).alias("i"), text.alias("text"))
    on = ["doc_id", "h", "i"]
    rows = own.join(F.broadcast(known) if known.count() <= IDS else known, on)
    if not known.where("times > 1").isEmpty():
        rows = rows.dropDuplicates([*on, "toxic"])
    return rows.select("toxic", "text")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _discounts(n: list) -> list[float]:
    """The three discounts of modified Kneser-Ney from how often the counts 1 to 4 are there."""
    n = [float(x or 0) for x in n]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    d = [j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] else j / 2 for j in (1, 2, 3)]
    return [min(max(x, 0.05), j - 0.05) for j, x in zip((1, 2, 3), d, strict=True)]


def weights(counts: DataFrame, order: int) -> tuple[list[DataFrame], float, float]:
    """Tables (key, w, n) of the weights of each order's n-grams, what every byte adds, and what every text adds (its contexts of START alone).

    counts: g, o, t of the highest order."""
    grams = {order: counts}
    for n in range(order - 1, 0, -1):
        up = grams[n + 1]
        grams[n] = keep(up.groupBy(F.col("g").bitwiseAND((1 << 8 * n) - 1).alias("g")).agg(F.sum((F.col("o") > 0).cast("long")).alias("o"), F.sum((F.col("t") > 0).cast("long")).alias("t")), f"grams-{n}")
    contexts, discount = {}, {}
    for n in range(1, order + 1):
        of = grams[n].agg(*(F.sum((F.col(c) == j).cast("long")) for c in "ot" for j in (1, 2, 3, 4))).first()
        discount[n] = {"o": _discounts(of[:4]), "t": _discounts(of[4:])}
        sums = [F.sum(c).alias(f"all_{c}") for c in "ot"] + [F.sum(_taken(c, discount[n])).alias(f"gone_{c}") for c in "ot"]
        contexts[n] = keep(grams[n].groupBy(F.shiftright("g", 8).alias("context")).agg(*sums), f"contexts-{n}")
    both = grams[2] if order > 1 else grams[1]
    shared = both.groupBy(F.col("g").bitwiseAND(255).alias("g")).agg(F.count("*").alias("c"))
    total = shared.agg(F.sum("c")).first()[0] or 1
    chances = shared.select("g", ((F.col("c") - 0.5) / total + F.count("*").over(_all()) * 0.5 / total / 256).alias("t_low")).withColumn("o_low", F.col("t_low"))
    tables, every, start = [], 0.0, 0.0
    for n in range(1, order + 1):
        rows = grams[n].withColumn("context", F.shiftright("g", 8)).join(contexts[n], "context")
        rows = rows.join(chances.withColumnRenamed("g", "suffix"), F.col("g").bitwiseAND((1 << 8 * (n - 1)) - 1 if n > 1 else 255) == F.col("suffix"))
        left = {c: _left(c) for c in "ot"}
        p = {c: F.when(F.col(f"all_{c}") > 0, (F.col(c) - _taken(c, discount[n])) / F.col(f"all_{c}")).otherwise(0.0) + left[c] * F.col(f"{c}_low") for c in "ot"}
        rows = rows.select("g", (F.col("o") + F.col("t")).alias("n"), p["o"].alias("p_o"), p["t"].alias("p_t"), (F.log(p["t"]) - F.log(p["o"]) - F.log("t_low") + F.log("o_low") - F.log(left["t"]) + F.log(left["o"])).alias("w"))
        rows = keep(rows, f"chances-{n}")
        chances = rows.select("g", F.col("p_t").alias("t_low"), F.col("p_o").alias("o_low"))
        row = contexts[n].where("context = 0").select(F.log(left["t"]) - F.log(left["o"])).first()
        adds = float(row[0]) if row else 0.0
        every, start = (adds, start) if n == 1 else (every, start + adds)
        w = F.col("w")
        if n < order:
            rows = rows.join(contexts[n + 1].select(F.col("context").alias("g"), (F.log(left["t"]) - F.log(left["o"])).alias("as_context")), "g", "left")
            w = w + F.coalesce("as_context", F.lit(0.0))
        tables.append(rows.select((F.col("g") + (n << 40)).alias("key"), w.alias("w"), "n"))
    return tables, every, start


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over 256 bytes at most


def _taken(c: str, d: dict):
    return F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[c][0]).when(F.col(c) == 2, d[c][1]).otherwise(d[c][2])


def _left(c: str):
    """What a context leaves to lower orders; all, where the class never had it."""
    return F.when(F.col(f"all_{c}") > 0, F.col(f"gone_{c}") / F.col(f"all_{c}")).otherwise(1.0)


class Model:
    """What is broadcast: the head, the filter of all other n-grams, what every byte and every text adds."""

    def __init__(self, order: int, every: float, start: float, keys: np.ndarray, w: np.ndarray, bits: np.ndarray | None):
        by = np.argsort(keys)
        self.order, self.every, self.start, self.keys, self.w, self.bits = order, every, start, keys[by], w[by], bits

    def values(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The known weights of distinct n-grams of highest order and all their suffixes, and for each order which of them the filter passes."""
        total, rest = np.zeros(len(g)), []
        for n in range(1, self.order + 1):
            k = (g & np.uint64((1 << 8 * n) - 1)) + np.uint64(n << 40)
            i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            there = self.keys[i] == k
            total += np.where(there, self.w[i], 0)
            rest.append(~there & self.bits[_bit(k)] if self.bits is not None else np.zeros(0, bool))
        return total, rest


def _bit(k: np.ndarray) -> np.ndarray:
    return (mix(k, 21) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(batches):
    """Bits of the filter, of a range of n-grams each."""
    import pyarrow as pa

    at = [_bit(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) for b in batches]
    if at:
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[np.concatenate(at)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def model(docs: DataFrame, labels: DataFrame, order: int = ORDER, head: int = HEAD) -> tuple[Model | None, DataFrame | None, DataFrame]:
    """The broadcast part, the table of weights that are not in it (None if all are), and the labelled texts."""
    small_batches(docs.sparkSession)
    known = keep(labelled(docs, labels), "labelled")
    kinds = {(r["toxic"] > 0, r["tune"]) for r in known.select("toxic", "tune").distinct().collect()}
    if not {True, False} <= {x for x, _ in kinds}:
        return None, None, known
    if len({x for x, tune in kinds if not tune}) < 2:
        known = keep(known.withColumn("tune", F.lit(None).cast("boolean")), "labelled")
    fit = known.where("tune is null or not tune").select("doc_id", "h", "i", "times", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counted = _texts(docs, fit).mapInArrow(_counting(order), "g long, o long, t long")
    counts = keep(counted.groupBy("g").agg(F.sum("o").alias("o"), F.sum("t").alias("t")), f"grams-{order}")
    tables, every, start = weights(counts, order)
    table = keep(union(tables), "weights")
    if table.count() <= head:
        rest, bits, top = None, None, table
    else:
        limit = table.agg(F.percentile_approx("n", 1 - head / table.count(), 100000)).first()[0]
        top, rest = table.where(F.col("n") > limit).orderBy(F.desc("n")).limit(head), table
        bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for row in table.select("key").coalesce(32).mapInArrow(_filter, "bits binary").toLocalIterator():
            bits |= np.frombuffer(row["bits"], np.uint8)
        bits = np.unpackbits(bits).astype(bool)
    top = top.select("key", "w").toPandas()
    return Model(order, every, start, top["key"].to_numpy().astype(np.uint64), top["w"].to_numpy(), bits), rest, known


_SCORED = "uid long, doc_id long, n long, sum double, rest array<struct<key:long,n:long>>"


def _scoring(model):
    """Columns doc_id, text: a row for each with the sum of the known weights, and the n-grams that the table has to be asked for."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        m: Model = model.value
        seq, part = 0, TaskContext.get().partitionId()
        for b in batches:
            framed, begin = _framed(b.column(1), m.order)
            n = np.diff(begin) - m.order + 1
            total = n * m.every + m.start
            asked: list[tuple] = []
            for packed, first in _slices(framed, begin, m.order):
                g, doc = packed >> np.uint64(20), (packed & np.uint64((1 << 20) - 1)).astype(np.int64) + first
                at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, int)
                w, rest = m.values(g[at])
                size = np.diff(np.append(at, len(g)))
                total += np.bincount(doc, np.repeat(w, size), minlength=len(b))
                for j, some in enumerate(rest, 1):
                    if some.any():
                        hit = np.repeat(some, size)
                        asked.append((doc[hit], (g[hit] & np.uint64((1 << 8 * j) - 1)) + np.uint64(j << 40)))
            rest_of: list = [None] * len(b)
            if asked:
                doc, k = (np.concatenate([x[i] for x in asked]) for i in (0, 1))
                by = np.lexsort((k, doc))
                doc, k = doc[by], k[by]
                at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])]))
                for d, key, count in zip(doc[at].tolist(), k[at].tolist(), np.diff(np.append(at, len(k))).tolist(), strict=True):
                    rest_of[d] = rest_of[d] or []
                    rest_of[d].append({"key": key, "n": count})
            uid = (np.int64(part) << np.int64(33)) + np.arange(seq, seq + len(b))
            seq += len(b)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip((uid, b.column(0), n, total, rest_of), kinds, strict=True)], ["uid", "doc_id", "n", "sum", "rest"])

    return run


def ratios(docs: DataFrame, made: Model, rest: DataFrame | None) -> DataFrame:
    """uid, doc_id, ratio (mean log ratio of a byte) for each row of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(made)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keep(own.mapInArrow(_scoring(sent), _SCORED), "toxic-scores", batch=BATCH_ROWS)
    sent.destroy()
    if rest is None:
        return rows.select("uid", "doc_id", (F.col("sum") / F.col("n")).alias("ratio"))
    asked = rows.select("uid", F.explode("rest").alias("x")).select("uid", "x.key", F.col("x.n").alias("times"))
    more = asked.join(rest.select("key", "w"), "key").groupBy("uid").agg(F.sum(F.col("w") * F.col("times")).alias("more"))
    return keep(rows.join(more, "uid", "left").select("uid", "doc_id", ((F.col("sum") + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("ratio")), "toxic-ratios")


def _curve(bins: list, width: float, low: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (class, toxic, number) rows, by Newton's method with a weak pull of the slope."""
    x = np.array([low + (r[0] + 0.5) * width for r in bins])
    y, n = np.array([float(r[1]) for r in bins]), np.array([float(r[2]) for r in bins])
    mid, scale = np.average(x, weights=n), max(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)), 1e-9)
    z, beta = np.stack([(x - mid) / scale, np.ones(len(x))]), np.zeros(2)
    pull = np.array([0.05, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ z, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))) @ z.T + np.diag(pull), z @ (n * (y - p)) - pull * beta)
        beta = beta + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return beta[0] / scale, beta[1] - beta[0] * mid / scale


#: Ratios are held to this range for the histogram.
_RANGE = 1.0


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, ratio, score, predicted for each row of docs."""
    shared_dir(docs.sparkSession)
    made, rest, known = model(docs, labels, order, head)
    held = _held_out().alias("held_out")
    if made is None:
        share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
        flat = F.lit(0.5 if share is None else float(share))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.lit(0.0).alias("ratio"), flat.alias("score"), (flat >= 0.5).cast("int").alias("predicted"))
    rows = ratios(docs, made, rest)
    tune = known.where("tune is null or tune").select("doc_id", F.col("toxic").alias("y"))
    if tune.agg(F.count_distinct("y")).first()[0] < 2:
        tune = known.select("doc_id", F.col("toxic").alias("y"))
    width = 2 * _RANGE / BINS
    at = F.least(F.greatest(F.floor((F.col("ratio") + _RANGE) / width), F.lit(0)), F.lit(BINS - 1))
    ids = keep(tune, "tune")
    bins = rows.join(F.broadcast(ids) if ids.count() <= IDS else ids, "doc_id").groupBy(at.alias("at"), "y").count().collect()  # 2 * BINS at most
    a, b = _curve([(r["at"], r["y"] > 0, r["count"]) for r in bins], width, -_RANGE)
    p = 1 / (1 + F.exp(-(a * F.least(F.greatest(F.col("ratio"), F.lit(-_RANGE)), F.lit(_RANGE)) + b)))
    return rows.select("doc_id", held, "ratio", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_toxicity": op11}
SQL: dict[str, str] = {}
