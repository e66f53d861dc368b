"""The place of quotes on their pages: as they stand, folded, or nearly so.

Folding and its offsets. A page meets its quotes in the row of the page, and only if one of them does not stand on it as it is the page is folded: fixed
replacements, small letters, one space for white space, each character by a table. The running sum of how many characters each of the page's becomes leads
places in the folded text back. So a page costs its length and a quote one look, whatever the number of quotes; no pattern is made from a quote.

Nearly so. A stretch of a page is as alike as FUZZY_MIN only if it shares many runs of GRAM characters with the quote, at nearly the same places (see
`needed`). So where a page meets its quotes its runs are sorted by their characters, each quote's runs are looked up among them, hits are counted for each
stretch whose place fits, and only stretches with enough of them are compared character by character. Postings stay within the row of their page:
what is shuffled is pages and quotes. No page is scanned for each of its quotes, and a page that holds all its quotes as they are is not folded.
"""

from __future__ import annotations

import difflib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from claimloom.functions.base import strip

FUZZY_MIN, MIN_QUOTE = 0.90, 12
CONFIDENCE = {"exact": 1.0, "normalized": 0.97, "fuzzy": 0.75, "failed": 0.0}
#: What folding replaces, character by character.
FOLDS = {"\u00ad": "", "ﬁ": "fi", "ﬂ": "fl", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " "}
#: White space, Java's and the separators that only Python counts.
BLANK = "\\t-\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: What a character becomes when folded, if it becomes one, and how many; no letter beyond has a small one. Of those that become two, the second. The small
#: letter at the end of a Greek word is as any other, since it depends on what follows, which a quote may not have.
_FOLDED = np.arange(0x1F000, dtype=np.uint32)
_WIDTH = np.ones(len(_FOLDED), np.int8)
_SECOND = {}
for _i, _c in enumerate(map(chr, _FOLDED.tolist())):
    _by = " " if re.match(f"[{BLANK}]", _c) else "σ" if _c == "ς" else FOLDS.get(_c, _c if 0xD800 <= _i < 0xE000 else _c.lower())
    _FOLDED[_i], _WIDTH[_i] = ord(_by[:1] or " "), len(_by)
    if len(_by) == 2:
        _SECOND[_i] = ord(_by[1])
#: Characters of a run.
GRAM = 3
#: Quotes of one page that travel with one copy of it.
TOGETHER = 256
#: Hits that are held at once.
HITS = 1 << 20
GROUND = StructType().add("match_type", "string").add("char_start", "integer").add("char_end", "integer").add("confidence", "double").add("located_text", "string")


def folded(text: str) -> tuple[str, np.ndarray]:
    """Fixed replacements, small letters, one space for each run of white space, whatever soft hyphens lie in it; and how long the folded text is after each
    character. A run of blanks stands where its first one does."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    known = np.minimum(c, len(_FOLDED) - 1)
    width, out = _WIDTH[known], np.where(c < len(_FOLDED), _FOLDED[known], c)
    seen = np.flatnonzero(width)
    blank = out[seen] == 32
    width[seen[1:][blank[1:] & blank[:-1]]] = 0
    ends, two = np.cumsum(width, dtype=np.int64), np.flatnonzero(width == 2)
    out = np.repeat(out, width)
    out[ends[two] - 1] = [_SECOND[x] for x in c[two].tolist()]
    return out.tobytes().decode("utf-32-le"), ends


def failed() -> Column:
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(GROUND.fields, ("failed", None, None, CONFIDENCE["failed"], None), strict=True)))


def _long(quote: Column) -> Column:
    return F.coalesce(F.length(strip(quote)), F.lit(0)) >= MIN_QUOTE


def needed(n: int, m: int) -> tuple[int, int]:
    """How many of a quote's runs a stretch of m characters must share to be alike, and how far these may be from their places.

    With M characters in matching blocks the likeness is 2 M / (n + m), so M is at least FUZZY_MIN / 2 of both lengths. Between two blocks at least one
    character of either side matches nothing, so there are at most n + m - 2 M + 1 blocks, and a block loses GRAM - 1 runs. A block is out of its place
    by no more than what matches nothing on one side.
    """
    both = math.ceil((n + m) * (FUZZY_MIN / 2) - 1e-9)
    return both - (GRAM - 1) * (n + m - 2 * both + 1), max(n, m) - both


def runs(text: str) -> np.ndarray:
    """All runs of GRAM characters in order, as numbers; of a shorter text the whole of it."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    n = max(len(c) - GRAM, 0) + 1
    c = np.pad(c, (0, max(GRAM - len(c), 0)))
    out = np.zeros(n, np.int64)
    for k in range(GRAM):
        out = out << 21 | c[k : k + n]
    return out


def _enough(order: np.ndarray, ranked: np.ndarray, size: int, quote: str) -> np.ndarray:
    """Where stretches begin that share enough runs with a quote; they begin at every eighth of it. ranked: the page's runs in order, order: their places."""
    n, own = len(quote), runs(quote)
    enough, off = needed(n, min(n, size))
    step = max(1, n // 8)
    last = (max(1, size - n) - 1) // step
    begin = np.searchsorted(ranked, own, "left")
    ends = np.cumsum(np.searchsorted(ranked, own, "right") - begin)
    # as many runs of the quote at once as have HITS hits
    turns, change, i = np.zeros(last + 2, np.int64), np.diff(ends, prepend=0), 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, "right")))
        each = change[i:j]
        at = np.arange(int(each.sum())) + np.repeat(begin[i:j] - (np.cumsum(each) - each), each)
        place = order[at] - np.repeat(np.arange(i, j), each)
        low, high = np.maximum(-((off - place) // step), 0), np.minimum((place + off) // step, last)
        fits = low <= high
        turns += np.bincount(low[fits], minlength=last + 2) - np.bincount(high[fits] + 1, minlength=last + 2)
        i = j
    return np.flatnonzero(np.cumsum(turns)[:-1] >= max(enough, 1)) * step


def best_stretch(page: str, quotes: list[str]) -> list[dict | None]:
    """For each folded quote the first of the best stretches of the folded page, if that is alike."""
    of_page = runs(page)
    order = np.argsort(of_page, kind="stable")
    ranked, out = of_page[order], []
    for q in quotes:
        best, begins = None, _enough(order, ranked, len(page), q).tolist()
        compare = difflib.SequenceMatcher(None, "", q, autojunk=False) if begins else None
        for at in begins:
            compare.set_seq1(page[at : at + len(q)])
            # the quick ratios are bounds from above
            least = FUZZY_MIN if best is None else best["like"]
            if compare.real_quick_ratio() >= least and compare.quick_ratio() >= least and (like := compare.ratio()) >= least and (best is None or like > best["like"]):
                best = {"at": at, "like": like}
        out.append(best)
    return out


def ground_all(page: str, quotes: list[str | None]) -> list[tuple | None]:
    """What is found of each quote on a page, null if nothing. Rungs come in order, and a later one is for what is left."""
    out: list[tuple | None] = [None] * len(quotes)

    def put(k: int, kind: str, start: int, end: int, confidence: float) -> None:
        out[k] = kind, start, end, confidence, page[start:end]

    for k, q in enumerate(quotes):
        if q is not None and (at := page.find(q)) >= 0:
            put(k, "exact", at, at + len(q), CONFIDENCE["exact"])
    left = {k: folded(q)[0].strip(" ") for k, q in enumerate(quotes) if q is not None and out[k] is None}
    if left:
        plain, ends = folded(page)
        origin = lambda at: int(np.searchsorted(ends, at, "right"))
        for k, q in left.items():
            if q and (at := plain.find(q)) >= 0:
                put(k, "normalized", origin(at), origin(at + len(q) - 1) + 1, CONFIDENCE["normalized"])
        left = {k: q for k, q in left.items() if out[k] is None and len(q) >= MIN_QUOTE}
        for (k, q), x in zip(left.items(), best_stretch(plain, list(left.values())) if left else [], strict=True):
            if x:
                put(k, "fuzzy", origin(x["at"]), origin(x["at"] + min(len(q), len(plain) - x["at"]) - 1) + 1, x["like"] * CONFIDENCE["fuzzy"])
    return out


@F.pandas_udf(ArrayType(GROUND))
def grounds(page: pd.Series, quotes: pd.Series) -> pd.Series:
    return pd.Series([[None] * len(q) if p is None else [x and dict(zip(GROUND.names, x, strict=True)) for x in ground_all(p, list(q))] for p, q in zip(page, quotes, strict=True)], dtype=object)


def _grounds(rows: DataFrame, page: str, quotes: str) -> DataFrame:
    """Adds `_grounds`, one for each of an array of quotes, with one look at the page of the row. Short quotes fail."""
    found = rows.withColumn("_found", grounds(page, F.transform(quotes, lambda q: F.when(_long(q), q))))
    return found.withColumn("_grounds", F.transform("_found", lambda g: F.coalesce(g, failed()))).drop("_found")


def small_batches(rows: DataFrame) -> None:
    """Rows here hold whole pages, and some of them are long."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)


def locate(rows: DataFrame, page: str = "page_text", quote: str = "quote") -> DataFrame:
    """Adds `ground` to rows that carry their page. A page that is null, or a quote that is null or short, fails.

    Rows of one page each: where many quotes share pages, locate_on() moves a page once for many of them."""
    small_batches(rows)
    return _grounds(rows.withColumn("_quotes", F.array(quote)), page, "_quotes").withColumn("ground", F.get("_grounds", F.lit(0))).drop("_quotes", "_grounds")


def locate_on(claims: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Adds `ground` to claims (key, quote, ...) whose pages (key, page_text) are a table of their own.

    Quotes are gathered by page, TOGETHER at most, and meet the page once for each such bundle; claims are joined with what was found by page and
    quote, so no page travels with its claims. Claims without a page, with a null in their key, or with a short quote fail."""
    small_batches(claims)
    pages = pages.groupBy(*key).agg(F.first("page_text").alias("page_text"))
    asked = claims.select(*key, "quote").where(_long(F.col("quote"))).distinct()
    count = asked.groupBy(*key).agg(F.ceil(F.count("*") / TOGETHER).alias("bundles"))
    bundles = asked.join(count, key).groupBy(*key, F.pmod(F.xxhash64("quote"), F.col("bundles")).alias("bundle")).agg(F.collect_list("quote").alias("quotes"))
    met = _grounds(bundles.join(pages, key), "page_text", "quotes")
    found = met.select(*key, F.explode(F.arrays_zip("quotes", "_grounds")).alias("x")).select(*key, F.col("x.quotes").alias("quote"), F.col("x._grounds").alias("_found"))
    return claims.join(found, [*key, "quote"], "left").withColumn("ground", F.coalesce("_found", failed())).drop("_found")
