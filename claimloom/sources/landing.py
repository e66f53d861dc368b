"""Landing files: what may be read, idempotent by content, and a cache of what an extractor said about a page."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.arrays import struct_of, together
from claimloom.operators.locate import small_batches

MAX_BYTES = 50 * 1024 * 1024
CACHE_VERSION = "v3"
#: Where a word stands in its page's text, and its box.
WORD = struct_of(["start", "end"], ["x0", "y0", "x1", "y1"])


def files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length", "content")


def checked(landed: DataFrame) -> DataFrame:
    """Adds sha256 and `refused` (null, or why the file is not taken)."""
    name = F.element_at(F.split("path", "/"), -1)
    refused = (
        F.when(~F.lower(name).endswith(".pdf"), "not a PDF file name")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > MAX_BYTES, "too large")
        .when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "not a PDF")
    )
    return landed.withColumn("sha256", F.sha2("content", 256)).withColumn("refused", refused)


def new_documents(landed: DataFrame, store: DataFrame, online: bool = False) -> DataFrame:
    """Files whose content is not stored yet; with a model at hand also those that are stored without any fact. store: sha256, n_facts."""
    settled = store.where("n_facts > 0") if online else store
    return landed.dropDuplicates(["sha256"]).join(settled, "sha256", "left_anti")


def stale_documents(landed: DataFrame, store: DataFrame) -> DataFrame:
    """Stored documents that hold no fact and came again: with a model at hand they are dropped and read anew. store: doc_id, sha256, n_facts."""
    return store.where("n_facts = 0").join(landed.select("sha256").distinct(), "sha256", "left_semi")


@F.arrow_udf(WORD)
def _words(text: pa.Array) -> pa.Array:
    return together([placed(x) for x in text.to_pylist()], WORD)


def placed(text: str) -> tuple[np.ndarray, ...]:
    """WORD of each word of a page: words lie between blanks and ends of lines."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = np.flatnonzero(np.diff((c == 32) | (c == 10), prepend=True, append=True))
    begin, size, ends = edges[::2], edges[1::2] - edges[::2], np.flatnonzero(c == 10)
    line = np.searchsorted(ends, begin)
    x0, end = begin - np.concatenate(([0], ends + 1))[line], np.cumsum(size + 1) - 1
    return end - size, end, *(x.astype(np.float64) for x in (x0, line, x0 + size, line + 1))


def placed_pages(documents: DataFrame) -> DataFrame:
    """doc_id, page_no, raw, words: the pages of documents (doc_id, text), each with the places of its words as a struct of arrays (start, end, x0, y0, x1, y1),
    in order. Pages end with a form feed. A page's text is its words joined by one space, in which start and end are offsets; boxes are on a grid of
    characters and lines. Each row is made by itself: nothing is shuffled, and rows of one id are pages of their own."""
    small_batches(documents)
    pages = documents.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "raw"))
    return pages.select("doc_id", (F.col("page") + 1).alias("page_no"), "raw", _words("raw").alias("words"))


def page_words(documents: DataFrame) -> DataFrame:
    """doc_id, page_no, seq, text, start, end, x0, y0, x1, y1: the words of placed_pages(), a row each."""
    text = F.filter(F.split("raw", "[ \n]"), lambda w: w != "").alias("text")
    words = placed_pages(documents).select("doc_id", "page_no", F.posexplode(F.arrays_zip(text, *(F.col(f"words.{c}").alias(c) for c in WORD.names))).alias("seq", "w"))
    return words.select("doc_id", "page_no", "seq", "w.*")


def text_pages(words: DataFrame) -> DataFrame:
    """doc_id, page_no, page_text, words (an array with offsets and boxes) of page_words()."""
    kinds = ["text", "x0", "y0", "x1", "y1", "start", "end"]
    by = words.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct(*kinds).alias("w")))).alias("_w"))
    return by.select("doc_id", "page_no", F.array_join("_w.w.text", " ").alias("page_text"), F.col("_w.w").alias("words"))


def cache_key(text):
    return F.sha2(F.concat(F.lit(CACHE_VERSION + "\0"), text).cast("binary"), 256)


def extract(pages: DataFrame, cache: DataFrame, extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pages with what the cache, or else the pluggable extractor, says: column response (JSON); null if neither can."""
    keyed = pages.withColumn("cache_key", cache_key(F.col("page_text")))
    known = keyed.join(cache.select("cache_key", "response"), "cache_key", "left")
    if extractor is None:
        return known
    missing = keyed.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    said = extractor(missing).select("cache_key", F.col("response").alias("fresh"))
    return known.join(said, "cache_key", "left").withColumn("response", F.coalesce("response", "fresh")).drop("fresh")


def upsert(store: DataFrame, rows: DataFrame, key: list[str], latest: str | None = None) -> DataFrame:
    """The store with rows put in; a row replaces the one of its key. Of several new rows with one key that with the greatest `latest` stays."""
    if latest:
        best = rows.groupBy(*key).agg(F.max(F.struct(latest, *(c for c in rows.columns if c != latest))).alias("x"))
        rows = best.select(*(F.col("x")[c].alias(c) for c in rows.columns))
    return store.join(rows, key, "left_anti").unionByName(rows)


def without_documents(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A table without the rows of some documents: the cascade of a delete."""
    return table.join(gone, "doc_id", "left_anti")
