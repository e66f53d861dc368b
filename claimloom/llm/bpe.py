"""Byte-level BPE as a monoid: texts are encoded by halves, and neighbours are joined by encoding a window over their border anew.

encode_tree() halves a text until a leaf is small enough, encodes the leaves, and joins them pairwise up the tree. A join looks left and
right of the border for the nearest position at which a match of the pattern starts in any context (see pieces.is_cut), in windows that
double until one is found or the half ends. What lies outside these two positions has the same tokens in the whole text as in its half -
left of the first every match ends before it sees the border, and from the second on matches depend on what follows only - so just the
stretch between them is encoded again. Decoding concatenates the tokens' bytes up the same kind of tree.

Edge cases: null or empty text has no tokens; texts without any such position (one very long word) end in one window over the whole
text; repeated rows are encoded alike; empty tables give no rows; other columns pass through untouched in `row`.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches
from .pieces import PieceEncoder, is_cut

#: Characters of a leaf, and tokens of a leaf in decoding.
LEAF = 1 << 12
WINDOW = 32


class Codec:
    def __init__(self, rank_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = PieceEncoder(encoding.encode_ordinary)
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.size = np.array([len(x) for x in self.table], np.int64)
        self.name = [str(i) for i in range(len(self.table))]

    def encode_tree(self, text: str, leaf: int = LEAF) -> np.ndarray:
        if len(text) <= leaf:
            return self.leaf(text)
        mid = len(text) // 2
        return self.join(text, mid, self.encode_tree(text[:mid], leaf), self.encode_tree(text[mid:], leaf))

    def join(self, text: str, mid: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of text from those of text[:mid] and text[mid:]."""
        p, w = mid, 1
        while p > 0:
            w = max(WINDOW, 2 * w)
            p = max(0, mid - w)
            # is_cut looks one character to either side; both must lie in the left half
            found = next((x for x in range(mid - 2, p, -1) if is_cut(text, x)), None)
            if found is not None:
                p = found
                break
        q, w = mid, 1
        while q < len(text):
            w = max(WINDOW, 2 * w)
            q = min(len(text), mid + w)
            found = next((x for x in range(mid + 1, q) if is_cut(text, x)), None)
            if found is not None:
                q = found
                break
        drop_left = self._tokens(left[::-1], len(text[p:mid].encode()))
        drop_right = self._tokens(right, len(text[mid:q].encode()))
        return np.concatenate([left[: len(left) - drop_left], self.leaf(text[p:q]), right[drop_right:]])

    def _tokens(self, ids: np.ndarray, n: int) -> int:
        """How many tokens from the start take n bytes."""
        if not n:
            return 0
        most = 64
        while True:
            total = np.cumsum(self.size[ids[:most]])
            if total[-1] >= n:
                k = int(np.searchsorted(total, n))
                assert total[k] == n, "a window's edge must be a token's edge"
                return k + 1
            most *= 4

    def decode_tree(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.table.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode_tree(ids[:mid], leaf) + self.decode_tree(ids[mid:], leaf)


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each Python worker and vocabulary."""
    key = hash(shared)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shared)
    return _codecs[key]


def _encode(shared, column: str):
    def run(batches):
        import pyarrow as pa

        codec = _codec(shared)
        for b in batches:
            ids = [codec.encode_tree(x or "") for x in b.column(b.schema.names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], ["row", "ids", "n_tokens"])

    return run


def _load(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    """The vocabulary's bytes are sent along: a file of fixed size."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`row` (the input row), `ids` (little-endian unsigned 32-bit integers), `n_tokens`."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_load(path, pattern))
    here = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return here.mapInArrow(lambda batches: _encode(shared.value, "text")(batches), f"row {here.schema['row'].dataType.simpleString()}, ids binary, n_tokens long")


def _digests(shared):
    def run(batches):
        import pyarrow as pa

        codec = _codec(shared)
        names, table = codec.name.__getitem__, codec.decode_tree
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            said = [hashlib.sha256(",".join(map(names, x.tolist())).encode()).hexdigest() for x in ids]
            back = [hashlib.sha256(table(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: the number of ids, the digest of the ids, and that of the bytes that decoding them gives."""
    shared = docs.sparkSession.sparkContext.broadcast(_load(path, pattern))
    done = encode(docs.select("doc_id", "text"), path, pattern).select("row.doc_id", "ids")
    kind = done.schema["doc_id"].dataType.simpleString()
    return done.mapInArrow(lambda batches: _digests(shared.value)(batches), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_byte_bpe": op5}
SQL: dict[str, str] = {}
