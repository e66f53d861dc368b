"""Token-id output: shards of raw ids, each with a minimal perfect hash index from document keys to offsets.

A shard is one record of a Parquet folder (so any store that Spark reaches will do): `payload`, the ids of its documents one after the
other as little-endian integers of `width` bytes, and `index`. The index is a minimal perfect hash function (levels of bit arrays: a key
that is alone at its place on a level is settled there, the rest goes to the next level; the rank of the set bit is the key's slot) with a
32-bit fingerprint, the first row and the number of rows of each slot, and the rows' offsets. A lookup takes constant time and never reads
another document's ids; keys that are not in the shard fail the fingerprint. Shards follow each other in ascending key order.

Edge cases: null text is encoded like empty text (the end id alone); rows with equal keys are all kept, next to each other, and one slot
names them all; rows with a null key come first and are reached by their row, not by the index; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches
from .pieces import PieceEncoder
from .words import mix

END_ID = 0
#: A shard is closed when it holds so many ids.
SHARD_IDS = 1 << 22
GAMMA = 2.0
#: Marks that form one pre-token of their own after a word.
MARKS = ".,;:!?"
SCHEMA = "part int, seq int, n_docs long, n_ids long, least_key long, most_key long, width int, keys array<long>, index binary, payload binary"


class KeyIndex:
    """Minimal perfect hash of distinct 64-bit keys, with fingerprints, serialised as one run of bytes."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], fingerprint: np.ndarray, row: np.ndarray, rows: np.ndarray, offsets: np.ndarray):
        self.levels, self.fingerprint, self.row, self.rows, self.offsets = levels, fingerprint, row, rows, offsets
        self.ranks, base = [], 0
        for _, bits in levels:
            full = np.unpackbits(bits)
            self.ranks.append((full.astype(bool), base + np.cumsum(full) - full))
            base += int(full.sum())

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys, 200 + level) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, offsets: np.ndarray) -> KeyIndex:
        """keys: one for each row, equal ones adjacent; offsets: rows + 1 values."""
        own, row, rows = np.unique(keys.view(np.uint64), return_index=True, return_counts=True)
        levels, left = [], own
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = cls._place(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append((size, np.packbits(bits)))
            left = left[~bits[at]]
        index = cls(levels, np.zeros(len(own), np.uint32), np.zeros(len(own), np.uint32), np.zeros(len(own), np.uint32), offsets.astype(np.uint64))
        slot, _ = index._slots(own)
        index.fingerprint[slot], index.row[slot], index.rows[slot] = cls._print(own), row, rows
        return index

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 199) >> np.uint64(32)).astype(np.uint32)

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, ((size, _), (bits, rank)) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(keys[open_], level, size)
            here = bits[at]
            slot[open_[here]] = rank[at[here]]
            open_ = open_[~here]
        found = np.ones(len(keys), bool)
        found[open_] = False
        return slot, found

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows for each key; 0 rows where the key is not there."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        if not len(self.fingerprint):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot, found = self._slots(keys)
        found &= self.fingerprint[slot] == self._print(keys)
        return self.row[slot].astype(np.int64), np.where(found, self.rows[slot], 0).astype(np.int64)

    def dump(self) -> bytes:
        parts = [struct.pack("<III", len(self.levels), len(self.fingerprint), len(self.offsets))]
        for size, bits in self.levels:
            parts += [struct.pack("<I", size), bits.tobytes()]
        return b"".join([*parts, self.fingerprint.astype("<u4").tobytes(), self.row.astype("<u4").tobytes(), self.rows.astype("<u4").tobytes(), self.offsets.astype("<u8").tobytes()])

    @classmethod
    def load(cls, data: bytes) -> KeyIndex:
        n_levels, n, m = struct.unpack_from("<III", data)
        at, levels = 12, []
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<I", data, at)
            k = -(-size // 8)
            levels.append((size, np.frombuffer(data, np.uint8, k, at + 4)))
            at += 4 + k
        a, b, c = (np.frombuffer(data, "<u4", n, at + 4 * n * i) for i in range(3))
        return cls(levels, a, b, c, np.frombuffer(data, "<u8", m, at + 12 * n))


_encoders: dict[int, TextEncoder] = {}


class TextEncoder(PieceEncoder):
    """Texts that hold one of the vocabulary's added tokens go to the library whole, all others piece by piece."""

    def __init__(self, encode, whole, added: list[str], dtype):
        super().__init__(encode, dtype, 1_000_000)
        self.whole, self.added = whole, added

    def __call__(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.asarray(self.whole(text), self.dtype)
        return super().__call__(text)


def text_encoder(vocabulary: str) -> TextEncoder:
    """Encodes with the tokenizers library. A word, and the marks that may follow it, are one pre-token each (whatever stands around them) and
    go straight to the library's model; any other piece goes through the whole tokenizer."""
    key = hash(vocabulary)
    if key not in _encoders:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary)
        model, letters = t.model, _byte_letters()

        marks: dict[str, list[int]] = {}

        def encode(piece: str) -> list[int]:
            word = piece.rstrip(MARKS)
            if word[1:].isalpha() and word[0] == " ":
                after = piece[len(word) :]
                if after not in marks:
                    marks.clear() if len(marks) > 10_000 else None
                    marks[after] = t.encode(after, add_special_tokens=False).ids
                return [x.id for x in model.tokenize(word.encode().decode("latin-1").translate(letters))] + marks[after]
            return t.encode(piece, add_special_tokens=False).ids

        _encoders.clear()
        added = [a.content for a in t.get_added_tokens_decoder().values()]
        _encoders[key] = TextEncoder(encode, lambda text: t.encode(text, add_special_tokens=False).ids, added, np.uint16 if t.get_vocab_size() <= 1 << 16 else np.uint32)
    return _encoders[key]


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _write(vocabulary, end_id: int, shard_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, seq = text_encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        total = 0

        def shard():
            nonlocal seq, total
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            skip = sum(k is None for k in keys)
            known = np.array(keys[skip:], np.int64)
            index = KeyIndex.build(known, offsets)
            index.row[:] += skip
            payload = np.concatenate(ids)
            row = [part, seq, len(keys), total, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, payload.itemsize, list(keys), index.dump(), payload.astype(payload.dtype.newbyteorder("<")).tobytes()]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()], strict=True)], names)
            seq, total = seq + 1, 0
            keys.clear()
            ids.clear()
            return out

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.append(encode(x or ""), encode.dtype(end_id))
                keys.append(k)
                ids.append(own)
                total += len(own)
                if total >= shard_ids:
                    yield shard()
        if keys:
            yield shard()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents (doc_id, text) in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _write(shared.value, end_id, shard_ids)(batches), SCHEMA).write.option("compression", "none").parquet(path)


def _read(batches):
    import pyarrow as pa

    for b in batches:
        names = b.schema.names
        for i in range(len(b)):
            get = lambda c, i=i: b.column(names.index(c))[i].as_py()
            index, keys, base = KeyIndex.load(get("index")), get("keys"), get("base")
            ids = np.frombuffer(get("payload"), {2: "<u2", 4: "<u4"}[get("width")])
            skip = sum(k is None for k in keys)
            own, again = np.unique(np.array(keys[skip:], np.int64), return_counts=True)
            row, rows = index.find(own)
            assert (rows == again).all(), "the index must know every key of its shard"
            order = np.concatenate([np.arange(skip), *(np.arange(r, r + n) for r, n in zip(row, rows, strict=True))]).astype(np.int64)
            whose = [None] * skip + np.repeat(own, rows).tolist()
            start, end = index.offsets[order].astype(np.int64), index.offsets[order + 1].astype(np.int64)
            sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(start, end, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(whose, pa.int64()), pa.array(start + base), pa.array(end - start), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back through the shards' indexes."""
    small_batches(spark)  # a shard's row has a fixed size, and a split of a file holds few
    shards = spark.read.parquet(path)
    from pyspark.sql import Window

    # one row a shard, so a running sum over all shards stays small
    base = shards.select("part", "seq", "n_ids").select("part", "seq", (F.sum("n_ids").over(Window.orderBy("part", "seq")) - F.col("n_ids")).alias("base"))
    return shards.join(base, ["part", "seq"]).select("base", "width", "keys", "index", "payload").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, key: int) -> list[list[int]]:
    """The ids of the documents with this key: reads the shards whose range holds it, each through its index."""
    out = []
    for r in spark.read.parquet(path).where((F.col("least_key") <= key) & (F.col("most_key") >= key)).orderBy("part", "seq").select("width", "index", "payload").toLocalIterator():
        index = KeyIndex.load(bytes(r["index"]))
        ids = np.frombuffer(bytes(r["payload"]), {2: "<u2", 4: "<u4"}[r["width"]])
        (row,), (rows,) = index.find(np.array([key]))
        out += [ids[int(index.offsets[i]) : int(index.offsets[i + 1])].tolist() for i in range(row, row + rows)]
    return out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_all(spark, path)


QUERIES = {"op7_token_ids": op7}
SQL: dict[str, str] = {}
