"""Blocks of documents, shards of keys, and how both are packed into binary cells.

A block is what a task gathers before it sends: some thousand documents. Its keys go to shards, which are ranges of 64-bit keys; a cell holds
the keys of one block for one shard, sorted, as differences in as few whole bytes as the largest needs. Shards follow the size of the input.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Bytes of text for each shard, as long as there are not too many shards to be filled by a block.
SHARD_TEXT = 8 << 20
#: Beyond so many shards their number grows as the square root of the text, and blocks grow with it.
MANY = 4096
#: Keys, and documents, of a block. A document's place in its block takes two bytes.
BLOCK, BLOCK_DOCS = 1 << 19, 60_000
_STEPS = 22


def shards_for(docs: DataFrame, column: str = "text") -> int:
    """How many shards the texts of docs get: proportional to their bytes, later to the square root (both without an upper bound)."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    even = -(-size // SHARD_TEXT)
    return max(1, even if even <= MANY else int(MANY * (even / MANY) ** 0.5))


def block_keys(shards: int) -> int:
    return max(BLOCK, 64 * shards)


def shard_of(k: np.ndarray, shards: int) -> np.ndarray:
    return ((k >> np.uint64(64 - _STEPS)) * np.uint64(shards)) >> np.uint64(_STEPS)


def cuts(k: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin among sorted keys (shards + 1 values)."""
    return np.searchsorted(shard_of(k, shards), np.arange(shards + 1))


def squeeze(k: np.ndarray) -> tuple[int, int, bytes]:
    """Sorted 64-bit keys as the first one, a width and differences of that many bytes."""
    if not len(k):
        return 0, 0, b""
    d = np.diff(k)
    width = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    return int(k[0]), width, np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(first: int, width: int, data: bytes, n: int) -> np.ndarray:
    """The n keys that squeeze() took."""
    out = np.zeros((n, 8), np.uint8)
    if n > 1 and width:
        out[1:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = out.reshape(-1).view("<u8").astype(np.uint64)
    if n:
        out[0] = first
    with np.errstate(over="ignore"):
        return np.cumsum(out, dtype=np.uint64)


def thin(a: np.ndarray) -> tuple[str, bytes]:
    """Integers that are not negative in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(a.max())).str if len(a) else "|u1"
    return kind, a.astype(kind).tobytes()


def thick(packed: tuple[str, bytes]) -> np.ndarray:
    return np.frombuffer(packed[1], packed[0])


def pack(*values) -> bytes:
    return pickle.dumps(values, protocol=5)


def unpack(cell: bytes) -> tuple:
    lean()
    return pickle.loads(cell)
