"""Words of whole texts as 64-bit hashes, computed for a whole batch at once with NumPy.

A word is a run of bytes that are not delimiters; all delimiters here are ASCII, so cutting UTF-8 bytes is cutting characters.
The hash of a word is a polynomial in its bytes modulo 2**64, taken from one running sum over the batch, then mixed.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once.
_SLICE = 1 << 18

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def delimiters(*spans: tuple[int, int]) -> np.ndarray:
    """True for the bytes that belong to words: those in none of the spans."""
    word = np.ones(256, bool)
    for lo, hi in spans:
        word[lo : hi + 1] = False
    return word


#: White space of op2's words.
SPACED = delimiters((0x20, 0x20), (0x09, 0x0D))
#: All ASCII but digits and letters ends a word of op10's.
ALNUM = delimiters((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_BYTE = mix(LOWER.astype(np.uint64), 7)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        m = max(n + 1, _SLICE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            made = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (_BASE, inverse)]
        _powers[:] = made
    return _powers[0], _powers[1]


def find(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every text the index of its first word (n + 1 values)."""
    inside = word[buf]
    n = len(buf)
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offs[:-1][offs[:-1] < n]] = False
        cut = offs[1:] - 1
        after[cut[cut >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _SLICE, "right")))
        hi = ends[j - 1]
        up, down = _power(int(hi - lo))
        with np.errstate(over="ignore"):
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((total[e] - total[s]) * down[s], 1) + (e - s).astype(np.uint64)
        i = j
    return mix(out, 2)


def text_words(column, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow string column and the index of each text's first one."""
    from .common import utf8

    buf, offs = utf8(column)
    starts, ends, first = find(buf, offs, word)
    return hashes(buf, starts, ends), first


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive words (over text borders too: the caller takes what lies within a text)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(_BASE) + h[j : j + n]
    return mix(out, 100 + k)


def inner(first: np.ndarray, k: int) -> np.ndarray:
    """Positions of all windows of k words that lie within one text."""
    n = int(first[-1])
    ok = np.ones(max(0, n - k + 1), bool)
    for j in range(1, k):
        border = first[1:-1] - j
        ok[border[(border >= 0) & (border < len(ok))]] = False
    return np.flatnonzero(ok)


class Lookup64:
    """Membership in a sorted array of 64-bit values, behind a small table of their upper bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = np.zeros(1 << 20, bool)
        self.table[values >> np.uint64(44)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h, and the index of the value found there."""
        at = np.flatnonzero(self.table[h >> np.uint64(44)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        i = np.searchsorted(self.values, h[at])
        same = self.values[np.minimum(i, len(self.values) - 1)] == h[at]
        return at[same], i[same]
