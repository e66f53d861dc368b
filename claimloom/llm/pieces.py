"""Texts cut where every byte-level BPE pre-tokenizer of this pattern family cuts too, and the cut pieces' ids remembered.

The pattern's matches hold a space only as their first character or within a run of white space. So a space between two characters that
are no white space starts a match in any context, and from the start of a match on the matches depend on what follows only: the pieces
between such spaces have their ids independently of each other. (White space here is Python's, which contains the pattern's.)
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

_BESIDE_SPACE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<!\s) (?!\s)")


def cut(text: str) -> list[str]:
    """Pieces; each but the first has lost the space it starts with."""
    return _CUT.split(text) if _BESIDE_SPACE.search(text) else text.split(" ")


def is_cut(text: str, p: int) -> bool:
    """Whether a match starts at p, whatever stands around the three characters there."""
    return 0 < p < len(text) - 1 and text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()


class Memo(dict):
    """Ids of pieces as bytes; missing ones are encoded, and all are dropped when there are too many."""

    def __init__(self, encode: Callable[[str], list[int]], before: str, most: int, dtype):
        super().__init__()
        self.encode, self.before, self.most, self.dtype = encode, before, most, dtype

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = np.asarray(self.encode(self.before + piece), self.dtype).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class PieceEncoder:
    def __init__(self, encode: Callable[[str], list[int]], dtype=np.uint32, most: int = 250_000):
        self.dtype = dtype
        self.inner, self.first = Memo(encode, " ", most, dtype), Memo(encode, "", 50_000, dtype)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        head, *rest = cut(text)
        return np.frombuffer(self.first[head] + b"".join(map(self.inner.__getitem__, rest)), self.dtype)
