"""Media columns in lossless WebP: a decoder for the whole format, and an encoder for rows of 8-bit samples.

decode() reads any lossless image: prefix codes (simple and normal, several groups by an entropy image), literals, back-references with
the two-dimensional distance codes, the colour cache, and it inverts the predictor, cross-colour, subtract-green and palette transforms.
It works a symbol at a time. encode() can write each of these features, one at a time, for tests of the decoder.

Payloads are stored as grey pictures of 192 columns, TILE_ROWS rows at most; a longer payload is a sequence of pictures. All have the
subtract-green transform, literals and back-references, for lengths and distances two prefix codes; references() finds the repeats of all tiles
of a batch by one sort. decode_tiles() decodes such pictures of a whole batch in lockstep: one table lookup for the next symbol of every picture
at once, then all copies. Tiles that repeat themselves with few different samples have a palette, and those of steady steps the predictor; these
pictures, those of a few long runs, and any others go to decode(). (A sample of a grey picture is its whole colour: the colour cache has nothing to
name that a literal does not, and red and blue are nothing once green is subtracted, so cross-colour has nothing to take away.)

Edge cases: null or empty text is a payload of 192 spaces; repeated rows give equal bytes; a long text has many pictures, none larger than
a tile; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

WIDTH = 192
TILE_ROWS = 32
#: The longest code that the encoder gives a sample; the lockstep decoder's tables have 2**DEPTH entries.
DEPTH = 11
#: A tile repeats itself if back-references make it so many times as short.
REPEATS_ITSELF = 10
#: A picture with so many samples for a byte is a few long runs.
LONG_RUNS = 40
#: The predictor is tried where steps between neighbours tell less than this part of what samples tell.
STEADY = 0.8
#: Pictures decoded at once.
LANES = 4096
#: Bytes of pictures, in whole batches of Arrow, that are decoded together.
GATHERED = 1 << 21

#: Fixed values of the format: the order in which lengths of code lengths are stored; lengths, with their extra bits, of repeat codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
REPEATS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}
#: Neighbours that short distance codes name, nearest first.
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


# ---------------------------------------------------------------------------------------------------------------- decoding

class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the picture is cut off")

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.skip(n)
        return x


class Code:
    """A canonical prefix code: lookup by the next bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.depth = int(lengths[used].max()) if len(used) > 1 else 0
        if len(used) <= 1:
            self.table = [(int(used[0]) if len(used) else 0, 0)]
        else:
            e = spread(lengths, self.depth)
            self.table = list(zip((e & 0xFFFF).tolist(), (e >> 16).tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        symbol, n = self.table[bits.peek(self.depth)]
        bits.skip(n)
        return symbol


_reversed: dict[int, np.ndarray] = {}


def turned(depth: int) -> np.ndarray:
    """The numbers of `depth` bits with these in opposite order."""
    if depth not in _reversed:
        i, r = np.arange(1 << depth), np.zeros(1 << depth, np.int64)
        for b in range(depth):
            r |= ((i >> b) & 1) << (depth - 1 - b)
        _reversed[depth] = r
    return _reversed[depth]


def spread(lengths: np.ndarray, depth: int) -> np.ndarray:
    """Symbol | length << 16 for each value of the next `depth` bits."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used].astype(np.uint32)
    table = np.repeat(used.astype(np.uint32) | (n << np.uint32(16)), 1 << (depth - n.astype(np.int64)))
    if len(table) != 1 << depth:
        raise ValueError("the code's lengths do not fill it")
    return table[turned(depth)]


def read_lengths(bits: Bits, size: int) -> np.ndarray:
    """Code lengths of an alphabet; a lone symbol has length 1 here and takes no bits."""
    out = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        out[bits.read(8 if wide else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return np.array(out)
    own = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    i, last, used, mask = 0, 8, 0, (1 << code.depth) - 1
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * size], "little") >> (bits.at & 7)  # 14 bits at most for each
    while i < size and left:
        left -= 1
        x, n = code.table[ahead & mask]
        ahead >>= n
        used += n
        if x < 16:
            out[i] = x
            last = x or last
            i += 1
        else:
            extra, base = REPEATS[x]
            n = base + (ahead & ((1 << extra) - 1))
            ahead >>= extra
            used += extra
            if i + n > size:
                raise ValueError("code lengths run over")
            out[i : i + n] = [last if x == 16 else 0] * n
            i += n
    bits.skip(used)
    return np.array(out)


def _number(bits: Bits, code: int) -> int:
    """A length or distance from its prefix."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """An entropy-coded image as ARGB integers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, meta, step = 1, None, 0
    if main and bits.read(1):
        step = bits.read(3) + 2
        across = -(-width >> step)
        meta = [(p >> 8) & 0xFFFF for p in _pixels(bits, across, -(-height >> step), False)]
        groups = max(meta) + 1
    alphabets = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[Code(read_lengths(bits, n)) for n in alphabets] for _ in range(groups)]
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    shift = 32 - cache_bits

    def put(p: int) -> None:
        out.append(p)
        if cache_bits:
            cache[((p * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = p

    while len(out) < width * height:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, distance = codes[meta[(y >> step) * across + (x >> step)] if meta else 0]
        g = green.read(bits)
        if g < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            put(a << 24 | r << 16 | g << 8 | b)
        elif g < 280:
            n = _number(bits, g - 256)
            d = _number(bits, distance.read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = NEIGHBOURS[d - 1]
                d = max(1, dx + dy * width)
            if d > len(out) or len(out) + n > width * height:
                raise ValueError("a back-reference points outside the picture")
            for _ in range(n):
                put(out[-d])
        else:
            put(cache[g - 280])
    return out


def _channels(p: np.ndarray) -> np.ndarray:
    """height x width x (a, r, g, b)."""
    return np.stack([(p >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _clip(x):
    return np.minimum(np.maximum(x, 0), 255)


def _predict(mode: int, left, top, top_left, top_right):
    half = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return half(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return _clip(left + top - top_left)
    if mode == 13:
        mean = half(left, top)
        d = mean - top_left
        return _clip(mean + np.where(d < 0, -((-d) >> 1), d >> 1))
    return np.array([255, 0, 0, 0])


def _signed(x):
    return (x ^ 128) - 128


def _walk_predictor(p: np.ndarray, modes: np.ndarray, size: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (sign -1) predictions; predictions always come from the true pixels."""
    height, width, _ = p.shape
    out = p.copy()
    true = out if sign > 0 else p
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                guess = np.array([255, 0, 0, 0])
            elif y == 0:
                guess = true[0, x - 1]
            elif x == 0:
                guess = true[y - 1, 0]
            else:
                right = true[y - 1, x + 1] if x + 1 < width else true[y, 0]
                guess = _predict(int(modes[y >> size, x >> size]), true[y, x - 1], true[y - 1, x], true[y - 1, x - 1], right)
            out[y, x] = (p[y, x] + sign * guess) & 255
    return out


def _cross(p: np.ndarray, rates: np.ndarray, size: int, sign: int) -> np.ndarray:
    """Adds (or takes away) what red and blue owe to green, and blue to the true red."""
    height, width, _ = p.shape
    t = rates[np.arange(height)[:, None] >> size, np.arange(width)[None] >> size]
    owed = lambda rate, colour: (_signed(rate) * _signed(colour)) >> 5
    out = p.copy()
    out[..., 1] = (p[..., 1] + sign * owed(t[..., 3], p[..., 2])) & 255
    red = out[..., 1] if sign > 0 else p[..., 1]
    out[..., 3] = (p[..., 3] + sign * (owed(t[..., 2], p[..., 2]) + owed(t[..., 1], red))) & 255
    return out


def body(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP picture")
    return data[20 : 20 + struct.unpack_from("<I", data, 16)[0]]


def header(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP picture")
    size = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return size


def decode(data: bytes) -> np.ndarray:
    """height x width x (a, r, g, b), 8 bits each, of any lossless WebP picture."""
    bits = Bits(body(data))
    full, height = header(bits)
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            across, down = -(-width >> size), -(-height >> size)
            t = _channels(np.array(_pixels(bits, across, down, False), np.int64).reshape(down, across))
            undo.append(lambda p, t=t, s=size, k=kind: _walk_predictor(p, t[..., 2], s, 1) if k == PREDICTOR else _cross(p, t, s, 1))
        elif kind == GREEN:
            undo.append(lambda p: np.stack([p[..., 0], (p[..., 1] + p[..., 2]) & 255, p[..., 2], (p[..., 3] + p[..., 2]) & 255], -1))
        else:
            n = bits.read(8) + 1
            table = np.zeros((256, 4), np.int64)
            table[:n] = np.cumsum(_channels(np.array(_pixels(bits, n, 1, False), np.int64)), 0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda p, t=table, k=pack, w=width: t[_unbundle(p[..., 2], k, w)])
            width = -(-width >> pack)
    p = _channels(np.array(_pixels(bits, width, height, True), np.int64).reshape(height, width))
    for f in reversed(undo):
        p = f(p)
    return p.astype(np.uint8)


def _unbundle(green: np.ndarray, pack: int, width: int) -> np.ndarray:
    each = 8 >> pack
    parts = [(green >> (each * i)) & ((1 << each) - 1) for i in range(1 << pack)]
    return np.stack(parts, -1).reshape(len(green), -1)[:, :width]


# ---------------------------------------------------------------------------------------------------------------- encoding

class Out:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, x: int, n: int) -> None:
        self.value |= int(x) << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def code_lengths(counts: list[int], depth: int) -> dict[int, int]:
    """Huffman code lengths of at most `depth` by symbol; too deep a tree is built again over flatter counts."""
    used = [(n, s) for s, n in enumerate(counts) if n]
    if len(used) == 1:
        return {used[0][1]: 1}
    least = 1
    while True:
        ranked = sorted((max(n, least), s) for n, s in used)
        # leaves in order, then inner nodes, which come in order too; the lighter of both queues' first is next
        k = len(ranked)
        weight, above, leaf, inner = [n for n, _ in ranked], [0] * (2 * k - 1), 0, k
        for node in range(k, 2 * k - 1):
            both = 0
            for _ in (0, 1):
                if leaf < k and (inner == node or weight[leaf] <= weight[inner]):
                    one, leaf = leaf, leaf + 1
                else:
                    one, inner = inner, inner + 1
                both += weight[one]
                above[one] = node
            weight.append(both)
        deep = [0] * (2 * k - 1)
        for node in range(2 * k - 3, -1, -1):
            deep[node] = deep[above[node]] + 1
        if max(deep) <= depth:
            return {s: n for (_, s), n in zip(ranked, deep, strict=False)}
        least = 2 * least if least > 1 else max(2, sum(n for n, _ in used) >> depth)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Code (first bit lowest) and length by symbol; a lone symbol takes no bits."""
    if len(lengths) == 1:
        return {s: (0, 0) for s in lengths}
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s] = int(format(code, f"0{n}b")[::-1], 2), n
        code, last = code + 1, n
    return out


def put_code(out: Out, lengths: dict[int, int], size: int) -> None:
    symbols = sorted(lengths)
    if len(symbols) <= 2 and max(symbols) < 256:
        wide = symbols[0] > 1
        out.put(1 | (len(symbols) - 1) << 1 | wide << 2, 3)
        out.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return
    items: list[tuple[int, int, int]] = []
    at = 0
    for s in [*symbols, size]:
        gap = s - at
        while gap:
            n = min(gap, 138)
            if n >= 11:
                items.append((18, n - 11, 7))
            elif n >= 3:
                items.append((17, n - 3, 3))
            else:
                n = 1
                items.append((0, 0, 0))
            gap -= n
        if s < size:
            items.append((lengths[s], 0, 0))
        at = s + 1
    counts = [0] * 19
    for x, _, _ in items:
        counts[x] += 1
    own = code_lengths(counts, 7)
    n = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if s in own))
    out.put((n - 4) << 1, 5)
    for s in LENGTH_ORDER[:n]:
        out.put(own.get(s, 0), 3)
    out.put(0, 1)
    code = canonical(own)
    for x, extra, bits in items:
        out.put(*code[x])
        if bits:
            out.put(extra, bits)


def riff(data: bytes) -> bytes:
    even = data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(even)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + even


def _start(width: int, height: int) -> Out:
    out = Out()
    for x, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(x, n)
    return out


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * (extra + 1) + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def _put_pixels(out: Out, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    """An image with literals, cached colours and, if asked for, back-references to runs that occurred before."""
    out.put(*((1 | cache_bits << 1, 5) if cache_bits else (0, 1)))
    if main:
        out.put(0, 1)
    cache, seen, tokens, i = [None] * (1 << cache_bits), {}, [], 0

    def note(j: int) -> None:
        if cache_bits:
            cache[((pixels[j] * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[j]
        seen[tuple(pixels[j : j + 3])] = j

    while i < len(pixels):
        p, n, j = pixels[i], 0, seen.get(tuple(pixels[i : i + 3])) if references else None
        if j is not None and i + 3 <= len(pixels):
            n = 3
            while i + n < len(pixels) and n < 4096 and pixels[j + n] == pixels[i + n]:
                n += 1
            d = i - j
            near = next((k + 1 for k, (x, y) in enumerate(NEIGHBOURS) if max(1, x + y * width) == d), d + 120)
            tokens.append(("r", _prefix(n), _prefix(near)))
        elif cache_bits and cache[at := ((p * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)] == p:
            n = 1
            tokens.append(("c", 280 + at, None))
        else:
            n = 1
            tokens.append(("l", p, None))
        for k in range(i, i + n):
            note(k)
        i += n
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    counts = [[0] * s for s in sizes]
    for kind, a, b in tokens:
        if kind == "l":
            for c, s in zip(range(4), (8, 16, 0, 24), strict=True):
                counts[c][(a >> s) & 255] += 1
        else:
            counts[0][256 + a[0] if kind == "r" else a] += 1
            if kind == "r":
                counts[4][b[0]] += 1
    lengths = [code_lengths(c, 15) if any(c) else {0: 1} for c in counts]
    codes = [canonical(x) for x in lengths]
    for x, s in zip(lengths, sizes, strict=True):
        put_code(out, x, s)
    for kind, a, b in tokens:
        if kind == "l":
            for c, s in zip(range(4), (8, 16, 0, 24), strict=True):
                out.put(*codes[c][(a >> s) & 255])
        elif kind == "c":
            out.put(*codes[0][a])
        else:
            out.put(*codes[0][256 + a[0]])
            out.put(a[1], a[2])
            out.put(*codes[4][b[0]])
            out.put(b[1], b[2])


def _ints(p: np.ndarray) -> list[int]:
    p = p.astype(np.int64)
    return (p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]).ravel().tolist()


def encode(p: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False) -> bytes:
    """A picture (height x width x argb) with the named features; transforms: (PREDICTOR, size, modes), (CROSS, size, rates), (GREEN,), (PALETTE,)."""
    height, width, _ = p.shape
    out, p = _start(width, height), p.astype(np.int64)
    for kind, *how in transforms:
        out.put(1 | kind << 1, 3)
        if kind in (PREDICTOR, CROSS):
            size, t = how
            out.put(size - 2, 3)
            shown = np.stack([np.full_like(t, 255), np.zeros_like(t), t, np.zeros_like(t)], -1) if kind == PREDICTOR else t
            _put_pixels(out, _ints(shown), t.shape[1], False)
            p = _walk_predictor(p, t, size, -1) if kind == PREDICTOR else _cross(p, t, size, -1)
        elif kind == GREEN:
            p = np.stack([p[..., 0], (p[..., 1] - p[..., 2]) & 255, p[..., 2], (p[..., 3] - p[..., 2]) & 255], -1)
        else:
            colours, index = np.unique(np.array(_ints(p)), return_inverse=True)
            colours = _channels(colours)
            index, n = index.reshape(p.shape[:2]), len(colours)
            out.put(n - 1, 8)
            _put_pixels(out, _ints(np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255), n, False)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            each, full = 8 >> pack, -(-p.shape[1] >> pack) << pack
            wide = np.pad(index, ((0, 0), (0, full - index.shape[1]))).reshape(height, -1, 1 << pack)
            green = sum(wide[..., i] << (each * i) for i in range(1 << pack))
            p = np.stack([np.full_like(green, 255), np.zeros_like(green), green, np.zeros_like(green)], -1)
    out.put(0, 1)
    _put_pixels(out, _ints(p), p.shape[1], True, cache_bits, references)
    return riff(out.bytes())


# ------------------------------------------------------------------------------------------------------- pictures of payloads

def _prefixes(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix() of the numbers below n, as arrays; that of 0 means nothing."""
    return tuple(np.array(x, np.int64) for x in zip(*(_prefix(max(1, v)) for v in range(n)), strict=True))


#: Back-references of tiles: least length of one, bytes by which earlier places are found, greatest length.
MATCH, GRAM, LONGEST = 5, 4, 4096
PREFIX, EXTRA, EXTRA_BITS = _prefixes(TILE_ROWS * WIDTH + 121)
#: Distance code of each distance within a tile, and the distance of each short code.
NEAR_OF = np.array([max(1, x + y * WIDTH) for x, y in NEIGHBOURS])
NEAR = np.arange(TILE_ROWS * WIDTH + 1) + 120
NEAR[NEAR_OF[::-1]] = np.arange(120, 0, -1)
#: Least value less one, and extra bits, of each prefix.
LEAST, WIDE = (np.array(x, np.int64) for x in zip(*((c, 0) if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1), (c - 2) >> 1) for c in range(40)), strict=True))


def references(samples: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the distance to the last place in its tile where its next GRAM samples stood, and for how many samples that distance holds."""
    n, x = len(samples), samples.astype(np.uint64)
    distance = np.zeros(n, np.int64)
    if n >= GRAM:
        key = np.arange(n - GRAM + 1, dtype=np.uint64)
        for k in range(GRAM):
            key |= x[k : n - GRAM + 1 + k] << np.uint64(32 + 8 * k)
        key = key[tile[: n - GRAM + 1] == tile[GRAM - 1 :]]
        key.sort()
        at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        again = ((key[1:] ^ key[:-1]) < np.uint64(1 << 32)) & (tile[at[1:]] == tile[at[:-1]])
        distance[at[1:][again]] = (at[1:] - at[:-1])[again]
    ends = np.flatnonzero(np.append(distance[1:] != distance[:-1], True)) + 1
    run = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    return distance, np.where(distance > 0, np.minimum(run + GRAM - 1, LONGEST), 0)


def _bare() -> tuple[int, int]:
    """The codes of red, blue and alpha where green is subtracted from grey: no bits for a sample."""
    out = Out()
    for lone in (0, 0, 255):
        put_code(out, {lone: 1}, 256)
    return out.value, out.n


BARE = _bare()


def all_canonical(lengths: np.ndarray) -> np.ndarray:
    """canonical() of many codes, a row each, of at most DEPTH bits; the length of a lone symbol becomes 0."""
    lengths[np.count_nonzero(lengths, 1) == 1] = 0
    order = np.argsort(np.where(lengths > 0, lengths, DEPTH + 1), 1, kind="stable")
    ranked = np.take_along_axis(lengths, order, 1)
    room = np.where(ranked > 0, 1 << (DEPTH - ranked), 0)
    out = np.zeros_like(lengths)
    np.put_along_axis(out, order, np.where(ranked > 0, turned(DEPTH)[(np.cumsum(room, 1) - room) & ((1 << DEPTH) - 1)], 0), 1)
    return out


def encode_tiles(tiles: list[np.ndarray]) -> list[bytes]:
    """Grey pictures of WIDTH columns, with back-references; those of all tiles are found, and their symbols packed, at once."""
    sizes = np.array([len(t) for t in tiles])
    samples, tile = np.concatenate(tiles), np.repeat(np.arange(len(tiles)), sizes)
    distance, length = references(samples, tile)
    # from the end of each match to the next one; a match ends within its tile
    could = np.flatnonzero(length >= MATCH)
    following, taken, i = np.searchsorted(could, could + length[could]).tolist(), [], 0
    while i < len(following):
        taken.append(i)
        i = following[i]
    match = could[np.array(taken, np.int64)]
    inside = np.zeros(len(samples) + 1, np.int8)
    inside[match + 1] = 1
    inside[match + length[match]] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
    far = np.searchsorted(at, match)
    step, of = np.ones(len(at), np.int64), tile[at]
    step[far] = length[match]
    symbol, near = samples[at].astype(np.int64), NEAR[distance[match]]
    symbol[far] = 256 + PREFIX[step[far]]
    counts = np.bincount(of * 280 + symbol, minlength=280 * len(tiles)).reshape(-1, 280)
    counts_far = np.bincount(of[far] * 40 + PREFIX[near], minlength=40 * len(tiles)).reshape(-1, 40)
    heads, bits, bits_far = [], np.zeros(counts.shape, np.int64), np.zeros(counts_far.shape, np.int64)
    for k, rows in enumerate((sizes // WIDTH).tolist()):
        own = code_lengths(counts[k].tolist(), DEPTH)
        own_far = code_lengths(counts_far[k].tolist(), DEPTH) if counts_far[k].any() else {0: 1}
        out = _start(WIDTH, rows)
        out.put(1 | GREEN << 1, 3)
        out.put(0, 3)  # no further transform, no cache, one group
        put_code(out, own, 280)
        out.put(*BARE)
        put_code(out, own_far, 40)
        for codes, b in ((own, bits), (own_far, bits_far)):
            b[k, list(codes)] = list(codes.values())
        heads.append(out)
    value, value_far = all_canonical(bits), all_canonical(bits_far)
    # a symbol with the extra bits of its length is one field, its distance another
    code, n = value[of, symbol], bits[of, symbol]
    code[far] |= EXTRA[step[far]] << n[far]
    n[far] += EXTRA_BITS[step[far]]
    own, p = of[far], PREFIX[near]
    code_far, n_far = value_far[own, p] | EXTRA[near] << bits_far[own, p], bits_far[own, p] + EXTRA_BITS[near]
    whole = n.copy()
    whole[far] += n_far
    place = np.cumsum(whole) - whole
    first = np.searchsorted(of, np.arange(len(tiles)))
    head = np.array([h.n for h in heads])
    size = -(-(head + np.add.reduceat(whole, first)) // 8)
    base = np.cumsum(size) - size
    place += (8 * base + head - place[first])[of]
    code, place = np.concatenate([code, code_far]), np.concatenate([place, place[far] + n[far]])
    word, shifted, total = place >> 5, code << (place & 31), (int(size.sum()) >> 2) + 2
    over = np.flatnonzero(shifted >> 32)
    buf = np.bincount(word, shifted & 0xFFFFFFFF, minlength=total) + np.bincount(word[over] + 1, shifted[over] >> 32, minlength=total)
    buf = buf.astype("<u4").view(np.uint8)
    out = []
    for a, n, h in zip(base.tolist(), size.tolist(), heads, strict=True):
        own = np.frombuffer(h.bytes(), np.uint8)
        buf[a : a + len(own)] |= own
        out.append(riff(buf[a : a + n].tobytes()))
    return out


def entropy(samples: np.ndarray) -> float:
    """Bits for each sample."""
    n = np.bincount(samples, minlength=256)
    n = n[n > 0] / len(samples)
    return float(-(n * np.log2(n)).sum())


def fitting(tile: np.ndarray, plain: bytes) -> bytes:
    """The picture of a tile, given with subtract-green and back-references, with the transform that fits it: a palette if it repeats itself and has
    few different samples, the predictor if steps between neighbours tell much less than samples do and the picture becomes shorter."""
    repeats = len(plain) * REPEATS_ITSELF < len(tile)
    if repeats and len(np.flatnonzero(np.bincount(tile))) <= 16:
        how = (PALETTE,)
    elif not repeats and len(plain) > 256 and entropy(np.diff(tile)) < STEADY * entropy(tile):
        how = (PREDICTOR, 9, np.ones((1, 1), np.int64))
    else:
        return plain
    grey = np.stack([np.full_like(tile, 255), tile, tile, tile], -1).reshape(-1, WIDTH, 4)
    if how[0] == PALETTE:
        return encode(grey, (how,), references=True)
    other = encode(grey, (how, (GREEN,)), references=True)
    return other if len(other) < len(plain) else plain


def _table(lengths: np.ndarray) -> np.ndarray:
    """Symbol | length << 16 for each value of the next DEPTH bits."""
    used = np.flatnonzero(lengths)
    return spread(lengths, DEPTH) if len(used) > 1 else np.full(1 << DEPTH, used[0] if len(used) else 0, np.uint32)


def _in_pairs(table: np.ndarray) -> np.ndarray:
    """Tables of literals and lengths, with a second literal where the same bits hold one: first | second << 9 | is there a second << 17 | bits << 18 | bits of
    the second << 22."""
    value = np.arange(1 << DEPTH, dtype=np.uint32)
    symbol, n = table & 0xFFFF, table >> 16
    then = table[np.arange(len(table))[:, None], value >> n]
    two = (symbol < 256) & ((then & 0xFFFF) < 256) & (n + (then >> 16) <= DEPTH) & (n > 0)
    return np.where(two, symbol | (then & 0xFF) << 9 | 1 << 17 | (n + (then >> 16)) << 18 | (then >> 16) << 22, symbol | n << 18)


def _lane(data: bytes):
    """Start of the symbols, number of samples and both lookup tables of a picture as encode_tiles() writes them; None if it is another, or has so
    many samples for a byte that it is few symbols, which decode() reads as well."""
    own = body(data)
    bits = Bits(own)
    width, height = header(bits)
    if width != WIDTH or height > TILE_ROWS or width * height > LONG_RUNS * len(own) or bits.read(3) != (1 | GREEN << 1) or bits.read(3):
        return None
    lengths = read_lengths(bits, 280)
    if bits.peek(BARE[1]) != BARE[0]:
        return None
    bits.skip(BARE[1])
    far = read_lengths(bits, 40)
    if max(lengths.max(), far.max()) > DEPTH:
        return None
    return bits.at, width * height, _table(lengths), _table(far)


def _copied(out: np.ndarray, start: np.ndarray, n: np.ndarray, distance: np.ndarray) -> None:
    """Fills what back-references stand for: a copy of a copy is led to the sample that it comes from, half of the way at each turn."""
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    source = np.arange(len(out))
    source[at] -= np.repeat(distance, n)
    left = at
    while len(left):
        now = source[source[left]]
        moved = now != source[left]
        source[left] = now
        left = left[moved]
    out[at] = out[source[at]]


def decode_tiles(pictures: list[bytes]) -> list[np.ndarray]:
    """The samples of grey pictures, LANES at a time in lockstep: the next symbol of every picture at once, then all copies."""
    out: list[np.ndarray | None] = [None] * len(pictures)
    lanes = []
    for i, data in enumerate(pictures):
        lane = _lane(data)
        if lane is None:
            out[i] = decode(data)[..., 2].ravel()
        else:
            lanes.append((*lane, i))
    mask = np.uint32((1 << DEPTH) - 1)
    for at in range(0, len(lanes), LANES):
        some = lanes[at : at + LANES]
        parts = [body(pictures[x[4]]) for x in some]
        sizes = np.array([len(x) for x in parts])
        buf = np.frombuffer(b"".join(parts) + bytes(8), np.uint8).astype(np.uint32)
        words = buf[:-3] | buf[1:-2] << np.uint32(8) | buf[2:-1] << np.uint32(16) | buf[3:] << np.uint32(24)
        pos = (np.cumsum(sizes) - sizes) * 8 + np.array([x[0] for x in some])
        last = 8 * np.cumsum(sizes)
        counts = np.array([x[1] for x in some])
        end = np.cumsum(counts + 2) - 2  # with room for a second literal after the last
        firsts = begin = end - counts
        put, row = begin.copy(), np.arange(len(some), dtype=np.int64) << DEPTH
        table, table_far = _in_pairs(np.stack([x[2] for x in some])).ravel(), np.concatenate([x[3] for x in some])
        samples = np.zeros(int(end[-1]) + 2, np.uint8)
        copies = []
        while len(pos):
            w = words[pos >> 3] >> (pos & 7).astype(np.uint32)
            e = table[row + (w & mask)]
            symbol, used = e & 511, (e >> 18) & 15
            # where there is no second one, what stands there now is written over later
            samples[put + 1] = (e >> 9) & 255
            samples[put] = symbol
            pos += used
            r = np.flatnonzero(symbol > 255)
            put += 1 + ((e >> 17) & 1)
            if len(r):
                c = symbol[r] - 256
                n = LEAST[c] + ((w[r] >> used[r]) & ((1 << WIDE[c]) - 1)) + 1
                p = pos[r] + WIDE[c]
                w = words[p >> 3] >> (p & 7).astype(np.uint32)
                far = table_far[row[r] + (w & mask)]
                c, used = far & 0xFFFF, far >> 16
                d = LEAST[c] + ((w >> used) & ((1 << WIDE[c]) - 1)) + 1
                d = np.where(d > 120, d - 120, NEAR_OF[np.minimum(d, 120) - 1])
                start = put[r] - 1
                if (start - d < begin[r]).any() or (start + n > end[r]).any():
                    raise ValueError("a back-reference points outside the picture")
                pos[r] = p + used + WIDE[c]
                put[r] = start + n
                copies.append((start, n, d))
            left = put < end
            if (pos - np.where(put > end, e >> 22, 0) > last).any():
                raise ValueError("the picture is cut off")
            if not left.all():
                pos, put, row, begin, end, last = (x[left] for x in (pos, put, row, begin, end, last))
        if copies:
            _copied(samples, *(np.concatenate(x) for x in zip(*copies, strict=True)))
        for x, a in zip(some, firsts.tolist(), strict=True):
            out[x[4]] = samples[a : a + x[1]]
    return out


def payload(text: bytes) -> bytes:
    n = max(1, -(-len(text) // WIDTH)) * WIDTH
    return text + b" " * (n - len(text))


def split(media: bytes) -> list[bytes]:
    """The pictures of a stored form."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out


def _store(batches):
    import pyarrow as pa

    tile = TILE_ROWS * WIDTH
    for b in batches:
        texts = [(x or "").encode() for x in b.column(1).to_pylist()]
        tiles, owner = [], []
        for i, t in enumerate(texts):
            p = np.frombuffer(payload(t), np.uint8)
            own = [p[j : j + tile] for j in range(0, len(p), tile)]
            tiles += own
            owner.append(len(own))
        media, at = [], 0
        made = [fitting(t, x) for j in range(0, len(tiles), LANES) for t, x in zip(tiles[j : j + LANES], encode_tiles(tiles[j : j + LANES]), strict=True)]
        for n in owner:
            media.append(b"".join(made[at : at + n]))
            at += n
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def feature(samples: np.ndarray) -> str:
    """Rows, sum, least and greatest sample, distinct samples, and the sum of steps between neighbours."""
    return ":".join(map(str, (len(samples) // WIDTH, int(samples.sum(dtype=np.int64)), samples.min(), samples.max(), len(np.flatnonzero(np.bincount(samples))), int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)))))


def _gathered(batches):
    """Batches put together until they hold GATHERED bytes of pictures: turns of the lockstep are fewer by that."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(2).nbytes
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _load(batches):
    import pyarrow as pa

    for b in _gathered(batches):
        media = b.column(2).to_pylist()
        pictures = [split(m) for m in media]
        flat = decode_tiles([x for p in pictures for x in p])
        rows, at = [], 0
        for m, p in zip(media, pictures, strict=True):
            samples = np.concatenate(flat[at : at + len(p)])
            at += len(p)
            data = samples.tobytes()
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_store, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.mapInArrow(_load, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


QUERIES = {"op6_webp_media": op6}
SQL: dict[str, str] = {}
