"""PDF files as a data source: `spark.read.format("pdf_pages")` gives a row for each page, with its words, their offsets and boxes.

Reading. Small files are packed into partitions by size; a large file is split into ranges of pages, and a task reads from it only the objects that its
pages need. The file's cross-reference (tables, streams, or a scan for objects where both are broken), object streams, deflated content,
fonts (simple and composite, with their maps to Unicode and widths), the text operators and nested forms are read here; a page's text is its words
joined by one space. Words come in the order in which the page shows them; a gap, another line, or white space ends a word.

Writing. `df.write.format("pdf_pages")` writes a file for each row (doc_id, text), its pages parted by form feeds, on a grid of one unit for a character
and for a line. Names follow from the row, so a task that is tried again writes the same files.

Edge cases: a file that cannot be read, or is encrypted, gives one row with page_no null and the reason as `problem`; a page without text has no words and
an empty text; turned pages are read as if they were not. Paths are whatever pyarrow's filesystems read.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PAGES = "path string, page_no int, page_text string, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double,start:int,end:int>>, problem string"
#: Bytes of small files in a partition, and of a file from which on its pages are split; pages of such a split.
PACK, LARGE, RANGE = 32 << 20, 64 << 20, 50
#: Files of so many bytes are read at once; words and pages that are given to Spark together.
WHOLE, WORDS, PAGES_TOGETHER = 4 << 20, 1 << 16, 500

_SPACE = rb"\0\t\n\f\r "
_TOKEN = re.compile(rb"(?:[%b]+|%%[^\r\n]*)*(?:/([^%b()<>\[\]{}/%%]*)|(\()|(<<)|(>>)|<([0-9A-Fa-f%b]*)>|([\[\]{}])|([^%b()<>\[\]{}/%%]+))" % ((_SPACE,) * 4))
#: Groups of a token.
_NAME, _OPENS, _BEGINS, _ENDS, _HEXES, _BRACKET, _WORD = range(1, 8)
_HEX, _WHOLE_NUMBER, _FRACTION = re.compile(rb"#([0-9A-Fa-f]{2})"), re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?\d*\.\d*")
_KEYWORDS = {b"true": True, b"false": False, b"null": None}
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, as against a string (bytes) or a keyword."""


class Word(bytes):
    """A keyword or an operator."""


class Ref(NamedTuple):
    number: int
    generation: int


class Unreadable(ValueError):
    pass


def _string(buf: bytes, at: int) -> tuple[bytes, int]:
    """The string whose bracket opens before `at`."""
    out, depth = bytearray(), 1
    while at < len(buf):
        c = buf[at : at + 1]
        at += 1
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(buf, at):
                out.append(int(m[0], 8) & 255)
                at = m.end()
            else:
                e = buf[at : at + 1]
                at += 1
                if e == b"\r" and buf[at : at + 1] == b"\n":
                    at += 1
                out += b"" if e in b"\r\n" else _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    raise Unreadable("a string does not end")


def tokens(buf: bytes, at: int = 0):
    """Objects and keywords from `at` on, each with where it ends. Arrays, dictionaries and references are put together."""
    stack: list[list] = [[]]
    while m := _TOKEN.match(buf, at):
        at, kind = m.end(), m.lastindex
        got, top = m[kind], stack[-1]
        if kind == _WORD:
            if got == b"R" and len(top) >= 2 and isinstance(top[-1], int) and isinstance(top[-2], int):
                top[-2:] = [Ref(top[-2], top[-1])]
            else:
                top.append(_KEYWORDS[got] if got in _KEYWORDS else _number(got))
        elif kind == _NAME:
            top.append(Name((_HEX.sub(lambda x: bytes([int(x[1], 16)]), got) if b"#" in got else got).decode("latin-1")))
        elif kind == _OPENS:
            s, at = _string(buf, at)
            top.append(s)
        elif kind == _HEXES:
            top.append(_from_hex(got))
        elif kind == _BEGINS or got in (b"[", b"{"):
            stack.append([])
            continue
        else:
            if len(stack) < 2:
                raise Unreadable("a bracket closes that is not open")
            items = stack.pop()
            stack[-1].append(dict(zip(items[::2], items[1::2], strict=False)) if kind == _ENDS else items)
        if len(stack) == 1:
            yield stack[0][-1], at
    if len(stack) > 1:
        raise Unreadable("an array or dictionary does not end")


def _number(word: bytes):
    if _WHOLE_NUMBER.fullmatch(word):
        return int(word)
    if _FRACTION.fullmatch(word) and word.strip(b"+-") != b".":
        return float(word)
    return Word(word)


def _from_hex(digits: bytes) -> bytes:
    """A string in hexadecimal digits; blanks may stand anywhere, and a last digit may be missing."""
    try:
        return bytes.fromhex(digits.decode())
    except ValueError:
        h = re.sub(rb"\s|\0", b"", digits)
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())


def _rows(data: bytes, columns: int) -> bytes:
    """Undo the predictors of PNG rows."""
    out, before = bytearray(), bytearray(columns)
    for i in range(0, len(data) - 1, columns + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + columns])
        for j in range(len(row)):
            left, up, corner = (row[j - 1] if j else 0), before[j], (before[j - 1] if j else 0)
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            row[j] = (row[j] + (0, left, up, (left + up) // 2, paeth)[kind]) & 255
        out += row
        before = row + bytearray(columns - len(row))
    return bytes(out)


class File:
    """Random access to the objects of a file: `read(offset, n)` is all that it needs."""

    def __init__(self, read, size: int):
        self.read, self.size, self.where, self.trailer, self._known = read, size, {}, {}, {}
        try:
            self._references(int(re.findall(rb"startxref\s+(\d+)", read(max(0, size - 2048), 2048))[-1]))
            self.get(self.trailer["Root"])["Pages"]
        except (IndexError, KeyError, TypeError, ValueError, zlib.error):
            self._scan()
        if "Encrypt" in self.trailer:
            raise Unreadable("encrypted")

    def _parsed(self, at: int, take):
        """take(bytes) of what begins at `at`; of more bytes where those end too early."""
        n = 4096
        while True:
            buf = self.read(at, n)
            try:
                got = take(buf)
                if got is not None:
                    return got
            except Unreadable:
                pass
            if n >= self.size - at:
                raise Unreadable("an object does not end")
            n *= 8

    def _object(self, at: int) -> tuple[int, object]:
        """Number and value of the object at an offset; a stream is (dictionary, bytes)."""

        def take(buf):
            found = tokens(buf)
            (number, _), _, (word, _), (value, end) = (next(found, (None, 0)) for _ in range(4))
            if word != b"obj":
                raise ValueError("no object here")
            after = re.compile(rb"\s*(stream\r?\n|endobj)").match(buf, end)
            return (number, value, after.end() if after[1][:6] == b"stream" else None) if after else None

        number, value, begin = self._parsed(at, take)
        if begin is None:
            return number, value
        n = self.get(value.get("Length"))
        if not isinstance(n, int):
            raise Unreadable("a stream without length")
        return number, (value, self.read(at + begin, n))

    def _references(self, at: int) -> None:
        seen: set[int] = set()
        while isinstance(at, int) and at not in seen:
            seen.add(at)
            if self.read(at, 4) == b"xref":
                trailer = self._parsed(at, self._table)
                if isinstance(trailer.get("XRefStm"), int):
                    self._reference_stream(trailer["XRefStm"])
            else:
                trailer = self._reference_stream(at)
            self.trailer = trailer | self.trailer
            at = trailer.get("Prev")

    def _table(self, buf: bytes):
        end = buf.find(b"trailer")
        if end < 0:
            return None
        trailer = next(tokens(buf, end + 7), None)
        if trailer is None:
            return None
        found, items = {}, buf[4:end].split()
        while len(items) >= 2:
            first, n = int(items[0]), int(items[1])
            for k, (offset, _, kind) in enumerate(zip(*[iter(items[2 : 2 + 3 * n])] * 3, strict=False)):
                if kind == b"n":
                    found[first + k] = (1, int(offset), 0)
            items = items[2 + 3 * n :]
        self.where = found | self.where
        return trailer[0]

    def _reference_stream(self, at: int) -> dict:
        d, data = self._object(at)[1]
        data, widths = self.data((d, data)), d["W"]
        index = d.get("Index", [0, d["Size"]])
        numbers = [n for first, k in zip(index[::2], index[1::2], strict=True) for n in range(first, first + k)]
        for i, number in enumerate(numbers):
            at_, fields = i * sum(widths), []
            for w in widths:
                fields.append(int.from_bytes(data[at_ : at_ + w], "big") if w else 1)
                at_ += w
            if fields[0] in (1, 2):
                self.where.setdefault(number, tuple(fields))
        return d

    def _scan(self) -> None:
        """Where the cross-reference is broken: objects as they stand in the file; later ones replace earlier ones."""
        buf = self.read(0, self.size)
        self.where = {int(m[1]): (1, m.start(1), 0) for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", buf)}
        self._known, self.trailer = {}, {}
        for m in re.finditer(rb"\btrailer\b", buf):
            with contextlib.suppress(Unreadable):
                found = next(tokens(buf, m.end()), ({}, 0))[0]
                self.trailer |= found if isinstance(found, dict) else {}
        todo = list(self.where)
        for n in todo:  # grows by what object streams hold
            with contextlib.suppress(ValueError, TypeError, KeyError, zlib.error):
                value = self.get(Ref(n, 0))
                d = value[0] if isinstance(value, tuple) else value
                kind = d.get("Type") if isinstance(d, dict) else None
                if kind == "Catalog":
                    self.trailer.setdefault("Root", Ref(n, 0))
                elif kind == "ObjStm":
                    inner = [x for x, _ in tokens(self.data(value)[: self.get(d["First"])])]
                    new = {k: (2, n, i) for i, k in enumerate(inner[::2]) if k not in self.where}
                    self.where |= new
                    todo += new
        if "Root" not in self.trailer:
            raise Unreadable("no catalog")

    def get(self, x):
        """The value that a reference stands for; anything else as it is."""
        hops = 0
        while isinstance(x, Ref):
            if hops > 32:
                raise Unreadable("references in a circle")
            hops += 1
            if x.number not in self._known:
                kind, a, b = self.where.get(x.number, (0, 0, 0))
                if kind == 1:
                    self._known[x.number] = self._object(a)[1]
                elif kind == 2:
                    d, _ = stream = self.get(Ref(a, 0))
                    data, first = self.data(stream), self.get(d["First"])
                    head = [v for v, _ in tokens(data[:first])]
                    self._known[x.number] = next(tokens(data, first + head[2 * b + 1]))[0]
                else:
                    self._known[x.number] = None
            x = self._known[x.number]
        return x

    def data(self, stream: tuple[dict, bytes]) -> bytes:
        """A stream's content with its filters undone."""
        d, data = stream
        every = lambda x: [self.get(y) for y in x] if isinstance(x, list) else [x]
        filters, parameters = every(self.get(d.get("Filter"))), every(self.get(d.get("DecodeParms")))
        for i, f in enumerate(filters):
            p = (parameters[i] if i < len(parameters) else None) or {}
            if f in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data)
                if p.get("Predictor", 1) >= 10:
                    data = _rows(data, (p.get("Columns", 1) * p.get("Colors", 1) * p.get("BitsPerComponent", 8) + 7) // 8)
            elif f in ("ASCIIHexDecode", "AHx"):
                data = bytes.fromhex(re.sub(rb"\s", b"", data.split(b">")[0]).decode())
            elif f is not None:
                raise Unreadable(f"filter {f}")
        return data

    def pages(self) -> list[dict]:
        """The pages' dictionaries with what they inherit, in order."""
        out, seen = [], set()
        todo = [(self.get(self.trailer["Root"])["Pages"], {})]
        while todo:
            ref, above = todo.pop()
            if ref in seen:
                continue
            seen.add(ref) if isinstance(ref, Ref) else None
            node = self.get(ref) or {}
            own = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                todo += [(k, own) for k in reversed(self.get(node["Kids"]))]
            else:
                out.append(own | node)
        return out


#: Names of glyphs that are not a letter's own name.
GLYPHS = dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde fi fl endash emdash quoteleft quoteright quotedblleft quotedblright bullet minus".split(),
        " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~ﬁﬂ–—‘’“”•−",
        strict=True,
    )
)


def _glyph(name: str) -> str:
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4)) if m[1] else chr(int(m[2], 16))
    return GLYPHS.get(name, name if len(name) == 1 else "�")


class Font:
    """Codes of a shown string: their text and widths."""

    def __init__(self, file: File, d: dict):
        get = file.get
        self.wide = d.get("Subtype") == "Type0"
        inner = get(get(d["DescendantFonts"])[0]) if self.wide else d
        about = get(inner.get("FontDescriptor")) or {}
        self.up, self.down = (float(get(about.get(k, x))) / 1000 for k, x in (("Ascent", 800), ("Descent", -200)))
        self.text: dict[int, str] = {}
        self.width: dict[int, float] = {}
        self.other = float(get(inner.get("DW", 1000))) if self.wide else float(get(about.get("MissingWidth", 500)))
        if self.wide:
            w, i = [get(x) for x in get(inner.get("W")) or []], 0
            while i + 1 < len(w):
                if isinstance(w[i + 1], list):
                    self.width |= {w[i] + k: get(x) for k, x in enumerate(w[i + 1])}
                    i += 2
                else:
                    self.width |= dict.fromkeys(range(w[i], w[i + 1] + 1), w[i + 2])
                    i += 3
        else:
            self.width = {get(d.get("FirstChar", 0)) + k: get(x) for k, x in enumerate(get(d.get("Widths")) or [])}
            encoding = get(d.get("Encoding"))
            base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
            self.text = {c: bytes([c]).decode("mac_roman" if base == "MacRomanEncoding" else "cp1252", "replace") for c in range(256)}
            code = 0
            for x in get(encoding.get("Differences", [])) if isinstance(encoding, dict) else []:
                if isinstance(x, int):
                    code = x
                else:
                    self.text[code], code = _glyph(x), code + 1
        if isinstance(stream := get(d.get("ToUnicode")), tuple):
            self._map(file.data(stream))
        n = 1 << 16 if self.wide else 256
        self._seen, self._blank, self._point, self._letters, self._advance = (np.zeros(n, t) for t in (bool, bool, np.uint32, np.int32, np.float64))

    def _map(self, data: bytes) -> None:
        held: list = []
        say = lambda b, more=0: (b[:-2] + (int.from_bytes(b[-2:], "big") + more).to_bytes(2, "big")).decode("utf-16-be", "replace")
        for x, _ in tokens(data):
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == b"endbfchar":
                for code, to in zip(held[::2], held[1::2], strict=False):
                    self.text[int.from_bytes(code, "big")] = say(to)
            elif x == b"endbfrange":
                for lo, hi, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    first = int.from_bytes(lo, "big")
                    for k in range(int.from_bytes(hi, "big") - first + 1):
                        self.text[first + k] = say(to[k]) if isinstance(to, list) else say(to, k)
            held = []

    def _learn(self, codes: np.ndarray) -> None:
        """What the tables say of codes that come for the first time."""
        for code in np.unique(codes[~self._seen[codes]]).tolist():
            text = self.text.get(code, "�")
            self._advance[code] = float(self.width.get(code, self.other)) / 1000
            self._letters[code], self._blank[code], self._seen[code] = len(text), text.isspace() or not text, True
            self._point[code] = ord(text) if len(text) == 1 else 0

    def codes(self, s: bytes):
        """Of a shown string: its text, how many letters each code has in it, which codes are blank, their widths, and which are spaces to be widened."""
        codes = np.frombuffer(s, ">u2", len(s) // 2) if self.wide else np.frombuffer(s, np.uint8)
        if not self._seen[codes].all():
            self._learn(codes)
        letters = self._letters[codes]
        if (letters == 1).all():
            text = self._point[codes].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        else:
            text = "".join(self.text.get(c, "�") for c in codes.tolist())
        return text, letters, self._blank[codes], self._advance[codes], not self.wide and codes == 32


def _times(a: tuple, b: tuple) -> tuple:
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]


_SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Run(NamedTuple):
    """Glyphs of a shown string: their text, the letters of each in it, which are blank, their boxes (y grows upwards), and the size of their letters."""

    text: str
    letters: np.ndarray
    blank: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    size: float


def glyphs(file: File, content: bytes, resources: dict, ctm: tuple = _SAME, within: tuple = ()):
    """Runs of glyphs that a content stream shows, in its order. Places of a string's glyphs are computed at once."""
    get = file.get
    fonts: dict[str, Font] = {}
    state = {"font": None, "size": 1.0, "c": 0.0, "w": 0.0, "h": 1.0, "lead": 0.0, "rise": 0.0}
    saved, held, tm, line = [], [], _SAME, _SAME

    def show(items):
        nonlocal tm
        font = state["font"]
        for x in items:
            if isinstance(x, int | float):
                tm = _times((1, 0, 0, 1, -x / 1000 * state["size"] * state["h"], 0), tm)
            elif font is not None:
                text, letters, blank, width, space = font.codes(x)
                if not len(letters):
                    continue
                m, size = _times(tm, ctm), state["size"]
                w = width * size * state["h"]
                step = w + (state["c"] + state["w"] * space) * state["h"]
                # one after the other, as a viewer adds them up
                steps = np.empty((2, len(w) + 1))
                steps[:, 0], steps[0, 1:], steps[1, 1:] = tm[4:], step * tm[0], step * tm[1]
                e, f = np.cumsum(steps, axis=1)
                ex, ey = e[:-1] * ctm[0] + f[:-1] * ctm[2] + ctm[4], e[:-1] * ctm[1] + f[:-1] * ctm[3] + ctm[5]
                low, high = font.down * size + state["rise"], font.up * size + state["rise"]
                xa, ya, xb, yb = m[2] * low + ex, m[3] * low + ey, m[0] * w + m[2] * high + ex, m[1] * w + m[3] * high + ey
                yield Run(text, letters, blank, np.minimum(xa, xb), np.minimum(ya, yb), np.maximum(xa, xb), np.maximum(ya, yb), abs(size * m[3]) or abs(size * m[1]))
                tm = (*tm[:4], float(e[-1]), float(f[-1]))

    def move(x, y):
        nonlocal tm, line
        tm = line = _times((1, 0, 0, 1, x, y), line)

    for x, _ in tokens(content):
        if not isinstance(x, Word):
            held.append(x)
            continue
        a, held = held, []
        if x == b"q":
            saved.append((ctm, dict(state)))
        elif x == b"Q" and saved:
            ctm, state = saved.pop()
        elif x == b"cm":
            ctm = _times(tuple(a), ctm)
        elif x == b"BT":
            tm = line = _SAME
        elif x == b"Tf":
            if a[0] not in fonts:
                d = get((get(resources.get("Font")) or {}).get(a[0]))
                fonts[a[0]] = Font(file, d) if d else None
            state["font"], state["size"] = fonts[a[0]], float(a[1])
        elif x in (b"Tc", b"Tw", b"TL", b"Ts", b"Tz"):
            state[{b"Tc": "c", b"Tw": "w", b"TL": "lead", b"Ts": "rise", b"Tz": "h"}[x]] = a[0] / 100 if x == b"Tz" else a[0]
        elif x == b"Tm":
            tm = line = tuple(a)
        elif x in (b"Td", b"TD"):
            state["lead"] = -a[1] if x == b"TD" else state["lead"]
            move(*a)
        elif x in (b"T*", b"'", b'"'):
            if x == b'"':
                state["w"], state["c"] = a[0], a[1]
            move(0, -state["lead"])
            if x != b"T*":
                yield from show(a[-1:])
        elif x == b"Tj":
            yield from show(a)
        elif x == b"TJ":
            yield from show(a[0])
        elif x == b"Do":
            ref = (get(resources.get("XObject")) or {}).get(a[0])
            form = get(ref)
            if isinstance(form, tuple) and form[0].get("Subtype") == "Form" and ref not in within:
                yield from glyphs(file, file.data(form), get(form[0].get("Resources")) or resources, _times(tuple(get(form[0].get("Matrix")) or _SAME), ctm), (*within, ref))
        elif x == b"BI":
            raise Unreadable("an inline picture")


class Words(NamedTuple):
    """Words of a page as columns: texts, boxes from its upper left corner, offsets in its text."""

    text: list[str]
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _rounded(x: np.ndarray) -> np.ndarray:
    """To 3 places, as round() does: what lies next to a half is left to it."""
    out = np.rint(x * 1000) / 1000
    for i in np.flatnonzero(np.abs(np.abs(x * 1000 - np.floor(x * 1000)) - 0.5) < 1e-3).tolist():
        out[i] = round(float(x[i]), 3)
    return out


def words_of(file: File, page: dict) -> Words:
    """Words of a page: a glyph goes on with a word if it stands on the line of the glyph before it and next to it."""
    content = file.get(page.get("Contents"))
    streams = [file.get(c) for c in content] if isinstance(content, list) else [content]
    data = b"\n".join(file.data(s) for s in streams if isinstance(s, tuple))
    left, _, _, top = (float(file.get(v)) for v in file.get(page.get("MediaBox")) or (0, 0, 612, 792))
    shown = list(glyphs(file, data, file.get(page.get("Resources")) or {}))
    if not shown:
        none = np.zeros(0)
        return Words([], none, none, none, none, none.astype(np.int64), none.astype(np.int64))
    text = "".join(r.text for r in shown)
    letters, blank, x0, y0, x1, y1 = (np.concatenate([r[k] for r in shown]) for k in range(1, 7))
    size = np.repeat([r.size for r in shown], [len(r.letters) for r in shown])
    place = np.concatenate(([0], np.cumsum(letters, dtype=np.int64)))
    seen = np.flatnonzero(~blank)
    apart, half = x0[1:] - x1[:-1], size[1:] / 2
    begins = np.ones(len(blank), bool)
    begins[1:] = blank[:-1] | ~((np.abs(y0[:-1] - y0[1:]) < half) & (-half < apart) & (apart < size[1:] / 4))
    first = np.flatnonzero(begins[seen])
    if not len(first):
        return Words([], *(np.zeros(0) for _ in range(4)), *(np.zeros(0, np.int64) for _ in range(2)))
    last = np.append(first[1:], len(seen)) - 1
    from_, to = place[seen[first]], place[seen[last] + 1]
    n = to - from_
    start = np.cumsum(n + 1) - (n + 1)
    least = lambda v: np.minimum.reduceat(v[seen], first)
    most = lambda v: np.maximum.reduceat(v[seen], first)
    boxes = (_rounded(v) for v in (least(x0) - left, top - most(y1), most(x1) - left, top - least(y0)))
    return Words([text[a:b] for a, b in zip(from_.tolist(), to.tolist(), strict=True)], *boxes, start, start + n)


def page_words(file: File, page: dict) -> list[dict]:
    """Words of a page with offsets in its text and boxes from its upper left corner."""
    w = words_of(file, page)
    return [dict(zip(Words._fields, row, strict=True)) for row in zip(w.text, *(c.tolist() for c in w[1:]), strict=True)]


def write_pdf(text: str) -> bytes:
    """A file of the text's pages (parted by form feeds): a composite font with a code for each character, half its size wide, one unit a character."""
    pages = text.split("\f")
    letters = sorted(set(text) - {"\f", "\n"})
    if len(letters) > 65000:
        raise ValueError("more letters than a font has codes")
    code = {c: i + 1 for i, c in enumerate(letters)}
    coded = {ord(c): chr(k) for c, k in code.items()}
    mapped = [f"<{code[c]:04x}> <{c.encode('utf-16-be', 'surrogatepass').hex()}>" for c in letters]
    blocks = "".join(f"{len(part)} beginbfchar\n" + "\n".join(part) + "\nendbfchar\n" for part in (mapped[i : i + 100] for i in range(0, len(mapped), 100)))
    objects: dict[int, bytes] = {}
    stream = lambda data: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(z := zlib.compress(data, 6)), z)
    objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Grid /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 6 0 R >>"
    objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Grid /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /FontDescriptor 5 0 R >>"
    objects[5] = b"<< /Type /FontDescriptor /FontName /Grid /Flags 4 /FontBBox [0 -100 500 400] /ItalicAngle 0 /Ascent 400 /Descent -100 /CapHeight 400 /StemV 80 >>"
    objects[6] = stream(("/CIDInit /ProcSet findresource begin 12 dict begin begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange\n" + blocks + "endcmap end end").encode())
    kids = []
    for page in pages:
        lines = page.split("\n")
        height, number = len(lines) + 1, 7 + 2 * len(kids)
        shown = ["BT /F 2 Tf"]
        for i, s in enumerate(lines):
            if s:
                shown.append(f"1 0 0 1 0 {height - i - 0.8:.1f} Tm <{s.translate(coded).encode('utf-16-be', 'surrogatepass').hex()}> Tj")
        objects[number] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F 3 0 R >> >> /Contents %d 0 R >>" % (max(map(len, lines)) + 1, height, number + 1)
        objects[number + 1] = stream("\n".join([*shown, "ET"]).encode())
        kids.append(b"%d 0 R" % number)
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%b] >>" % (len(kids), b" ".join(kids))
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for n in sorted(objects):
        at[n] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (n, objects[n])
    table = b"".join(b"%010d 00000 n \n" % at[n] for n in sorted(at))
    out += b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, table, len(at) + 1, len(out))
    return bytes(out)


@dataclass
class Range(InputPartition):
    """Whole files, or pages (from, to) of one."""

    files: list
    pages: tuple | None = None


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _file(path: str) -> File:
    system, inner = _opened(path)
    f = system.open_input_file(inner)
    size = f.size()
    if size <= WHOLE:
        with f:
            data = f.read()
        return File(lambda at, n: data[max(0, at) : max(0, at) + n], size)

    def read(at: int, n: int) -> bytes:
        f.seek(max(0, min(at, size)))
        return f.read(n)

    return File(read, size)


def _batch(rows: list[tuple[str, int | None, Words | None, str | None]]):
    """Pages (path, number, words, problem) as a batch of Spark's rows."""
    import pyarrow as pa

    words = [w for _, _, w, _ in rows if w is not None]
    texts = pa.array([x for w in words for x in w.text], pa.string())
    kinds = [pa.float64()] * 4 + [pa.int32()] * 2
    columns = [pa.array(np.concatenate([w[k + 1] for w in words]) if words else [], pa.float64() if k < 4 else pa.int64()).cast(kind) for k, kind in enumerate(kinds)]
    fields = [pa.field(n, t) for n, t in zip(Words._fields, [pa.string(), *kinds], strict=True)]
    flat = pa.StructArray.from_arrays([texts, *columns], fields=fields)
    ends = np.cumsum([0, *(0 if w is None else len(w.text) for _, _, w, _ in rows)]).tolist()
    lists = pa.ListArray.from_arrays(pa.array([None if i < len(rows) and rows[i][2] is None else e for i, e in enumerate(ends)], pa.int32()), flat, type=pa.list_(pa.field("element", flat.type)))
    out = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([None if r[2] is None else " ".join(r[2].text) for r in rows], pa.string()), lists, pa.array([r[3] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(out, ["path", "page_no", "page_text", "words", "problem"])


class PdfReader(DataSourceReader):
    def __init__(self, path: str, large: int, pages: int):
        self.path, self.large, self.pages = path.rstrip("/"), large, pages

    def partitions(self):
        from pyarrow import fs

        system, inner = _opened(self.path)
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        scheme = self.path[: self.path.index(inner)] if inner in self.path else ""
        out, held, size = [], [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".pdf")), key=lambda f: f.path):
            path = scheme + f.path
            if f.size >= self.large:
                with contextlib.suppress(ValueError, TypeError, KeyError, zlib.error):
                    n = len(_file(path).pages())
                    out += [Range([path], (i, min(n, i + self.pages))) for i in range(0, n, self.pages)]
                    continue
            held.append(path)
            size += f.size
            if size >= PACK or len(held) >= 256:
                out.append(Range(held))
                held, size = [], 0
        return [*out, Range(held)] if held or not out else out

    def read(self, partition):
        held, n = [], 0
        for row in self._pages(partition):
            held.append(row)
            n += 0 if row[2] is None else len(row[2].text)
            if n >= WORDS or len(held) >= PAGES_TOGETHER:
                yield _batch(held)
                held, n = [], 0
        if held:
            yield _batch(held)

    def _pages(self, partition):
        """(path, number, words, problem) of each page."""
        for path in partition.files:
            try:
                file = _file(path)
                every = file.pages()
                first, last = partition.pages or (0, len(every))
                for i in range(first, last):
                    yield path, i + 1, words_of(file, every[i]), None
            except (ValueError, TypeError, KeyError, IndexError, zlib.error) as e:
                yield path, None, None, f"{type(e).__name__}: {e}"[:200]


@dataclass
class Written(WriterCommitMessage):
    paths: list


class PdfWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows):
        system, inner = _opened(self.path)
        system.create_dir(inner, recursive=True)
        done = []
        for row in rows:
            name = f"{row.doc_id}-{hashlib.sha256((row.text or '').encode()).hexdigest()[:16]}.pdf"
            with system.open_output_stream(f"{inner}/{name}") as f:
                f.write(write_pdf(row.text or ""))
            done.append(name)
        return Written(done)

    def commit(self, messages):
        """Files are whole once they are closed."""

    def abort(self, messages):
        system, inner = _opened(self.path)
        for m in messages:
            for name in m.paths if m else []:
                system.delete_file(f"{inner}/{name}")


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options["path"], int(self.options.get("largeBytes", LARGE)), int(self.options.get("pagesPerPartition", RANGE)))

    def writer(self, schema, overwrite) -> PdfWriter:
        return PdfWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfPages)
