"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

1. Every page becomes a stream of tags and text slots; repeated neighbours are folded to (...)+. Distinct streams are counted by host.
2. For each host the streams are aligned one after the other with the wrapper so far. What stands in one of them only becomes optional
   (...)?, repeated groups are aligned with each other, texts become slots #. Alignment runs in salted parts of a host first, then over
   the parts' wrappers, so one large host is no single task.
3. Every stream is matched against its host's wrapper, so each text of a page fills one slot of it. Of each slot the host's pages tell
   whether its text is constant or varies. Slots within an article of the main element are content, or else those of the main element, of any
   article, or, on pages without either, all slots; not those whose text is constant over different pages (but for headings in articles), nor
   those in menus, headers, footers, adverts, comments and the like.
   Words of classes that also name content (SOFT) give way where the slot's text varies and is prose.
4. The host's decisions are joined with its pages, and the text of content slots is taken block by block.

Edge cases: null or empty html gives empty text; broken or cut markup is read as far as it goes; a page with null url belongs to host '';
very long pages are processed whole; repeated rows give equal results; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import collections
import difflib
import functools
import hashlib
import html as entities
import json
import re
import zlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, small_batches
from .urls import host

SALTS = 16
#: The longest repeated group that is folded, in tokens.
PERIOD = 24
#: Different pages that must agree on a text before it counts as the host's own; copies of a page count once.
SAME = 3

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol "
    "option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("head nav footer aside form button select menu dialog label input option".split()) | RAW
CONTAINER = (BLOCK - {"br", "hr"}) | {"button", "label", "span"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer header masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments reply "
    "replies respond disqus discussion widget widgets login signup register search toolbar pagination pager copyright legal disclaimer skip".split()
)
#: Of these, words that also stand at content.
SOFT = frozenset("alert banner copyright disclaimer discussion legal notice notices overlay reply register related search share sharing side skip social widget widgets".split())
#: Mean characters of a varying slot that count as prose.
PROSE = 80
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@functools.lru_cache(1 << 14)
def _sign(tag: str, rest: str | None) -> str:
    """An element with its class, id and role: 'div.ad'."""
    if not rest or "=" not in rest:
        return tag
    words = []
    for name, *values in _ATTRIBUTE.findall(rest):
        own = _PARTS.findall("".join(values))
        if "item" in own and tag not in ("ul", "ol", "li", "a"):
            own = [w for w in own if w != "menu"]  # outside a list it is an item on a menu, not of one
        words += [("@" if name.lower() == "role" else ".") + w.lower() for w in own]
    return tag + "".join(sorted(set(words)))


@functools.lru_cache(1 << 14)
def _tag(sign: str) -> str:
    return re.split("[.@]", sign, maxsplit=1)[0]


def boilerplate(sign: str, hints: frozenset = HINTS) -> bool:
    tag, *words = re.split(r"(?=[.@])", sign)
    if tag in NEVER:
        return True
    if tag in ("html", "body", "article", "main"):
        return any(w[0] == "." and w[1:] in ("comment", "comments", "reply", "ad", "advert", "related") for w in words) if tag == "article" else False
    return any(w[1:] in (hints if w[0] == "." else ROLES) for w in words)


def read(page: str):
    """The page's events: (sign of the element opened, closed or None, text) in order, as ('<', sign), ('>', tag), ('#', raw text)."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "#", page[at:]
            return
        if m.start() > at:
            yield "#", page[at : m.start()]
        at = m.end()
        close, tag, rest, odd = m.groups()
        tag = (tag or odd or "").lower()
        if close:
            yield ">", close.lower()
        elif tag:
            yield "<", _sign(tag, rest)
            if tag in RAW and not (rest or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                yield "#", page[at : end.start() if end else n]
                yield ">", tag
                at = end.end() if end else n


class Place(NamedTuple):
    """An open element: a digest of the signs down to it, where it is by all class words and by the firm ones only (see region), if in a heading."""

    id: int
    hard: str
    soft: str
    heading: bool


_TOP = Place(0, "open", "open", False)


@functools.lru_cache(1 << 14)
def region(above: str, sign: str, hints: frozenset = HINTS) -> str:
    """Where an element is, from where its parent is: 'inner' (an article in the main element), 'main', 'article', 'open' or 'never'."""
    tag = _tag(sign)
    if above == "never" or boilerplate(sign, hints) or (tag == "header" and above == "open"):
        return "never"
    if tag == "article":
        return "inner" if above in ("main", "inner") else "article"
    return "main" if (tag == "main" or "@main" in sign) and above == "open" else above


@functools.lru_cache(1 << 16)
def _within(above: Place, sign: str) -> Place:
    digest = int.from_bytes(hashlib.blake2b(f"{above.id:x}/{sign}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return Place(digest, region(above.hard, sign), region(above.soft, sign, HINTS - SOFT), above.heading or _tag(sign) in HEADINGS)


def slots(page: str):
    """(place, text, block) for each text of the page; block numbers change where a block begins or ends. Also yields tags: (None, token, block).

    A step costs the same at any depth: an element knows its place from its parent's. A paragraph ends where a block begins."""
    tags: list[str] = []
    places = [_TOP]
    open_: collections.Counter = collections.Counter()
    block = 0

    def close(tag: str) -> None:
        while True:
            last = tags.pop()
            places.pop()
            open_[last] -= 1
            if last == tag:
                return

    for kind, x in read(page):
        if kind == "#":
            yield places[-1], x, block
            continue
        tag = x if kind == ">" else _tag(x)
        if tag in BLOCK:
            block += 1
        yield None, ("</" if kind == ">" else "<") + x, block
        if tag in VOID or (tag not in CONTAINER and tag not in RAW):
            continue
        if kind == "<":
            if tag == "body" and open_["head"]:
                close("head")
            if tag in BLOCK and open_["p"]:
                close("p")
            tags.append(tag)
            places.append(_within(places[-1], x))
            open_[tag] += 1
        elif open_[tag]:
            close(tag)


def _folded(tokens: list, at: list) -> tuple[list, list]:
    """Repeated neighbours become ['+', group]. `at` has for each token, and so for each group, what its leaves stand for."""
    for p in range(1, PERIOD + 1):
        out, to, i = [], [], 0
        while i < len(tokens):
            if i + 2 * p <= len(tokens) and tokens[i] == tokens[i + p] and tokens[i : i + p] == tokens[i + p : i + 2 * p]:
                group, leaves = tokens[i : i + p], [list(x) for y in at[i : i + p] for x in y]
                i += p
                while tokens[i : i + p] == group:
                    for own, x in zip(leaves, (x for y in at[i : i + p] for x in y), strict=True):
                        own += x
                    i += p
                out.append(group[0] if p == 1 and group[0][0] == "+" else ["+", group])
                to.append(leaves)
            else:
                out.append(tokens[i])
                to.append(at[i])
                i += 1
        tokens, at = out, to
    return tokens, at


def fold(tokens: list) -> list:
    """Repeated neighbours become ['+', group]."""
    return _folded(tokens, [[[]] for _ in tokens])[0]


def _core(node):
    """The node without its mark as optional."""
    return node[1] if not isinstance(node, str) and node[0] == "?" else node


def _shape(node) -> str:
    """What two nodes must share to be aligned; repeated groups by their first token."""
    node = _core(node)
    return node if isinstance(node, str) else "+" + _shape(node[1][0])


def align(a: list, b: list) -> list:
    """A wrapper for what either wrapper covers: what one of them lacks becomes ['?', node]."""
    if a == b:
        return a
    out = []
    for what, i, j, k, l in difflib.SequenceMatcher(None, [_shape(x) for x in a], [_shape(x) for x in b], autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:l], strict=True):
                own, other = _core(x), _core(y)
                both = own if isinstance(own, str) or own == other else ["+", align(own[1], other[1])]
                out.append(both if x is own and y is other else ["?", both])
        else:
            out += [["?", _core(x)] for x in (*a[i:j], *b[k:l])]
    return out


def located(found: list) -> tuple[list, list[list[int]]]:
    """The stream of a page's slots(), and for each of its leaves the numbers of the texts there."""
    kept = [(i, place, x) for i, (place, x, _) in enumerate(found) if place is None or x.strip()]
    tree, at = _located(tuple(f"#{place.id:x}" if place is not None else x for _, place, x in kept))
    return tree, [[kept[k][0] for k in x] for x in at]


@functools.lru_cache(512)
def _located(tokens: tuple) -> tuple[list, list[list[int]]]:
    """Most pages of a host have one of a few streams, so the last ones are remembered."""
    tree, at = _folded(list(tokens), [[[i]] for i in range(len(tokens))])
    return tree, [x for y in at for x in y]


def stream(page: str) -> list:
    return located(list(slots(page)))[0]


def _width(node) -> int:
    node = _core(node)
    return 1 if isinstance(node, str) else sum(map(_width, node[1]))


def match(stream: list, wrapper: list) -> list[int]:
    """For each leaf of a stream the leaf of the wrapper that it fills; -1 where the wrapper has none."""
    starts = [0]
    for x in wrapper:
        starts.append(starts[-1] + _width(x))
    own = [_core(x) for x in stream]
    to: dict[int, int] = {}
    if len(own) == len(wrapper):
        to = {j: j for j, (x, y) in enumerate(zip(own, wrapper, strict=True)) if _shape(x) == _shape(y)}
    if len(to) < len(own):
        blocks = difflib.SequenceMatcher(None, [_shape(x) for x in wrapper], [_shape(x) for x in own], autojunk=False).get_matching_blocks()
        to = {k + d: i + d for i, k, n in blocks for d in range(n)}
    out: list[int] = []
    for j, x in enumerate(own):
        if j not in to:
            out += [-1] * _width(x)
        elif isinstance(x, str):
            out.append(starts[to[j]])
        else:
            out += [p if p < 0 else p + starts[to[j]] for p in match(x[1], _core(wrapper[to[j]])[1])]
    return out


def regex(wrapper: list) -> str:
    """The wrapper as a union-free regular expression, for reading."""

    def one(x) -> str:
        if isinstance(x, str):
            return "#" if x[0] == "#" else x
        return f"({regex(x[1])})+" if x[0] == "+" else f"({one(x[1])})?"

    return " ".join(map(one, wrapper))


def _leaves(wrapper: list):
    for x in map(_core, wrapper):
        if isinstance(x, str):
            yield x
        else:
            yield from _leaves(x[1])


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _voice(text: str) -> int:
    """The least hash of the text's word pairs: mostly the same for near copies."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    return min(map(zlib.crc32, words[1:], map(zlib.crc32, words)), default=zlib.crc32(raw))


def _streams(batches):
    """(host, wrapper: the page's stream, its digest, and for those leaves that are to be judged: leaf, digest and length of its text, who says it)."""
    import pyarrow as pa

    kinds = {"host": pa.string(), "wrapper": pa.string(), "sid": pa.int64(), "leaf": pa.list_(pa.int32()), "text": pa.list_(pa.int64()), "chars": pa.list_(pa.int64()), "who": pa.list_(pa.int64())}
    for b in batches:
        out = []
        for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = list(slots(page or ""))
            tree, at = located(found)
            made = _dump(tree)
            judged = {}
            for leaf, (x, texts) in enumerate(zip(_leaves(tree), at, strict=True)):
                if x[0] == "#" and found[texts[0]][0].soft != "never":
                    judged[leaf] = found[texts[0]][0].hard, "\n".join(" ".join(found[i][1].split()) for i in texts)
            whole = _digest(_dump([t for _, t in judged.values()]))
            # within an article near copies count as one page too: whoever has the same longest text but for a few words
            voice = _voice(max((t for r, t in judged.values() if r != "never"), key=len, default=""))
            out.append((h, made, _digest(made), list(judged), [_digest(t) for _, t in judged.values()], [len(t) for _, t in judged.values()], [whole if r == "open" else voice for r, _ in judged.values()]))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds.values())], list(kinds))


STREAMS = "host string, wrapper string, sid long, leaf array<int>, text array<long>, chars array<long>, who array<long>"


def _places(batches):
    """(host, sid, for each leaf of the stream its place in the host's wrapper)."""
    import pyarrow as pa

    for b in batches:
        at = [match(json.loads(x), json.loads(w)) for x, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32()))], ["host", "sid", "places"])


def _infer(pdf):
    import pandas as pd

    made: list | None = None
    for w in sorted(pdf["wrapper"], key=lambda w: (len(w), w)):
        made = json.loads(w) if made is None else align(made, json.loads(w))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [_dump(made or [])]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) for pages (host, html)."""
    return _inferred(pages.mapInArrow(_streams, STREAMS))


def _inferred(streams: DataFrame) -> DataFrame:
    kinds = "host string, wrapper string"
    seen = streams.select("host", "wrapper").distinct()
    parts = seen.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInPandas(_infer, kinds)
    return parts.groupBy("host").applyInPandas(_infer, kinds)


def text_of(page: str, wrapper: list, own: set[int], prose: set[int], known: dict | None = None) -> str:
    """The blocks of the page's content slots, joined by one space. own and prose: constant slots of the wrapper, and varying ones of prose."""
    found = list(slots(page))
    tree, at = located(found)
    known = {} if known is None else known
    made = _dump(tree)
    if made not in known:
        known[made] = match(tree, wrapper)
    place = {i: p for p, texts in zip(known[made], at, strict=True) for i in texts}
    blocks: dict[str, list[tuple[int, str]]] = {"inner": [], "main": [], "article": [], "open": []}
    for i, (slot, x, block) in enumerate(found):
        if slot is None:
            continue
        p = place.get(i, -1)
        where = slot.soft if p in prose else slot.hard
        if where != "never":
            # headings that all articles of a host have are the articles' own
            kept = p not in own or (slot.heading and where != "open")
            blocks[where].append((block, entities.unescape(x) if kept else ""))
    said = next((b for b in blocks.values() if any(x.strip() for _, x in b)), [])
    out: list[str] = []
    for i, (block, x) in enumerate(said):
        if i and said[i - 1][0] == block:
            out[-1] += x
        else:
            out.append(x)
    return " ".join(y for x in out if (y := " ".join(x.split())))


def _extract(batches):
    import pyarrow as pa

    known: dict[str, tuple] = {}
    for b in batches:
        texts = []
        for page, wrapper, own, prose in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            if wrapper not in known:
                known.clear() if len(known) > 200 else None
                known[wrapper] = json.loads(wrapper or "[]"), {}
            tree, matched = known[wrapper]
            matched.clear() if len(matched) > 1000 else None
            texts.append(text_of(page or "", tree, set(own or ()), set(prose or ()), matched))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    streams = keep(rows.select("host", "html").mapInArrow(_streams, STREAMS), "streams")
    inferred = keep(_inferred(streams), "wrappers")
    seen = streams.select("host", "sid", F.col("wrapper").alias("stream")).distinct()
    places = seen.join(inferred, "host").select("host", "sid", "stream", "wrapper").mapInArrow(_places, "host string, sid long, places array<int>")
    said = streams.where("size(leaf) > 0").drop("wrapper").distinct().join(places, ["host", "sid"]).select("host", "places", F.explode(F.arrays_zip("leaf", "text", "chars", "who")).alias("x"))
    said = said.select("host", F.col("places")[F.col("x.leaf")].alias("place"), "x.text", "x.chars", "x.who").where("place >= 0").distinct()  # copies of a page count once
    by = said.groupBy("host", "place").agg(F.count_distinct("who").alias("n"), F.count_distinct("text").alias("texts"), F.avg("chars").alias("chars"))
    by = by.where(F.col("n") >= SAME).where((F.col("texts") == 1) | (F.col("texts") >= SAME) & (F.col("chars") >= PROSE))
    chosen = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("place"))))
    known = inferred.join(by.groupBy("host").agg(chosen(F.col("texts") == 1).alias("own"), chosen(F.col("texts") > 1).alias("prose")), "host", "left")
    known = keep(known, "known")  # so that the join below has nothing but its own shuffle on either side, and a host of very many pages is split
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.join(known, "host", "left").select("page_id", "url", "html", "wrapper", "own", "prose").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_html_wrappers": op1}
SQL: dict[str, str] = {}
