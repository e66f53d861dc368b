"""Small column helpers that the normalizers share."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's classes are ASCII unless told otherwise.
U = "(?U)"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def sql_text(x: str) -> str:
    """A SQL string literal, taken as it is."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_map(table: dict) -> str:
    """A SQL map of literals."""
    return "map(" + ", ".join(sql_text(x) if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x) for kv in table.items() for x in kv) + ")"


def sql_first_hit(x: str, rules: list[tuple[str, object]]) -> str:
    """SQL for the value of the first rule whose pattern occurs in x.

    One test of all patterns comes first, and is all that most rows need. The rules stand in a lambda, which keeps them out of generated code:
    methods that grow too long for that are not compiled to machine code."""
    show = lambda v: sql_text(v) if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"
    any_ = U + "|".join(f"(?:{pattern})" for pattern, _ in rules)
    chain = " ".join(f"WHEN t RLIKE {sql_text(U + pattern)} THEN {show(value)}" for pattern, value in rules)
    return f"CASE WHEN {x} RLIKE {sql_text(any_)} THEN transform(array({x}), t -> CASE {chain} END)[0] END"


def staged(df, steps: list[tuple[str, str]], out: str):
    """df with the last step's column as out. Each step is SQL over the columns of df and the steps before it, and is computed once."""
    names = [n for n, _ in steps]
    done = df.selectExpr("*", *(f"{sql} AS {n}" for n, sql in steps))
    return done.withColumnRenamed(names[-1], out).drop(*names[:-1])


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, U + r"^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, U + r"\s+", " "))


def words(x: Column) -> Column:
    return F.filter(F.split(x, U + r"\s+"), lambda w: w != "")


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def word_pattern(token: str) -> str:
    return rf"\b{re.escape(token)}\b" if token[0].isalpha() else re.escape(token)


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """What each letter of any script is without its marks, where that is another text: of one character (or none), and of several. Syllables of Hangul
    are left to a rule."""
    one, more = {}, {}
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)]):  # the planes above have neither marks nor such letters
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c:
            (more if len(plain) > 1 else one)[c] = plain
    return one, more


_ONE, _MORE = _decomposed()
#: The letters of several characters as ranges of a class, and as one literal that is read once for a plan. Their texts hold no line breaks.
_RANGES = "".join(f"\\x{{{min(g):X}}}-\\x{{{max(g):X}}}" for _, x in itertools.groupby(enumerate(sorted(map(ord, _MORE))), lambda p: p[1] - p[0]) for g in [[v for _, v in x]])
_HANGUL = "\\uAC00-\\uD7A3"
_TABLE = "\n".join(f"{c}\r{by}" for c, by in _MORE.items())


def strip_accents(x: Column) -> Column:
    """Compatibility decomposition without combining marks, of all scripts. Marks that the Unicode tables count as not combining stay."""
    plain = F.translate(x, "".join(c for c, by in _ONE.items() if by) + "".join(c for c, by in _ONE.items() if not by), "".join(_ONE.values()))
    table = F.expr(f"str_to_map({sql_text(_TABLE)}, '\n', '\r')")

    def syllable(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        parts = [0x1100 + F.floor(n / 588), 0x1161 + F.floor(n % 588 / 28), 0x11A7 + n % 28]
        code = F.format_string("%04X%04X%04X", *(p.cast("int") for p in parts))
        return F.decode(F.unhex(F.when(n % 28 == 0, F.substring(code, 1, 8)).otherwise(code)), "UTF-16BE")

    each = lambda c: F.when(c.rlike(f"^[{_HANGUL}]$"), syllable(c)).otherwise(F.coalesce(F.element_at(table, c), c))
    whole = F.when(plain.rlike(f"[{_RANGES}{_HANGUL}]"), F.array_join(F.transform(F.split(plain, ""), each), "")).otherwise(plain)
    return F.when(x.rlike(r"[^\x00-\x7F]"), whole).otherwise(x)


def general(x: Column, digits: int, grouped: bool = False) -> Column:
    """A number as C's %g writes it with so many significant digits; thousands separated if asked for."""
    sci = F.format_string(f"%.{digits - 1}e", x)
    power = F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int")

    def fixed(p: Column) -> Column:
        text = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(F.lit(0), F.lit(digits - 1) - p).cast("string"), F.lit("f")), x)
        text = F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
        return group_digits(text) if grouped else text

    short = F.regexp_replace(sci, r"\.?0+e", "e")
    return F.when(x.isNull(), None).when(x == 0, "0").otherwise(let(power, lambda p: F.when((p >= -4) & (p < digits), fixed(p)).otherwise(short)))


def group_digits(text: Column) -> Column:
    """Separates thousands in the whole part of a plain decimal number."""
    whole, rest = F.regexp_extract(text, r"^([-+]?\d+)", 1), F.regexp_extract(text, r"^[-+]?\d+(.*)$", 1)
    return F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", ","), rest)
