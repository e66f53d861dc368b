"""Written reporting periods as closed date intervals. Fiscal years run from April to March."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .base import U, sql_map, sql_text, staged

_NAMES = sql_map({n: i for i, m in enumerate(V.MONTHS, 1) for n in (m, m[:3])})
_COUNTS = sql_map({w: i for i, n in enumerate(V.NUMBER_WORDS, 1) for w in (n, str(i))})
_EDGES, _SPACES = sql_text(U + r"^\s+|\s+$"), sql_text(U + r"\s+")


def _squeezed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {_SPACES}, ' '), {_EDGES}, '')"


def _hit(s: str, pattern: str) -> str:
    return f"{s} RLIKE {sql_text(U + pattern)}"


def _word(s: str, pattern: str, group: int) -> str:
    return f"regexp_extract({s}, {sql_text(U + pattern)}, {group})"


def _int(s: str, pattern: str, group: int) -> str:
    return f"try_cast({_word(s, pattern, group)} AS INT)"


def _day(y: str, m: str | int, d: str | int) -> str:
    """A date, or null where the calendar has none."""
    return f"try_to_date(format_string('%04d-%02d-%02d', {y}, {m}, {d}), 'yyyy-MM-dd')"


def _span(start: str, end: str, grain: str, confidence: float = 1.0, note: str = "") -> str:
    return f"named_struct('start', {start}, 'end', {end}, 'grain', '{grain}', 'confidence', CAST({confidence} AS DOUBLE), 'note', '{note}')"


def _century(y: str) -> str:
    return f"(CASE WHEN {y} > 99 THEN {y} ELSE 2000 + {y} END)"


def _core(s: str) -> str:
    """SQL of the rules for years, months, days and unspaced quarters, in order; dates may be null."""
    month = lambda p, g: f"element_at({_NAMES}, {_word(s, p, g)})"
    fiscal = lambda end: _span(_day(f"{end} - 1", 4, 1), _day(end, 3, 31), "annual")
    instant = lambda d: _span(d, d, "instant")
    of_month = lambda y, m: _span(_day(y, m, 1), f"last_day({_day(y, m, 1)})", "monthly")
    i = lambda p, g: _int(s, p, g)
    cy = _century(i(V.CALENDAR_YEAR, 1))
    first = _day(i(V.YEAR_QUARTER, 1), f"3 * {i(V.YEAR_QUARTER, 2)} - 2", 1)
    rules = [
        (_hit(s, V.FISCAL_SPAN), fiscal(f"{i(V.FISCAL_SPAN, 1)} + 1")),
        (f"{_hit(s, V.YEAR_SPAN)} AND {i(V.YEAR_SPAN, 2)} = ({i(V.YEAR_SPAN, 1)} + 1) % 100", fiscal(f"{i(V.YEAR_SPAN, 1)} + 1")),
        (_hit(s, V.FISCAL_YEAR), fiscal(_century(i(V.FISCAL_YEAR, 1)))),
        (_hit(s, V.CALENDAR_YEAR), _span(_day(cy, 1, 1), _day(cy, 12, 31), "annual")),
        (_hit(s, V.YEAR_QUARTER), _span(first, f"last_day(add_months({first}, 2))", "quarterly", 0.55, "ambiguous: a quarter of a calendar or of a fiscal year; taken as calendar")),
        (_hit(s, V.YEAR_MONTH), of_month(i(V.YEAR_MONTH, 1), i(V.YEAR_MONTH, 2))),
        (_hit(s, V.ISO_DAY), instant(_day(i(V.ISO_DAY, 1), i(V.ISO_DAY, 2), i(V.ISO_DAY, 3)))),
        (f"{_hit(s, V.MONTH_DAY_YEAR)} AND {month(V.MONTH_DAY_YEAR, 1)} IS NOT NULL", instant(_day(i(V.MONTH_DAY_YEAR, 3), month(V.MONTH_DAY_YEAR, 1), i(V.MONTH_DAY_YEAR, 2)))),
        (f"{_hit(s, V.DAY_MONTH_YEAR)} AND {month(V.DAY_MONTH_YEAR, 2)} IS NOT NULL", instant(_day(i(V.DAY_MONTH_YEAR, 3), month(V.DAY_MONTH_YEAR, 2), i(V.DAY_MONTH_YEAR, 1)))),
        (f"{_hit(s, V.MONTH_OF_YEAR)} AND {month(V.MONTH_OF_YEAR, 1)} IS NOT NULL", of_month(i(V.MONTH_OF_YEAR, 2), month(V.MONTH_OF_YEAR, 1))),
        (_hit(s, V.YEAR_ALONE), _span(_day(i(V.YEAR_ALONE, 1), 1, 1), _day(i(V.YEAR_ALONE, 1), 12, 31), "annual", 0.7, "a year alone, taken as calendar year")),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN {then}" for test, then in rules) + " END"


def _ended(s: str) -> str:
    """SQL: the phrases "n months ended", "year ended" and "quarter ended" that s holds, as (months, grain, what follows)."""
    n = f"element_at({_COUNTS}, {_word(s, V.MONTHS_ENDED, 1)})"
    one = lambda n, grain, rest, test: f"CASE WHEN {test} THEN struct({n} AS n, {grain} AS grain, {_squeezed(rest)} AS rest) END"
    return (
        "filter(array("
        + ", ".join(
            [
                one(n, f"CASE {n} WHEN 3 THEN 'quarterly' WHEN 12 THEN 'annual' ELSE 'period' END", _word(s, V.MONTHS_ENDED, 2), f"{n} IS NOT NULL"),
                one("12", "'annual'", _word(s, V.YEAR_ENDED, 1), _hit(s, V.YEAR_ENDED)),
                one("3", "'quarterly'", _word(s, V.QUARTER_ENDED, 1), _hit(s, V.QUARTER_ENDED)),
            ]
        )
        + "), x -> x IS NOT NULL)"
    )


def periods(texts: DataFrame) -> DataFrame:
    """raw, period_of: struct(start, end, grain, confidence, note) for those of the distinct texts (raw) that name a period. An impossible
    date names none.

    A text is read in several ways: as what follows an "ended" phrase (in the order of the rules, outer phrases first, at any depth), and as a whole; each
    with its quarter taken out, then as it is. Every reading is a row of its own, so the rules are planned once; the first that gives dates counts."""
    plain = f"translate({_squeezed('lower(raw)')}, '\u2013\u2014\u2212', '---')"
    # phrases within each other are taken off from the outside, one level for each that there is; of the phrases around a reading the outermost
    # alone says where the period begins, so readings that agree in it and in what is left are one
    ended = f"transform({_ended('x.s')}, (y, k) -> struct(concat(x.at, k) AS at, CASE WHEN size(x.back) > 0 THEN x.back ELSE array(struct(y.n AS n, y.grain AS grain)) END AS back, y.rest AS s))"
    first = "filter(next, (e, i) -> NOT exists(slice(next, 1, i), f -> f.s = e.s AND f.back = e.back))"
    level = f"transform(array(flatten(transform(st.last, x -> {ended}))), next -> transform(array({first}), once -> struct(concat(st.every, once) AS every, once AS last))[0])[0]"
    steps = [
        ("_r0", f"array(struct('' AS at, CAST(array() AS ARRAY<STRUCT<n: INT, grain: STRING>>) AS back, {plain} AS s))"),
        ("_all", f"aggregate(array_repeat(0, regexp_count(_r0[0].s, 'ende')), struct(_r0 AS every, _r0 AS last), (st, i) -> {level}, st -> st.every)"),
    ]
    readings = staged(texts, steps, "_all").selectExpr("raw", "inline(_all) AS (_at, _back, _s)")
    quarter = f"coalesce({_int('_s', V.QUARTER, 1)}, element_at({sql_map(V.ORDINALS)}, {_word('_s', V.QUARTER, 2)}))"
    bare = f"CASE WHEN {_hit('_s', V.QUARTER)} THEN {_squeezed(f'regexp_replace(_s, {sql_text(U + r"^(.*?)" + V.QUARTER)}, {sql_text("$1 ")})')} END"
    # the place of an outer phrase ends with ~, so that what it holds inside comes before it
    read = readings.selectExpr("raw", "concat(_at, '~') AS _at", "_back", f"{quarter} AS _q", f"inline(array(struct(0 AS _whole, {bare} AS _t), struct(1 AS _whole, _s AS _t)))").where("_t IS NOT NULL")
    start = "add_months(" + _day("year(_p.end) - 1", 4, 1) + ", 3 * (_q - 1))"
    of_quarter = f"CASE WHEN _p.grain = 'annual' THEN {_span(start, f'last_day(add_months({start}, 2))', 'quarterly')} END"
    back = "aggregate(_back, _o, (p, x) -> named_struct('start', add_months(trunc(p.end, 'MM'), 1 - x.n), 'end', p.end, 'grain', x.grain, 'confidence', 1.0D, 'note', ''))"
    steps = [("_p", _core("_t")), ("_o", f"CASE WHEN _whole = 1 THEN _p ELSE {of_quarter} END"), ("_d", f"CASE WHEN _o.start IS NULL OR _o.end IS NULL THEN NULL WHEN size(_back) > 0 THEN {back} ELSE _o END")]
    read = staged(read, steps, "_d").where("_d IS NOT NULL")
    return read.groupBy("raw").agg(F.min(F.struct("_at", "_whole", "_d"))["_d"].alias("period_of"))


def with_period(df: DataFrame, out: str, period: str) -> DataFrame:
    """df with the period of a column. Each distinct text is read once, and what it means is joined back."""
    known = periods(df.select(F.col(period).alias("raw")).where("raw <> ''").distinct()).select(F.col("raw").alias("_raw"), F.col("period_of").alias(out))
    return df.join(known, F.col(period) == F.col("_raw"), "left").drop("_raw")


def relation(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """same, contains, contained_by, overlaps or disjoint, of closed intervals; null if one is missing."""
    return (
        F.when(a_start.isNull() | a_end.isNull() | b_start.isNull() | b_end.isNull(), None)
        .when((a_start == b_start) & (a_end == b_end), "same")
        .when((a_start <= b_start) & (a_end >= b_end), "contains")
        .when((b_start <= a_start) & (b_end >= a_end), "contained_by")
        .when((a_start <= b_end) & (b_start <= a_end), "overlaps")
        .otherwise("disjoint")
    )
