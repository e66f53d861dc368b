"""Written figures as numbers with the precision that they claim."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import U, general, sql_first_hit, sql_map, sql_text, staged, word_pattern
from .vocab import CURRENCY, MAGNITUDES, NOT_A_UNIT, NUMBER, PER_SCALE, PERCENT, SYMBOL, UNIT_SYNONYMS, longest_first

_SCALES = longest_first(MAGNITUDES)
_FILLER = "|".join(NOT_A_UNIT)


def steps(value: str, unit: str, magnitude: str, context: str) -> list[tuple[str, str]]:
    """SQL steps from column names to struct(value, tolerance, unit, magnitude, raw), or null where there is no number."""
    currencies = [(word_pattern(t), CURRENCY[t]) for t in longest_first(CURRENCY)]
    shares = [(rf"(?<![a-z]){re.escape(t)}", PERCENT[t]) for t in longest_first(PERCENT)]
    edges = sql_text(U + r"^\s+|\s+$")
    # the first word that can be a unit
    own = sql_text(rf"(?<![a-z])(?!(?:{_FILLER})(?![a-z]))([a-z]{{1,24}})(?![a-z])")
    other = sql_text(rf"(?<![a-z])(?!(?:{_FILLER})(?![a-z]))[a-z]+")
    per = sql_text(U + PER_SCALE.format(scales="|".join(_SCALES)))
    factor = "coalesce(_q_share, 1.0D) * coalesce(element_at(" + sql_map({k: float(v) for k, v in MAGNITUDES.items()}) + ", _q_scale), 1.0D)"
    known = sql_map(UNIT_SYNONYMS)
    return [
        ("_q_raw", f"regexp_replace({value}, {edges}, '')"),
        ("_q_blob", f"lower(concat(_q_raw, ' ', coalesce({unit}, ''), ' ', coalesce({magnitude}, '')))"),
        ("_q_token", f"regexp_extract(_q_raw, {sql_text(U + NUMBER)}, 0)"),
        ("_q_plain", "regexp_replace(translate(_q_token, ', ', ''), '^[()]+|[()]+$', '')"),
        ("_q_sign", f"CASE WHEN regexp_replace(_q_token, {edges}, '') LIKE '(%)' THEN -1.0D ELSE 1.0D END"),
        ("_q_n", "_q_sign * try_cast(_q_plain AS DOUBLE)"),
        ("_q_half", "try_cast(concat('5e-', length(regexp_extract(_q_plain, '[.](.*)$', 1)) + 1) AS DOUBLE)"),
        ("_q_share", sql_first_hit("_q_blob", shares)),
        ("_q_word", f"regexp_extract(lower(concat_ws(' ', {unit}, {magnitude}, _q_raw)), {own}, 1)"),
        ("_q_one", "CASE WHEN length(_q_word) > 4 AND _q_word RLIKE 's$' AND NOT _q_word RLIKE '(ss|us|is)$' THEN left(_q_word, length(_q_word) - 1) ELSE _q_word END"),
        ("_q_own", f"nullif(coalesce(element_at({known}, _q_word), element_at({known}, _q_one), _q_one), '')"),
        ("_q_money", sql_first_hit("_q_blob", currencies)),
        ("_q_said", f"CASE WHEN coalesce({context}, '') <> '' AND lower({unit}) RLIKE '[a-z]' AND NOT lower({unit}) RLIKE {other} THEN lower({context}) END"),
        ("_q_unit", f"CASE WHEN _q_share IS NOT NULL THEN 'percent' ELSE coalesce(_q_money, _q_own, CASE WHEN _q_said IS NOT NULL THEN {sql_first_hit('_q_said', currencies)} END, 'count') END"),
        ("_q_free", f"CASE WHEN contains(_q_blob, 'per') THEN regexp_replace(_q_blob, {per}, ' ') ELSE _q_blob END"),
        ("_q_scale", f"CASE WHEN _q_share IS NULL THEN {sql_first_hit('_q_free', [(rf'{chr(92)}b{w}{chr(92)}b', w) for w in _SCALES])} END"),
        ("_q", f"CASE WHEN _q_n IS NOT NULL THEN named_struct('value', _q_n * {factor}, 'tolerance', _q_half * {factor}, 'unit', _q_unit, 'magnitude', _q_scale, 'raw', _q_raw) END"),
    ]


def with_number(df: DataFrame, out: str, value: str) -> DataFrame:
    """df with the number that with_quantity() finds in a text, before its scale: null where it finds none."""
    own = ("_q_raw", "_q_token", "_q_plain", "_q_sign", "_q_n")
    return staged(df, [s for s in steps(value, "''", "''", "''") if s[0] in own], out)


def with_quantity(df: DataFrame, out: str, value: str, unit: str, magnitude: str, context: str) -> DataFrame:
    """df with struct(value, tolerance, unit, magnitude, raw) as out, null where there is no number."""
    return staged(df, steps(value, unit, magnitude, context), out)


def symbol(unit: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in SYMBOL.items() for v in kv)), unit), F.lit(""))


def scale_of(magnitude: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in MAGNITUDES.items() for v in kv)), magnitude), F.lit(1.0))


def format_value(q: Column) -> Column:
    """A quantity for reading: 6.5%, ₹8,142 crore."""
    return (
        F.when(q["unit"] == "percent", F.concat(general(q["value"], 6), F.lit("%")))
        .when(q["magnitude"].isNotNull(), F.concat(symbol(q["unit"]), general(q["value"] / scale_of(q["magnitude"]), 10, True), F.lit(" "), q["magnitude"]))
        .otherwise(F.concat(symbol(q["unit"]), general(q["value"], 10, True)))
    )
