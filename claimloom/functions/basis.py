"""The basis of a claim: seven known dimensions, and whatever else was said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import U, let, sql_first_hit, sql_text, staged
from .vocab import ABSORBED, BASIS, DIMENSIONS, OPTIONAL


_SEPARATED = sql_text(r"[_\-]+")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(x, U + r"^\s+|\s+$", "")), U + r"[^\w]+", "_"), "^_+|_+$", "")


def _slug(x: str) -> str:
    inner = f"lower(regexp_replace({x}, {sql_text(U + r'^[\s]+|[\s]+$')}, ''))"
    return f"regexp_replace(regexp_replace({inner}, {sql_text(U + r'[^\w]+')}, '_'), '^_+|_+$', '')"


def steps(raw: str, context: str) -> list[tuple[str, str]]:
    """SQL steps from a map of strings as stated, and the sentence, to the known dimensions as a map.

    A stated value is looked up under its dimension, else under the first other dimension that knows it (where it gives way to what that
    dimension has itself), else kept as a slug. A dimension that is not stated is looked for in all values and the sentence."""
    vocabularies, all_ = list(BASIS), len(DIMENSIONS)
    plain = lambda x: f"lower(regexp_replace({x}, {_SEPARATED}, ' '))"
    stated = ", ".join(f"nullif(element_at(_b_raw, '{d}'), '')" for d in DIMENSIONS)
    found = [
        ("_b_raw", f"coalesce({raw}, CAST(map() AS MAP<STRING, STRING>))"),
        ("_b_stated", f"array({stated})"),
        ("_b_texts", f"concat(_b_stated, array(concat_ws(' ', map_values(_b_raw), coalesce({context}, ''))))"),
        # for each stated value, and for everything together, what every vocabulary finds in it
        ("_b_hits", f"transform(transform(_b_texts, x -> {plain('x')}), x -> CASE WHEN x IS NOT NULL THEN array({', '.join(sql_first_hit('x', BASIS[v]) for v in vocabularies)}) END)"),
        ("_b_first", "transform(_b_hits, h -> array_position(transform(h, x -> x IS NOT NULL), true) - 1)"),
    ]
    entries = []
    for i, d in enumerate(DIMENSIONS):
        own = vocabularies.index(d) if d in BASIS else None
        if own is None:
            entries.append(f"struct('{d}' AS key, CASE WHEN _b_first[{i}] < 0 THEN {_slug(f'_b_stated[{i}]')} END AS value)")
            continue
        direct = f"CASE WHEN _b_stated[{i}] IS NULL THEN _b_hits[{all_}][{own}] WHEN _b_hits[{i}][{own}] IS NOT NULL THEN _b_hits[{i}][{own}] WHEN _b_first[{i}] < 0 THEN {_slug(f'_b_stated[{i}]')} END"
        # what other dimensions were given but do not know, and this one does
        unknown = {e: f"_b_hits[{j}][{vocabularies.index(e)}] IS NULL AND " if e in BASIS else "" for j, e in enumerate(DIMENSIONS)}
        moved = [f"CASE WHEN {unknown[e]}_b_first[{j}] = {own} THEN _b_hits[{j}][{own}] END" for j, e in enumerate(DIMENSIONS) if j != i]
        entries.append(f"struct('{d}' AS key, coalesce({', '.join([direct, *moved])}) AS value)")
    rows = f"filter(array({', '.join(entries)}), e -> e.value IS NOT NULL)"
    return [*found, ("_b", f"map_from_entries({rows})")]


def with_basis(df: DataFrame, out: str, raw: str, context: str) -> DataFrame:
    """df with the known dimensions of a claim as a map."""
    return staged(df, steps(raw, context), out)


def leftover(raw: Column) -> Column:
    """What was stated outside the known dimensions, by slug."""
    other = F.map_filter(F.coalesce(raw, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(list(DIMENSIONS)) & (F.coalesce(v, F.lit("")) != ""))
    return F.transform_keys(other, lambda k, v: slug(k))


def infer_from_label(label: Column) -> Column:
    """Dimensions that words of a metric's label state; the first word of a dimension wins."""
    said = F.regexp_extract_all(F.lower(F.coalesce(label, F.lit(""))), F.lit("[a-z]+"), F.lit(0))

    def build(said: Column) -> Column:
        parts = []
        for d in dict.fromkeys(x for x, _ in ABSORBED.values()):
            of = {w: v for w, (x, v) in ABSORBED.items() if x == d}
            word = F.get(F.array_intersect(said, F.array(*map(F.lit, of))), F.lit(0))
            parts.append(F.struct(F.lit(d).alias("key"), F.element_at(F.create_map(*(F.lit(v) for kv in of.items() for v in kv)), word).alias("value")))
        return F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull()))

    return let(said, build)


def merged(known: Column, inferred: Column) -> Column:
    """Known dimensions, completed by inferred ones."""
    return F.map_concat(known, F.map_filter(inferred, lambda k, v: ~F.map_contains_key(known, k)))


def differing(a: Column, b: Column) -> dict[str, Column]:
    """For each dimension: do both state it, differently? Written out, so that it is compiled; a lambda over names would be interpreted for each pair."""
    return {d: F.element_at(a, d) != F.element_at(b, d) for d in DIMENSIONS}


def one_sided(a: Column, b: Column) -> dict[str, Column]:
    """For each dimension but the optional ones: does one side only state it?"""
    return {d: F.element_at(a, d).isNull() != F.element_at(b, d).isNull() for d in DIMENSIONS if d not in OPTIONAL}


def agreeing(a: Column, b: Column) -> dict[str, Column]:
    return {d: F.element_at(a, d) == F.element_at(b, d) for d in DIMENSIONS}


def named(tests: dict[str, Column]) -> Column:
    """The names of what holds, in order, with commas between; '' for none."""
    return F.concat_ws(", ", *(F.when(test, d) for d, test in tests.items()))
