"""Keys of entities and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import U, let, squeeze, strip, strip_accents, words
from .vocab import ABSORBED, DEICTIC, GENERIC, HONORIFICS, LEGAL_SUFFIXES, SPELLING, STOPWORDS


def entity_key(raw: Column) -> Column:
    """Accents, case, parentheses, punctuation, leading honorifics and trailing legal forms removed; '' for nothing."""
    s = F.regexp_replace(F.lower(strip_accents(F.coalesce(raw, F.lit("")))), r"\([^)]*\)", " ")
    s = squeeze(F.regexp_replace(s, U + r"[^\w\s&]", " "))

    def pop(s: Column) -> Column:
        left = F.regexp_replace(s, rf"^(?:(?:{'|'.join(HONORIFICS)})(?: |$))+", "")
        left = F.regexp_replace(left, rf"(?:(?:^| )(?:{'|'.join(LEGAL_SUFFIXES)}))+$", "")
        return F.coalesce(F.nullif(left, F.lit("")), s)

    return let(s, pop)


def is_resolvable(key: Column) -> Column:
    """Does the key name something in particular?"""
    tokens = F.split(key, " ")
    some = F.exists(tokens, lambda w: ~w.isin(GENERIC))
    return F.coalesce((F.length(key) >= 2) & ~key.isin(GENERIC) & ~F.get(tokens, F.lit(0)).isin(DEICTIC) & some, F.lit(False))


def same_entity(a: Column, b: Column) -> Column:
    """struct(same, reason): equal, or one key's words start the other's."""
    missing = F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin("")
    longer = a.startswith(F.concat(b, F.lit(" "))) | b.startswith(F.concat(a, F.lit(" ")))
    # a struct of two choices, not a choice of structs: who asks for the first alone does not word the second
    same = F.when(missing, False).when(a == b, True).when(longer, True).otherwise(False)
    reason = (
        F.when(missing, F.lit("no entity"))
        .when(a == b, F.concat(a, F.lit(" ≡ "), b))
        .when(longer, F.concat(a, F.lit(" ≡ "), b, F.lit(" (the longer name begins with the shorter)")))
        .otherwise(F.concat(a, F.lit(" ≠ "), b))
    )
    return F.struct(same.alias("same"), reason.alias("reason"))


def _fold_acronym(s: Column) -> Column:
    """The first parenthesis: initials of the words before it replace them, other short words stand in line, anything else goes."""
    pattern = r"(?s)^([^(]*)\(([^)]*)\)(.*)$"
    before, inside, after = (F.regexp_extract(s, pattern, i) for i in (1, 2, 3))

    def fold(x: Column) -> Column:
        acronym, n, w = F.regexp_replace(x["inside"], "[^a-z]", ""), F.length(F.regexp_replace(x["inside"], "[^a-z]", "")), x["words"]
        tail = F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n)
        initials = F.array_join(F.transform(tail, lambda t: F.substring(t, 1, 1)), "")
        kept = F.array_join(F.slice(w, 1, F.greatest(F.size(w) - n, F.lit(0))), " ")
        return (
            F.when(~n.between(2, 6), F.concat(x["before"], F.lit(" "), x["after"]))
            .when((F.size(w) >= n) & (initials == acronym), F.concat(kept, F.lit(" "), acronym, F.lit(" "), x["after"]))
            .otherwise(F.concat(x["before"], F.lit(" "), acronym, F.lit(" "), x["after"]))
        )

    parts = F.struct(before.alias("before"), inside.alias("inside"), after.alias("after"), words(before).alias("words"))
    return F.when(s.rlike(pattern), let(parts, fold)).otherwise(s)


def metric_key(label: Column) -> Column:
    """A slug of the label without fillers and without words that belong to the basis; '' for nothing, 'unknown' if nothing is left."""
    s = strip(F.lower(F.coalesce(label, F.lit(""))))
    # one parenthesis after the other, however many there are
    s = let(s, lambda x: F.aggregate(F.array_repeat(F.lit(0), F.regexp_count(x, F.lit(r"\([^)]*\)"))), x, lambda left, _: _fold_acronym(left)))
    for pattern, by in SPELLING:
        s = F.regexp_replace(s, U + pattern, by)
    left = F.filter(words(F.regexp_replace(s, U + r"[^\w\s]", " ")), lambda w: ~w.isin([*STOPWORDS, *ABSORBED]))
    slug = F.substring(F.array_join(left, "_"), 1, 120)
    return F.when(F.coalesce(label, F.lit("")) == "", "").otherwise(F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown")))


def tokens(key: Column) -> Column:
    return F.array_distinct(F.split(key, "_"))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two keys' words."""
    return F.size(F.array_intersect(tokens(a), tokens(b))).cast("double") / F.size(F.array_union(tokens(a), tokens(b)))


def near_miss(a: Column, b: Column) -> Column:
    """Worth a question: different keys that share a third of their words, or of which one's words contain the other's."""
    inside = (F.size(F.array_except(tokens(a), tokens(b))) == 0) | (F.size(F.array_except(tokens(b), tokens(a))) == 0)
    return F.coalesce((a != b) & (a != "") & (b != "") & ((overlap(a, b) >= 0.34) | inside), F.lit(False))


def same_metric(a: Column, b: Column, alias: Column) -> Column:
    """struct(same, reason); same is null where rules cannot settle it. alias: what is known about the two keys, or null."""
    missing = F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin("")
    shown = lambda o: F.format_string("%.2f", o)
    # words are compared only where equality and aliases leave it open
    share = lambda use: let(overlap(a, b), use)
    same = F.when(missing, False).when(a == b, True).when(alias.isNotNull(), alias).otherwise(share(lambda o: F.when(o == 0, False).when(o >= 0.8, True)))
    reason = (
        F.when(missing, F.lit("no metric"))
        .when(a == b, a)
        .when(alias.isNotNull(), F.concat(F.lit("alias: "), a, F.lit(" ~ "), b))
        .otherwise(
            share(
                lambda o: F.when(o == 0, F.concat(a, F.lit(" ≠ "), b))
                .when(o >= 0.8, F.concat(a, F.lit(" ≈ "), b, F.lit(" (shared words "), shown(o), F.lit(")")))
                .otherwise(F.concat(a, F.lit(" ? "), b, F.lit(" (shared words "), shown(o), F.lit("), to be asked")))
            )
        )
    )
    return F.struct(same.alias("same"), reason.alias("reason"))


