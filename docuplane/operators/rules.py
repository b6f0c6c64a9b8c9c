"""Ranking by rules instead of scores: words, typos, proximity, attribute, exactness, in that order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FAR = 8


def allowed_typos(term: str) -> int:
    """None below five letters, one below nine, then two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _typos(tokens: Column, term: str) -> Column:
    """The fewest typos with which the term stands among the tokens; null if it doesn't."""
    k = allowed_typos(term)
    if not k:
        return F.when(F.array_contains(tokens, term), 0)
    return F.array_min(F.filter(F.transform(tokens, lambda x: F.levenshtein(x, F.lit(term), k)), lambda n: n >= 0))


def _apart(tokens: Column, a: str, b: str) -> Column:
    """How far two terms stand apart at least, FAR if farther or missing."""
    at = lambda w: F.filter(F.transform(tokens, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    gaps = F.flatten(F.transform(at(a), lambda i: F.transform(at(b), lambda j: F.abs(i - j))))
    return F.least(F.coalesce(F.array_min(gaps), F.lit(FAR)), F.lit(FAR))


def rule_ranks(docs: DataFrame, terms: list[str], attributes: list[Column], key: str = "doc_id") -> DataFrame:
    """docs in which a term stands, with the figures of the rules; attributes are token arrays, the most important first.

    words: terms found, with typos if need be; typos: how many in all; proximity: how far neighbouring terms are apart in the best
    attribute; attribute: the first one with a term; exactness: terms found as they are. Order by rule_order().
    """
    best = [F.least(*[_typos(t, w) for t in attributes]) if len(attributes) > 1 else _typos(attributes[0], w) for w in terms]
    near = [F.least(*[_apart(t, a, b) for t in attributes]) if len(attributes) > 1 else _apart(attributes[0], a, b) for a, b in zip(terms, terms[1:])]
    add = lambda xs: reduce(Column.__add__, xs, F.lit(0))
    wanted = F.array(*[F.lit(w) for w in terms])
    place = F.coalesce(*[F.when(reduce(Column.__or__, [_typos(t, w).isNotNull() for w in terms]), F.lit(i)) for i, t in enumerate(attributes)])
    figures = docs.withColumns({
        "words": add([b.isNotNull().cast("int") for b in best]),
        "typos": add([F.coalesce(b, F.lit(0)) for b in best]),
        "proximity": add(near),
        "attribute": place,
        "exactness": F.size(F.array_intersect(wanted, F.flatten(F.array(*attributes)))),
    })
    return figures.where("words > 0")


def rule_order(key: str = "doc_id") -> list[Column]:
    return [F.desc("words"), F.asc("typos"), F.asc("proximity"), F.asc("attribute"), F.desc("exactness"), F.asc(key)]
