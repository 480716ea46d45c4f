"""How well a candidate matches a request: features by dimension, the contract of all of them, and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

# Words of seniority, which role similarity leaves out; words that an acronym stands for.
ROLE_NOISE = ["junior", "mid", "middle", "senior", "lead", "principal", "staff"]
QA = ["quality", "assurance"]
# Weights of the dimensions.
WEIGHTS = {"skills": 0.50, "role": 0.25, "location": 0.10, "seniority": 0.05, "language": 0.05, "availability": 0.05, "semantic": 0.05}


def skills(wanted: Column, own: Column) -> Column:
    """Struct (score, matched, semantic_matches): whole names count 1, names in one another 0.7."""
    exact = F.array_intersect(wanted, own)
    near = F.filter(F.array_except(wanted, own), lambda r: F.exists(own, lambda c: T.contains_either(c, r)))
    score = F.when(F.size(wanted) == 0, 0.0).otherwise((F.size(exact) + 0.7 * F.size(near)) / F.size(wanted))
    return F.struct(V.unit(score).alias("score"), F.array_sort(exact).alias("matched"), F.array_sort(near).alias("semantic_matches"))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def _role_words(c: Column) -> Column:
    w = F.array_except(_words(c), F.array(*map(F.lit, ROLE_NOISE)))
    return F.when(F.array_contains(w, "qa"), F.array_union(w, F.array(*map(F.lit, QA)))).otherwise(w)


def _feature(match: Column, score: Column, asked: Column) -> Column:
    return F.struct(asked.alias("applicable"), F.when(asked, V.unit(score)).alias("score"), F.when(asked, match).otherwise("not_requested").alias("match"))


def role(wanted: Column, own: Column) -> Column:
    a, b = _role_words(wanted), _role_words(own)
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))
    match = F.when(wanted == own, "exact").when(T.contains_either(own, wanted), "semantic").when(share >= 0.4, "semantic").when(share > 0, "partial").otherwise("none")
    score = F.when(wanted == own, 1.0).when(T.contains_either(own, wanted), 0.8).otherwise(share)
    return _feature(match, score, wanted != "")


def location(wanted: Column, own: Column, mode: Column) -> Column:
    overlap = F.size(F.array_intersect(_words(wanted), _words(own))) > 0
    steps = [(mode == "remote", "not_applicable", 1.0), (own == "", "none", 0.0), (wanted == own, "exact", 1.0), (T.contains_either(own, wanted), "soft", 0.6), (overlap, "weak", 0.35)]
    match, score = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for test, name, value in steps:
        match, score = match.when(test, name), score.when(test, value)
    return _feature(match.otherwise("none"), score.otherwise(0.0), wanted != "")


def language(wanted: Column, own: Column) -> Column:
    ok = (own != "") & T.contains_either(own, wanted)
    return _feature(F.when(ok, "true").otherwise("false"), F.when(ok, 1.0).otherwise(0.0), wanted != "")


def seniority(wanted: Column, own: Column) -> Column:
    return _feature(F.when(wanted == own, "exact").otherwise("none"), F.when(wanted == own, 1.0).otherwise(0.0), wanted != "")


def availability(required: Column, days: Column) -> Column:
    match = F.when(days.isNull(), "none").when(days <= 30, "exact").when(days <= 60, "partial").otherwise("weak")
    return _feature(match, V.availability_score(days), required)


def matched_on(features: dict[str, Column]) -> Column:
    """Dimensions with a positive score, in fixed order."""
    order = ("skills", "role", "location", "language", "seniority", "availability")
    return F.array_compact(F.array(*[F.when(features[k].score > 0, k) for k in order]))


def match_score(scores: dict[str, tuple[Column, Column]], places: int = 4) -> Column:
    """Weighted mean of the dimensions that apply; scores: dimension to (applies, score). A missing score counts 0."""
    total = sum(F.when(on, F.lit(WEIGHTS[k])).otherwise(0.0) for k, (on, _) in scores.items())
    got = sum(F.when(on, F.lit(WEIGHTS[k]) * F.coalesce(s, F.lit(0.0))).otherwise(0.0) for k, (on, s) in scores.items())
    return F.round(F.when(total > 0, got / F.round(total, 6)).otherwise(0.0), places)


def level(score: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """Name of the first step whose bound the score reaches."""
    out = F.when(F.lit(False), "")
    for bound, name in steps:
        out = out.when(score >= bound, name)
    return out.otherwise(other)
