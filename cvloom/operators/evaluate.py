"""Evaluation of candidates against a request: weighted score, findings by dimension, verdict and what to do next.

Findings are stable codes; texts for people belong to the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking as K
from ..functions import text as T
from ..functions import values as V

# The matches that a feature may name, by dimension.
ALLOWED = {
    "role": ("exact", "semantic", "partial", "none", "not_requested"), "location": ("exact", "soft", "weak", "none", "not_applicable", "not_requested"), "language": ("true", "false", "not_requested"),
    "seniority": ("exact", "none", "not_requested"), "availability": ("exact", "partial", "weak", "none", "not_requested"),
}
DIMENSIONS = ("skills", "role", "location", "seniority", "language", "availability")
# Bounds of verdicts, of match types and of coverage.
VERDICTS = [(0.8, "strong_match"), (0.6, "partial_match"), (0.4, "weak_match")]
TYPES = [(0.8, "strong"), (0.6, "good")]
COVERAGE = [(0.75, "high"), (0.45, "medium")]


def canonical(dimension: str, match: Column, score: Column, applicable: Column) -> Column:
    """A given feature in the contract's form: a known match (else none), whether it applies, a score of four places."""
    m = F.lower(F.trim(match))
    fallback = "false" if dimension == "language" else "none"
    m = F.when(m.isin(*ALLOWED[dimension]), m).otherwise(fallback)
    on = F.coalesce(applicable, m != "not_requested")
    return F.struct(on.alias("applicable"), F.when(on, V.unit(score)).alias("score"), m.alias("match"))


def given_score(dimension: str, needed: Column) -> tuple[Column, Column]:
    """(score, warning) of a needed dimension from the column features; what is missing counts 0 and is told."""
    f = F.col("features")
    block = f[dimension]
    off = F.lit(False) if dimension == "skills" else ~block["applicable"]
    warning = F.when(~needed, None).when(f.isNull(), f"features_missing:{dimension}").when(block.isNull(), f"{dimension}_missing").when(off, f"{dimension}_not_applicable").when(block["score"].isNull(), f"{dimension}_score_missing")
    return F.when(needed & warning.isNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), block["score"]))).otherwise(0.0), warning


def _codes(*tests: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, code) for test, code in tests]))


def evaluated(rows: DataFrame, places: int = 4) -> DataFrame:
    """rows with match_score, match_type, reasons, strengths, weaknesses, missing and warnings.

    rows: features (struct of the dimensions, or null), semantic_score, and the request in want_skills, want_role,
    want_location, want_seniority, want_language (blank if not asked), want_availability and work_mode. A dimension that is
    not asked for has no weight; the place has none for remote work.
    """
    needed = {
        "skills": F.size("want_skills") > 0, "role": F.col("want_role") != "", "location": (F.col("want_location") != "") & F.col("work_mode").isin("onsite", "hybrid", "unknown"),
        "seniority": F.col("want_seniority") != "", "language": F.col("want_language") != "", "availability": F.col("want_availability"),
    }
    got = {k: given_score(k, on) for k, on in needed.items()}
    r = rows.select("*", *[on.alias(f"_on_{k}") for k, on in needed.items()], *[s.alias(f"_s_{k}") for k, (s, _) in got.items()], _codes(*[(w.isNotNull(), w) for _, w in got.values()]).alias("warnings"), V.saturation(F.greatest(F.lit(0.0), F.coalesce("semantic_score", F.lit(0.0)))).alias("_s_semantic"))
    on, s = {k: F.col(f"_on_{k}") for k in DIMENSIONS}, {k: F.col(f"_s_{k}") for k in (*DIMENSIONS, "semantic")}
    parts = {k: (on[k], s[k]) for k in DIMENSIONS} | {"semantic": (s["semantic"] > 0, s["semantic"])}
    r = r.withColumn("match_score", K.match_score(parts, places))
    matched = F.size(F.array_union(F.coalesce(F.col("features")["skills"]["matched"], F.array().cast("array<string>")), F.coalesce(F.col("features")["skills"]["semantic_matches"], F.array().cast("array<string>"))))
    high = lambda k: on[k] & (s[k] >= 0.7)
    some = lambda k: on[k] & (s[k] > 0) & (s[k] < 0.7)
    none = lambda k: on[k] & (s[k] == 0)
    place = on["location"] & (s["location"] >= 1.0)
    reasons = _codes((high("skills"), "skills_high"), (some("skills"), "skills_partial"), (on["skills"] & (s["skills"] > 0) & (matched > 0), F.concat(F.lit("skills_covered:"), matched)), (high("role"), "role_fits"), (some("role"), "role_partial"), (place, "location_fits"), (s["semantic"] >= 0.7, "semantic_strong"))
    strengths = _codes((high("skills"), "skills_high"))
    weaknesses = _codes((some("skills"), "skills_partial"), (none("skills"), "skills_missing"), (some("role"), "role_partial"), (none("role"), "role_missing"), (on["location"] & ~place, "location_differs"))
    score = F.col("match_score")
    or_else = lambda codes, test, code: F.when((F.size(codes) == 0) & test, F.array(F.lit(code))).otherwise(codes)
    r = r.select(
        "*", K.level(score, TYPES, "weak").alias("match_type"), or_else(reasons, F.lit(True), "limited").alias("reasons"), or_else(strengths, score >= 0.7, "overall").alias("strengths"),
        or_else(weaknesses, score < 0.7, "partly_aligned").alias("weaknesses"), _codes(*[(none(k), k) for k in DIMENSIONS]).alias("missing"),
    )
    return r.drop(*[c for c in r.columns if c.startswith("_on_") or c.startswith("_s_")])


def judged(evaluations: DataFrame, keys: list[str], name: str = "name", order: str = "place") -> DataFrame:
    """One row per request: verdict, confidence, best names, gaps and number of its candidates, by max_by over structs.

    A request without candidates is no row here; see verdict().
    """
    best = F.max_by(F.struct("match_score", "missing"), F.struct("match_score", (-F.col(order)).alias("o")))
    first = F.slice(F.sort_array(F.collect_list(F.struct("match_score", (-F.col(order)).alias("o"), F.col(name).alias("n"))), asc=False), 1, 3)  # the candidates of an answer, six at most
    g = evaluations.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("candidates"), F.transform(first, lambda x: x.n).alias("best"))
    return g.select(*keys, "candidates", "best", verdict(F.col("b.match_score"), F.col("candidates")).alias("verdict"), confidence(F.col("b.match_score"), F.col("candidates")).alias("confidence"), F.slice("b.missing", 1, 3).alias("gaps"))


def verdict(score: Column, candidates: Column) -> Column:
    return F.when(F.coalesce(candidates, F.lit(0)) == 0, "invalid_input").otherwise(K.level(score, VERDICTS, "no_match"))


def confidence(score: Column, candidates: Column) -> Column:
    sure = F.round(F.least(F.lit(1.0), 0.35 + 0.5 * score + 0.03 * F.least(candidates, F.lit(5))), 4)
    return F.when(F.coalesce(candidates, F.lit(0)) == 0, 0.1).otherwise(sure)


def coverage(score: Column) -> Column:
    return F.when(F.coalesce(score, F.lit(0.0)) <= 0, "unknown").otherwise(K.level(score, COVERAGE, "low"))


def recovery(rows: DataFrame) -> DataFrame:
    """rows with failure_type, strategy, needs_clarification, questions, improved_queries and missing_entities.

    rows: verdict, coverage_skills, coverage_location, coverage_seniority, relaxed (criteria relaxed before), and the request
    in query, skills, role, location, work_mode and original. Invalid input is refused and lists nothing.
    """
    bad, failed, weak = F.col("verdict") == "invalid_input", F.col("verdict").isin("no_match", "weak_match"), F.col("verdict") == "weak_match"
    cause = F.when(F.col("coverage_skills") == "low", "poor_skill_coverage").when(F.col("coverage_location") == "low", "location_mismatch").when(F.col("coverage_seniority") == "low", "seniority_mismatch").otherwise("no_matches")
    step = F.when(~F.col("relaxed"), "RELAX_AND_RETRY").when(weak, "RETURN_PARTIAL_ANSWER").otherwise("ASK_USER_CLARIFICATION")
    r = rows.withColumn("failure_type", F.when(bad, "invalid_input").when(failed, cause).otherwise("none")).withColumn("strategy", F.when(bad, "SAFE_REFUSAL").when(failed, step).otherwise("RETURN_ANSWER"))
    ask, again = F.col("strategy") == "ASK_USER_CLARIFICATION", F.col("strategy") == "RELAX_AND_RETRY"
    question = F.when(F.col("failure_type") == "poor_skill_coverage", "which_skills").when(F.col("failure_type") == "location_mismatch", "on_site_or_remote").when(F.col("failure_type") == "seniority_mismatch", "how_senior").otherwise("more_detail")
    skills = F.coalesce("skills", F.array().cast("array<string>"))
    base = F.coalesce(*[F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("query", "role", "original")])
    tries = F.array_distinct(_codes((again & (T.strip(base) != ""), T.strip(base)), (again & (F.size(skills) > 0), F.array_join(F.slice(skills, 1, 3), " "))))
    void = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lacking = _codes((~bad & (F.size(skills) == 0), "skills"), (~bad & void("role"), "role"), (~bad & void("location") & (F.coalesce("work_mode", F.lit("")) != "remote"), "location"))
    return r.select("*", ask.alias("needs_clarification"), _codes((again, "relax_and_retry"), (ask, question)).alias("questions"), tries.alias("improved_queries"), lacking.alias("missing_entities"))
