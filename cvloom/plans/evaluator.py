"""Queries on the evaluation of candidates and on what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import ranking as K
from .registry import query, table
from .requests import asked

#: Requests against which all hits are evaluated: everything asked, remote work, few criteria, none.
REQUESTS = [
    (1, ["java", "docker", "power"], "senior java developer", "reggio emilia", "senior", "italian", True, "onsite"),
    (2, [], "data engineer", "milano", "", "", False, "remote"),
    (3, ["python"], "qa tester", "roma", "junior", "english", False, "unknown"),
    (4, [], "", "", "", "", False, "hybrid"),
]
SCHEMA = "request int, want_skills array<string>, want_role string, want_location string, want_seniority string, want_language string, want_availability boolean, work_mode string"


def compared(spark, d) -> DataFrame:
    """Every hit with its features under each request; some hits come without features or without one of them."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c)
    days = T.first_integer(F.col("availability"))
    h = table(spark, d, "hits").select("hit_id", T.clean_set(F.col("skills")).alias("own"), *map(low, ("role", "location", "seniority", "language")), days.alias("days"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"))
    r = h.crossJoin(F.broadcast(spark.createDataFrame(REQUESTS, SCHEMA)))  # four rows: a stated set of requests against all hits
    full = F.struct(
        K.skills(F.col("want_skills"), F.col("own")).alias("skills"), F.when(F.col("hit_id") % 10 != 1, K.role(F.col("want_role"), F.col("role"))).alias("role"), K.location(F.col("want_location"), F.col("location"), F.col("work_mode")).alias("location"),
        K.seniority(F.col("want_seniority"), F.col("seniority")).alias("seniority"), K.language(F.col("want_language"), F.col("language")).alias("language"), K.availability(F.col("want_availability"), F.col("days")).alias("availability"),
    )
    return r.withColumn("features", F.when(F.col("hit_id") % 10 != 0, full))


def _sql_words(c: str) -> str:
    w = f"list_filter(list_distinct(regexp_split_to_array({c}, '\\s+')), lambda x: x NOT IN ('', 'junior', 'mid', 'middle', 'senior', 'lead', 'principal', 'staff'))"
    return f"CASE WHEN list_contains({w}, 'qa') THEN list_distinct(list_concat({w}, ['quality', 'assurance'])) ELSE {w} END"


def _text(v) -> str:
    return "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)


_OWN = "list_sort(list_distinct(list_filter(list_transform(coalesce(skills, []), lambda x: lower(trim(x, ' '))), lambda x: x IS NOT NULL AND x <> '')))"
_LOW = ", ".join(f"lower(trim(coalesce({c}, ''), ' ')) AS {c}" for c in ("role", "location", "seniority", "language"))
_EVALUATED = f"""rq(request, ws, wr, wl, we, wg, wa, work_mode) AS (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in REQUESTS)}),
h AS (SELECT hit_id, {_OWN} AS own, {_LOW}, try_cast(nullif(regexp_extract(availability, '([0-9]+)', 1), '') AS INTEGER) AS days, coalesce(semantic_score, 0) AS ss FROM hits),
c AS (SELECT *, list_filter(ws, lambda r: list_contains(own, r)) AS exact, list_filter(ws, lambda r: NOT list_contains(own, r) AND len(list_filter(own, lambda o: contains(o, r) OR contains(r, o))) > 0) AS near, {_sql_words('wr')} AS aw, {_sql_words('role')} AS bw, hit_id % 10 = 0 AS no_features, hit_id % 10 = 1 AS no_role FROM h, rq),
f AS (SELECT *, len(ws) > 0 AS ns, wr <> '' AS nr, wl <> '' AND work_mode IN ('onsite', 'hybrid', 'unknown') AS nl, we <> '' AS ne, wg <> '' AS ng, wa AS na,
CASE WHEN len(ws) = 0 THEN 0.0 ELSE round((len(exact) + 0.7::DOUBLE * len(near)) / len(ws), 4) END::DOUBLE AS fs,
round(CASE WHEN wr = role THEN 1.0 WHEN contains(role, wr) OR contains(wr, role) THEN 0.8 ELSE len(list_intersect(aw, bw))::DOUBLE / greatest(1, len(aw)) END, 4)::DOUBLE AS fr,
(CASE WHEN work_mode = 'remote' THEN 1 WHEN location = '' THEN 0 WHEN location = wl THEN 1 WHEN contains(location, wl) OR contains(wl, location) THEN 0.6 WHEN len(list_intersect(list_filter(regexp_split_to_array(wl, '\\s+'), lambda x: x <> ''), list_filter(regexp_split_to_array(location, '\\s+'), lambda x: x <> ''))) > 0 THEN 0.35 ELSE 0 END)::DOUBLE AS fl,
(we = seniority)::INT::DOUBLE AS fe, (language <> '' AND (contains(language, wg) OR contains(wg, language)))::INT::DOUBLE AS fg, (CASE WHEN days IS NULL THEN 0 WHEN days <= 30 THEN 1 WHEN days <= 60 THEN 0.6 ELSE 0.2 END)::DOUBLE AS fa, CASE WHEN ss > 0 THEN ss / (1 + ss) ELSE 0.0 END AS fx FROM c),
g AS (SELECT *, CASE WHEN ns AND NOT no_features THEN fs ELSE 0.0 END AS s1, CASE WHEN nr AND NOT no_features AND NOT no_role THEN fr ELSE 0.0 END AS s2, CASE WHEN nl AND NOT no_features THEN fl ELSE 0.0 END AS s3, CASE WHEN ne AND NOT no_features THEN fe ELSE 0.0 END AS s4, CASE WHEN ng AND NOT no_features THEN fg ELSE 0.0 END AS s5, CASE WHEN na AND NOT no_features THEN fa ELSE 0.0 END AS s6,
0.5 * ns::INT + 0.25 * nr::INT + 0.1 * nl::INT + 0.05 * ne::INT + 0.05 * ng::INT + 0.05 * na::INT + 0.05 * (fx > 0)::INT AS total FROM f),
e AS (SELECT *, CASE WHEN total > 0 THEN round((0.5::DOUBLE * s1 + 0.25::DOUBLE * s2 + 0.1::DOUBLE * s3 + 0.05::DOUBLE * s4 + 0.05::DOUBLE * s5 + 0.05::DOUBLE * s6 + 0.05::DOUBLE * fx) / total::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS match_score, CASE WHEN no_features THEN 0 ELSE len(exact) + len(near) END AS matched FROM g)"""


def _sql_codes(*tests: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {c} END" for t, c in tests) + "]::VARCHAR[], lambda v: v IS NOT NULL)"


_REASONS = _sql_codes(("ns AND s1 >= 0.7", "'skills_high'"), ("ns AND s1 > 0 AND s1 < 0.7", "'skills_partial'"), ("ns AND s1 > 0 AND matched > 0", "'skills_covered:' || matched"), ("nr AND s2 >= 0.7", "'role_fits'"), ("nr AND s2 > 0 AND s2 < 0.7", "'role_partial'"), ("nl AND s3 >= 1", "'location_fits'"), ("fx >= 0.7", "'semantic_strong'"))
_WEAK = _sql_codes(("ns AND s1 > 0 AND s1 < 0.7", "'skills_partial'"), ("ns AND s1 = 0", "'skills_missing'"), ("nr AND s2 > 0 AND s2 < 0.7", "'role_partial'"), ("nr AND s2 = 0", "'role_missing'"), ("nl AND s3 < 1", "'location_differs'"))
_MISSING = _sql_codes(*[(f"n{k} AND s{n} = 0", f"'{d}'") for k, n, d in zip("srlega", range(1, 7), E.DIMENSIONS)])
_WARN = _sql_codes(*[(f"n{k} AND (no_features{' OR no_role' if k == 'r' else ''})", f"CASE WHEN no_features THEN 'features_missing:{d}' ELSE '{d}_missing' END") for k, d in zip("srlega", E.DIMENSIONS)])


@query(f"WITH {_EVALUATED} SELECT hit_id, request, match_score, CASE WHEN match_score >= 0.8 THEN 'strong' WHEN match_score >= 0.6 THEN 'good' ELSE 'weak' END AS match_type FROM e")
def match_score(spark, d):
    """Weighted score of every hit under each request; only dimensions that are asked for weigh, the place not for remote work."""
    return E.evaluated(compared(spark, d), 6).select("hit_id", "request", "match_score", "match_type")


@query(f"WITH {_EVALUATED}, l AS (SELECT hit_id, request, match_score, {_REASONS} AS r, {_WEAK} AS w, CASE WHEN ns AND s1 >= 0.7 THEN ['skills_high'] ELSE [] END AS s, {_MISSING} AS missing, {_WARN} AS warnings FROM e) SELECT hit_id, request, CASE WHEN len(r) = 0 THEN ['limited'] ELSE r END AS reasons, CASE WHEN len(s) = 0 AND match_score >= 0.7 THEN ['overall'] ELSE s END AS strengths, CASE WHEN len(w) = 0 AND match_score < 0.7 THEN ['partly_aligned'] ELSE w END AS weaknesses, missing, warnings FROM l")
def match_findings(spark, d):
    """Reasons, strengths, weaknesses, missing requirements and warnings of every hit under each request."""
    return E.evaluated(compared(spark, d), 6).select("hit_id", "request", "reasons", "strengths", "weaknesses", "missing", "warnings")


@query(f"WITH {_EVALUATED} SELECT hit_id, match_score FROM e WHERE request = 1 ORDER BY match_score DESC, hit_id LIMIT 3")
def best_candidates(spark, d):
    e = E.evaluated(compared(spark, d).where("request = 1"), 6).select("hit_id", "match_score")
    return e.orderBy(F.desc("match_score"), "hit_id").limit(3)


@query(f"""WITH {_EVALUATED}, k AS (SELECT *, {_MISSING} AS missing, row_number() OVER (PARTITION BY request ORDER BY match_score DESC, hit_id) AS rn FROM e), t AS (SELECT * FROM k WHERE rn <= 6)
SELECT request, count(*) AS candidates, list(hit_id::VARCHAR ORDER BY rn) FILTER (rn <= 3) AS best, CASE WHEN max(match_score) >= 0.8 THEN 'strong_match' WHEN max(match_score) >= 0.6 THEN 'partial_match' WHEN max(match_score) >= 0.4 THEN 'weak_match' ELSE 'no_match' END AS verdict,
round(least(1.0, 0.35 + 0.5 * max(match_score) + 0.03 * least(count(*), 5)), 4)::DOUBLE AS confidence, any_value(missing[1:3]) FILTER (rn = 1) AS gaps FROM t GROUP BY request""")
def judgement(spark, d):
    """Verdict, confidence, best three and gaps of each request over its six best hits."""
    e = E.evaluated(compared(spark, d), 6).select("request", "hit_id", "match_score", "missing")
    from pyspark.sql import Window

    top = e.withColumn("rn", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("match_score"), "hit_id"))).where("rn <= 6")
    return E.judged(top.withColumn("name", F.col("hit_id").cast("string")), ["request"], order="rn")


@query(f"WITH {_EVALUATED} SELECT hit_id, request, CASE WHEN s1 <= 0 THEN 'unknown' WHEN s1 >= 0.75 THEN 'high' WHEN s1 >= 0.45 THEN 'medium' ELSE 'low' END AS skills, CASE WHEN s3 <= 0 THEN 'unknown' WHEN s3 >= 0.75 THEN 'high' WHEN s3 >= 0.45 THEN 'medium' ELSE 'low' END AS location FROM e WHERE NOT no_features")
def coverage_level(spark, d):
    """How well skills and place are covered under each request."""
    e = compared(spark, d).where("features is not null")
    score = lambda k, on: E.coverage(F.when(on, F.col(f"features.{k}.score"))).alias(k)
    return e.select("hit_id", "request", score("skills", F.size("want_skills") > 0), score("location", (F.col("want_location") != "") & (F.col("work_mode") != "remote")))


_LEVEL = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} >= 4 THEN 'high' WHEN {0} >= 3 THEN 'medium' ELSE 'low' END"


@query(f"""WITH r AS (SELECT eval_id, query, nullif(trim(query, ' '), '') AS q, CASE WHEN candidates_count = 0 THEN 'invalid_input' WHEN final_score >= 4.5 THEN 'strong_match' WHEN final_score >= 4 THEN 'partial_match' WHEN final_score >= 3 THEN 'weak_match' ELSE 'no_match' END AS verdict, {_LEVEL.format('search_relevance')} AS cs, {_LEVEL.format('candidate_quality')} AS cl, {_LEVEL.format('field_completeness')} AS ce, eval_id % 2 = 0 AS relaxed,
list_filter(list_transform(string_split(classified_skills, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS skills, classified_role AS role, classified_location AS location, classified_work_mode AS work_mode FROM evaluations),
f AS (SELECT *, CASE WHEN verdict = 'invalid_input' THEN 'invalid_input' WHEN verdict NOT IN ('no_match', 'weak_match') THEN 'none' WHEN cs = 'low' THEN 'poor_skill_coverage' WHEN cl = 'low' THEN 'location_mismatch' WHEN ce = 'low' THEN 'seniority_mismatch' ELSE 'no_matches' END AS failure_type,
CASE WHEN verdict = 'invalid_input' THEN 'SAFE_REFUSAL' WHEN verdict NOT IN ('no_match', 'weak_match') THEN 'RETURN_ANSWER' WHEN NOT relaxed THEN 'RELAX_AND_RETRY' WHEN verdict = 'weak_match' THEN 'RETURN_PARTIAL_ANSWER' ELSE 'ASK_USER_CLARIFICATION' END AS strategy FROM r)
SELECT eval_id, failure_type, strategy, strategy = 'ASK_USER_CLARIFICATION' AS needs_clarification, {_sql_codes(("strategy = 'RELAX_AND_RETRY'", "'relax_and_retry'"), ("strategy = 'ASK_USER_CLARIFICATION'", "CASE failure_type WHEN 'poor_skill_coverage' THEN 'which_skills' WHEN 'location_mismatch' THEN 'on_site_or_remote' WHEN 'seniority_mismatch' THEN 'how_senior' ELSE 'more_detail' END"))} AS questions,
{_sql_codes(("strategy = 'RELAX_AND_RETRY' AND q IS NOT NULL", "q"), ("strategy = 'RELAX_AND_RETRY' AND len(skills) > 0 AND coalesce(q, '') <> array_to_string(skills[1:3], ' ')", "array_to_string(skills[1:3], ' ')"))} AS improved_queries,
{_sql_codes(("verdict <> 'invalid_input' AND coalesce(len(skills), 0) = 0", "'skills'"), ("verdict <> 'invalid_input' AND coalesce(role, '') = ''", "'role'"), ("verdict <> 'invalid_input' AND coalesce(location, '') = '' AND coalesce(work_mode, '') <> 'remote'", "'location'"))} AS missing_entities FROM f""")
def recovery_table(spark, d):
    """What to do next: failure, strategy, questions, better queries and missing entities, for the requests of the judged runs."""
    a = asked(spark, d).select("eval_id", "query", "skills", "role", "location", "work_mode")
    level = lambda c: F.when(F.col(c).isNull(), "unknown").when(F.col(c) >= 4, "high").when(F.col(c) >= 3, "medium").otherwise("low")
    s = F.col("final_score")
    verdict = F.when(F.col("candidates_count") == 0, "invalid_input").when(s >= 4.5, "strong_match").when(s >= 4, "partial_match").when(s >= 3, "weak_match").otherwise("no_match")
    r = table(spark, d, "evaluations").select(
        "eval_id", "query", F.lit(None).cast("string").alias("original"), F.filter(F.transform(F.split("classified_skills", ","), lambda x: F.trim(x)), lambda x: x != "").alias("skills"), F.col("classified_role").alias("role"), F.col("classified_location").alias("location"), F.col("classified_work_mode").alias("work_mode"),
        verdict.alias("verdict"), level("search_relevance").alias("coverage_skills"), level("candidate_quality").alias("coverage_location"), level("field_completeness").alias("coverage_seniority"), (F.col("eval_id") % 2 == 0).alias("relaxed"),
    )
    return E.recovery(r).select("eval_id", "failure_type", "strategy", "needs_clarification", "questions", "improved_queries", "missing_entities")


@query("""WITH g AS (SELECT eval_id, CASE eval_id % 4 WHEN 0 THEN ' Exact ' WHEN 1 THEN 'SOFT' WHEN 2 THEN 'nearby' WHEN 3 THEN 'not_requested' END AS m, final_score / 4 AS s, CASE WHEN eval_id % 5 = 0 THEN true WHEN eval_id % 5 = 1 THEN false END AS a FROM evaluations),
c AS (SELECT eval_id, CASE WHEN lower(trim(m, ' ')) IN ('exact', 'soft', 'weak', 'none', 'not_applicable', 'not_requested') THEN lower(trim(m, ' ')) ELSE 'none' END AS match, s, a FROM g)
SELECT eval_id, match, coalesce(a, match <> 'not_requested') AS applicable, CASE WHEN coalesce(a, match <> 'not_requested') THEN round(greatest(0, least(1, coalesce(s, 0))), 4) END::DOUBLE AS score FROM c""")
def feature_contract(spark, d):
    """Given features of the place brought into the contract's form: known matches, applicability by default, clamped scores."""
    k = F.col("eval_id") % 4
    m = F.when(k == 0, " Exact ").when(k == 1, "SOFT").when(k == 2, "nearby").otherwise("not_requested")
    on = F.when(F.col("eval_id") % 5 == 0, True).when(F.col("eval_id") % 5 == 1, False)
    return table(spark, d, "evaluations").select("eval_id", E.canonical("location", m, F.col("final_score") / 4, on).alias("f")).select("eval_id", "f.match", "f.applicable", "f.score")
