"""Queries on search requests: normal form, checks, routes and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import request as Q
from .registry import query, table
from .text import _L, _M, _R, _sql_number

TODAY = "2026-06-30"

_ASKED = "SELECT eval_id, query, string_split(classified_skills, ',') AS skills, classified_role AS role, classified_location AS location, classified_work_mode AS work_mode, classified_seniority AS seniority, classified_language AS language, candidates_count AS top, CASE eval_id % 5 WHEN 0 THEN '3' WHEN 1 THEN 'many' END AS min_experience_years, CASE eval_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN 'entro lunedi' WHEN 3 THEN ' ' END AS availability FROM evaluations"
_TRIM = "nullif(trim({0}, ' '), '')"
_NORMAL = f"""a AS ({_ASKED}), t AS (SELECT *, lower(coalesce({_TRIM.format('query')}, '')) AS q, try_cast(min_experience_years AS DOUBLE) AS given FROM a),
y AS (SELECT *, coalesce(given, {_sql_number(_R[0], 1)}, {_sql_number(_R[1], 1)}, {', '.join(_sql_number(p, 1) for p in _L)}) AS lo, CASE WHEN coalesce({_sql_number(_R[0], 1)}, {_sql_number(_R[1], 1)}) IS NOT NULL THEN coalesce({_sql_number(_R[0], 2)}, {_sql_number(_R[1], 2)}) ELSE coalesce({', '.join(_sql_number(p, 1) for p in _M)}) END AS hi FROM t),
n AS (SELECT eval_id, coalesce({_TRIM.format('query')}, '') AS query, list_sort(list_distinct(list_filter(list_transform(coalesce(skills, []), lambda x: lower(trim(x, ' '))), lambda x: x IS NOT NULL AND x <> ''))) AS skills, {_TRIM.format('role')} AS role, {_TRIM.format('location')} AS location,
CASE WHEN lower(trim(work_mode, ' ')) IN ('remote', 'hybrid', 'onsite', 'unknown') THEN lower(trim(work_mode, ' ')) ELSE 'unknown' END AS work_mode, {_TRIM.format('language')} AS language, greatest(1, least(100, CASE WHEN coalesce(top, 0) = 0 THEN 10 ELSE top END)) AS top, lo AS min_years, hi AS max_years,
coalesce(lower({_TRIM.format('seniority')}), CASE WHEN lo IS NULL THEN NULL WHEN lo < 2 THEN 'junior' WHEN lo < 5 THEN 'mid' WHEN lo < 10 THEN 'senior' WHEN lo < 15 THEN 'lead' ELSE 'principal' END) AS seniority, ({_TRIM.format('seniority')} IS NULL AND lo IS NOT NULL) AS seniority_inferred, coalesce(lower(trim(availability, ' ')) NOT IN ('', '0', 'false', 'none', 'null'), false) AS availability_required FROM y)"""


def asked(spark, d):
    """Requests as the interpreter of the judged runs read them, with some loose values among them."""
    k, m = F.col("eval_id") % 5, F.col("eval_id") % 7
    e = table(spark, d, "evaluations")
    return e.select(
        "eval_id", "query", F.split("classified_skills", ",").alias("skills"), F.col("classified_role").alias("role"), F.col("classified_location").alias("location"), F.col("classified_work_mode").alias("work_mode"), F.col("classified_seniority").alias("seniority"), F.col("classified_language").alias("language"),
        F.col("candidates_count").cast("string").alias("top"), F.when(k == 0, "3").when(k == 1, "many").alias("min_experience_years"), F.when(m == 0, "true").when(m == 1, "0").when(m == 2, "entro lunedi").when(m == 3, " ").alias("availability"),
    )


@query(f"WITH {_NORMAL} SELECT * FROM n")
def normalise_request(spark, d):
    """Requests in normal form: all rules of the normaliser."""
    n = Q.normalised(asked(spark, d), ["eval_id"])
    return n.select("eval_id", "query", "skills", "role", "location", "work_mode", "language", "top", F.col("min_experience_years").alias("min_years"), F.col("max_experience_years").alias("max_years"), "seniority", "seniority_inferred", "availability_required")


@query(f"WITH {_NORMAL} SELECT eval_id FROM n WHERE (query = '' OR eval_id % 3 = 0) AND len(skills) = 0 AND role IS NULL")
def request_rejects(spark, d):
    """Requests that name neither query nor skills nor role; every third comes with a blank query."""
    r = asked(spark, d).withColumn("query", F.when(F.col("eval_id") % 3 == 0, " ").otherwise(F.col("query")))
    return Q.normalised(r, ["eval_id"]).where(~Q.answerable()).select("eval_id")


@query(f"WITH {_NORMAL} SELECT eval_id, coalesce(nullif(concat_ws(' ', role, nullif(array_to_string(skills, ' '), '')), ''), nullif(query, ''), '*') AS words FROM n")
def request_words(spark, d):
    """Words that the lexical pass of a request looks for."""
    return Q.normalised(asked(spark, d), ["eval_id"]).select("eval_id", Q.lexical_query().alias("words"))


@query(f"""SELECT eval_id, CASE WHEN eval_id % 3 = 0 THEN '[1, 2]' WHEN eval_id % 3 = 1 THEN NULL END IS NULL AND eval_id % 3 = 2 AS read_from_body, CASE WHEN eval_id % 3 = 2 THEN query ELSE 'from the address' END AS query, CASE WHEN eval_id % 3 = 2 THEN string_split(classified_skills, ',') ELSE ['java', 'sql'] END AS skills FROM evaluations WHERE query IS NOT NULL AND classified_skills IS NOT NULL""")
def request_body(spark, d):
    """Requests from the parameters of an address, else from a JSON body; a body that is no object is empty."""
    e, k = table(spark, d, "evaluations").where("query is not null and classified_skills is not null"), F.col("eval_id") % 3
    json = F.when(k == 0, "[1, 2]").when(k == 2, F.to_json(F.struct("query", F.split("classified_skills", ",").alias("skills"))))
    address = F.when(k != 2, F.create_map(F.lit("query"), F.lit("from the address"), F.lit("skills"), F.lit("java,sql"))).otherwise(F.create_map().cast("map<string,string>"))
    b = e.select("eval_id", (k == 2).alias("read_from_body"), Q.merged_body(address, json).alias("b"))
    return b.select("eval_id", "read_from_body", "b.query", "b.skills")


_MOMENT = "try_cast(CASE WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN t || 'T00:00:00+00:00' WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,6})?)?') THEN t || '+00:00' WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,6})?)?[+-][0-9]{2}:?[0-9]{2}') THEN t END AS TIMESTAMPTZ)"
_ISO = "regexp_replace(regexp_replace(trim({0}, ' '), ' ([0-9]{{2}}:)', 'T\\1'), 'Z$', '+00:00')"


@query(f"""WITH h AS (SELECT hit_id, CASE WHEN hit_id % 4 = 0 THEN try_cast(nullif(regexp_extract(availability, '([0-9]+)', 1), '') AS INTEGER) END AS days, {_ISO.format('processed_at')} AS t FROM hits),
m AS (SELECT hit_id, days, {_MOMENT} AS mt FROM h) SELECT hit_id, coalesce(days, greatest(0, date_diff('day', DATE '2026-01-01', (mt AT TIME ZONE 'UTC')::DATE)))::INTEGER AS wanted FROM m""")
def wanted_days(spark, d):
    """Days within which somebody must be free, from a number or from a date in any ISO notation."""
    h = table(spark, d, "hits")
    days = F.when(F.col("hit_id") % 4 == 0, T.first_integer(F.col("availability")))
    return h.select("hit_id", Q.wanted_days(days, F.col("processed_at"), F.lit("2026-01-01").cast("date")).alias("wanted"))


@query(f"""WITH h AS (SELECT hit_id, {_ISO.format('processed_at')} AS t FROM hits), m AS (SELECT hit_id, {_MOMENT} AS mt FROM h) SELECT hit_id, CASE WHEN mt IS NULL THEN 0.0 WHEN floor((epoch(TIMESTAMPTZ '{TODAY} 00:00:00+00') - floor(epoch(mt))) / 86400) <= 180 THEN 0.02 ELSE 0.0 END::DOUBLE AS boost FROM m""")
def recency_boost_text(spark, d):
    """Boost of hits by their processing time as it is written: any ISO notation, without zone as UTC."""
    from ..functions import values as V

    return table(spark, d, "hits").select("hit_id", V.recency_boost(Q.moment(F.col("processed_at")), F.lit(TODAY).cast("timestamp")).alias("boost"))


@query("""SELECT eval_id, '{"success":' || CASE WHEN coalesce(agent_error, '') = '' THEN 'true' ELSE 'false' END || ',"data":' || CASE WHEN coalesce(agent_error, '') = '' THEN '{"total":' || coalesce(candidates_count::VARCHAR, 'null') || '}' ELSE 'null' END || ',"error":' || coalesce(to_json(nullif(agent_error, ''))::VARCHAR, 'null') || ',"request_id":"r-' || eval_id || '"}' AS answer FROM evaluations""")
def answer_envelope(spark, d):
    """Answers of the runs in the envelope of success, data, error and request."""
    data, error = F.struct(F.col("candidates_count").alias("total")), F.nullif(F.col("agent_error"), F.lit(""))
    return table(spark, d, "evaluations").select("eval_id", Q.envelope(data, error, F.concat(F.lit("r-"), F.col("eval_id"))).alias("answer"))


@query()
def evaluation_set(spark, d):
    """The literal set of requests of the evaluation, in order."""
    rows = [(k, *r) for k, r in enumerate(Q.evaluation_requests(), 1)]
    return spark.createDataFrame(rows, "number int, title string, query string")
