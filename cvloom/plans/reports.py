"""Queries on serialised rows, merged structures, metrics and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as S
from .registry import query, table


@query("""SELECT match_key, full_name, age, CASE WHEN updated_at IS NOT NULL THEN strftime(updated_at, '%Y-%m-%dT%H:%M:%S') END AS updated, CASE WHEN json_valid(payload_json) THEN len(payload_json->'$.skills[*]') END AS payload_skills, CASE WHEN json_valid(payload_json) THEN payload_json->>'$.skills[0]' END AS first_skill, payload_json IS NOT NULL AND NOT json_valid(payload_json) AS broken FROM candidates""")
def serialise_rows(spark, d):
    """Rows ready to be sent: ISO times and the payload read; a payload that is no JSON is null and told."""
    c = table(spark, d, "candidates")
    good, p = F.try_parse_json("payload_json").isNotNull(), F.from_json("payload_json", "skills ARRAY<STRING>")
    return c.select("match_key", "full_name", "age", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated"), F.when(good, F.coalesce(F.size(p.skills), F.lit(0))).cast("bigint").alias("payload_skills"), F.when(good, F.get(p.skills, F.lit(0))).alias("first_skill"), (F.col("payload_json").isNotNull() & ~good).alias("broken"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, median(value) AS middle, max(value) AS most FROM events GROUP BY event_type""")
def duration_metrics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("middle"), F.max("value").alias("most"))


@query("""SELECT eval_id, agent_error FROM evaluations WHERE regexp_matches(agent_error, '(?i)error|exception|traceback')""")
def log_errors(spark, d):
    lines = table(spark, d, "evaluations").select("eval_id", F.col("agent_error").alias("value"))
    return S.error_lines(lines).withColumnRenamed("value", "agent_error")


@query("""WITH c AS (SELECT value, EXISTS (SELECT 1 FROM evaluations e WHERE lower(e.query) LIKE '%' || lower(c.value) || '%') AS covered FROM canonical_values c) SELECT covered, count(*) AS n, string_agg(value, ';' ORDER BY value COLLATE C) AS names FROM c GROUP BY covered""")
def coverage_counts(spark, d):
    """Values of the list that some request names, and those that none does. The requests are scanned once."""
    names = table(spark, d, "canonical_values").select("value")
    known = names.agg(F.collect_list("value").alias("values"))  # a fixed small list
    said = table(spark, d, "evaluations").where("query is not null").select(F.lower("query").alias("q")).crossJoin(F.broadcast(known))
    seen = said.select(F.explode(F.filter("values", lambda v: F.contains(F.col("q"), F.lower(v)))).alias("value")).distinct().withColumn("covered", F.lit(True))
    c = names.join(seen, "value", "left").select("value", F.coalesce("covered", F.lit(False)).alias("covered"))
    return c.groupBy("covered").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("value")), ";").alias("names"))


@query("""SELECT hit_id, coalesce(nullif(concat_ws(' ', nullif(trim(role, ' '), ''), nullif(array_to_string(list_filter(coalesce(skills, []), lambda s: s IS NOT NULL), ' '), '')), ''), '*') AS q FROM hits""")
def lexical_query(spark, d):
    """Lexical query of a request: role and skills, else everything."""
    skills = F.nullif(F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " "), F.lit(""))
    return table(spark, d, "hits").select("hit_id", F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(F.trim("role"), F.lit("")), skills), F.lit("")), F.lit("*")).alias("q"))


@query("""SELECT doc_id, CASE WHEN text LIKE '---\n%' THEN regexp_extract(text, '(?m)^language: (.*)$', 1) END AS declared FROM documents WHERE text IS NOT NULL""")
def front_matter_field(spark, d):
    """Language that a document's front matter declares."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.when(F.col("text").startswith("---\n"), F.regexp_extract("text", r"(?m)^language: (.*)$", 1)).alias("declared"))


@query("""SELECT language, seniority, count(*) AS n FROM hits GROUP BY CUBE (language, seniority)""")
def facets(spark, d):
    """Counts by the facets of the index, each alone and together."""
    return table(spark, d, "hits").cube("language", "seniority").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, regexp_replace('/markdown/' || document_id || '/', '^/+|/+$', '', 'g') || '/' || regexp_replace('/v' || coalesce(version, 1) || '.md', '^/+', '') AS blob FROM documents WHERE document_id IS NOT NULL""")
def blob_paths(spark, d):
    """Where the markdown of each document's version is stored."""
    p = table(spark, d, "documents").where("document_id is not null")
    return p.select("doc_id", T.blob_path(F.concat(F.lit("/markdown/"), "document_id", F.lit("/")), F.concat(F.lit("/v"), F.coalesce("version", F.lit(1)), F.lit(".md"))).alias("blob"))


@query("""SELECT eval_id, left(sha256(coalesce(query, '') || coalesce(title, '')), 12) AS signature FROM evaluations""")
def cache_signature(spark, d):
    """Signature of prompt and form under which an extraction is kept."""
    return table(spark, d, "evaluations").select("eval_id", T.signature(F.coalesce("query", F.lit("")), F.coalesce("title", F.lit(""))).alias("signature"))


@query("""SELECT eval_id, CASE WHEN final_score IS NULL THEN 'grey' WHEN final_score >= 4 THEN 'green' WHEN final_score >= 3 THEN 'yellow' ELSE 'red' END AS colour FROM evaluations""")
def report_colours(spark, d):
    """Colour of each run's score in the spreadsheet."""
    return table(spark, d, "evaluations").select("eval_id", S.score_colour(F.col("final_score")).alias("colour"))


@query("SELECT " + ", ".join(f"{c}" for c in S.REPORT) + " FROM evaluations")
def report_table(spark, d):
    """The evaluation report: 37 columns in order."""
    return S.report_rows(table(spark, d, "evaluations"))


@query("""SELECT message_id, source_path FROM queue_messages WHERE source_path IS NOT NULL ORDER BY enqueued_at DESC, message_id LIMIT 20""")
def recent_blobs(spark, d):
    """The twenty files named last."""
    m = table(spark, d, "queue_messages").where("source_path is not null").select("message_id", F.col("source_path"), "enqueued_at")
    return m.orderBy(F.desc("enqueued_at"), "message_id").limit(20).select("message_id", "source_path")
