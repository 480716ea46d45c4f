"""Queries that turn untyped extractions into typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import domain as D
from ..operators import retrieval as R
from ..operators import store as S
from . import sql as Q
from .registry import query, table

TODAY = "2026-06-30"
_D = "CASE WHEN regexp_full_match(trim({0}, ' '), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(trim({0}, ' ') AS DATE) END"


def _b(c: str) -> str:
    return f"nullif({Q.strip(c)}, '')"


_CLEAN = "list_filter(list_transform(coalesce(skills, []), lambda s: {'name': lower(trim(coalesce(s.name, ''), ' ')), 'level': nullif(trim(s.level, ' '), '')}), lambda s: s.name <> '')"
_TYPED = f"""c AS (SELECT *, {_CLEAN} AS cs FROM llm_extraction_raw),
t AS (SELECT raw_id, document_id, extracted_at, {_b('name')} AS full_name, {_b('role')} AS role, {_b('location')} AS location, CASE WHEN regexp_matches(trim(email, ' '), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN lower(trim(email, ' ')) END AS email, coalesce(trim(email, ' ') <> '', false) AND NOT coalesce(regexp_matches(trim(email, ' '), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), false) AS bad_email, {_b('phone')} AS phone, {_b('language')} AS language, {_D.format('birth_date')} AS birth_date,
list_sort(list_filter(cs, lambda s, k: list_position(list_transform(cs, lambda x: x.name), s.name) = k)) AS skills, list_filter(list_transform(coalesce(education_titles, []), lambda x: trim(x, ' ')), lambda x: x <> '') AS education_titles, list_filter(list_transform(coalesce(certifications, []), lambda x: trim(x, ' ')), lambda x: x <> '') AS certifications,
list_transform(list_filter(coalesce(employment_dates, []), lambda x: coalesce(x.start_date, '') <> '' OR coalesce(x.end_date, '') <> ''), lambda x: {{'start_date': {_D.format('x.start_date')}, 'end_date': {_D.format('x.end_date')}}}) AS employment_dates FROM c),
y AS (SELECT *, nullif(round(coalesce(list_sum(list_transform(list_filter(employment_dates, lambda p: p.start_date IS NOT NULL), lambda p: greatest(0, date_diff('day', p.start_date, coalesce(p.end_date, DATE '{TODAY}'))) / 365.25)), 0), 1), 0)::DOUBLE AS experience_years, year(DATE '{TODAY}') - year(birth_date) - CASE WHEN '0630' < strftime(birth_date, '%m%d') THEN 1 ELSE 0 END AS yr FROM t),
ty AS (SELECT *, CASE WHEN yr >= 0 THEN yr END AS age, CASE WHEN experience_years IS NULL THEN NULL WHEN experience_years < 2 THEN 'junior' WHEN experience_years < 5 THEN 'mid' WHEN experience_years < 10 THEN 'senior' WHEN experience_years < 15 THEN 'lead' ELSE 'principal' END AS seniority FROM y)"""


def typed(spark, d):
    return D.typed(table(spark, d, "llm_extraction_raw"), F.lit(TODAY).cast("date"), ["raw_id", "document_id", "extracted_at"])


@query(f"WITH {_TYPED} SELECT raw_id, list_transform(skills, lambda s: s.name || '|' || coalesce(s.level, '')) AS names FROM ty")
def normalize_skills(spark, d):
    """Skills in lower case, once each, by name, with their levels."""
    return typed(spark, d).select("raw_id", F.transform("skills", lambda s: F.concat(s["name"], F.lit("|"), F.coalesce(s["level"], F.lit("")))).alias("names"))


@query(f"WITH {_TYPED} SELECT raw_id, experience_years AS years FROM ty")
def experience_years(spark, d):
    """Years of experience: the sum of the periods, overlaps counted each, an open end as today."""
    return typed(spark, d).select("raw_id", F.col("experience_years").alias("years"))


@query(f"WITH {_TYPED} SELECT raw_id, full_name, role, location, email, phone, language, birth_date, age::BIGINT AS age, experience_years, seniority, education_titles, certifications, list_transform(employment_dates, lambda p: coalesce(p.start_date::VARCHAR, '') || '/' || coalesce(p.end_date::VARCHAR, '')) AS periods FROM ty")
def to_domain(spark, d):
    """Typed and enriched rows of the raw extraction."""
    shown = F.transform("employment_dates", lambda p: F.concat(F.coalesce(p.start_date.cast("string"), F.lit("")), F.lit("/"), F.coalesce(p.end_date.cast("string"), F.lit(""))))
    return typed(spark, d).select("raw_id", "full_name", "role", "location", "email", "phone", "language", "birth_date", F.col("age").cast("bigint").alias("age"), "experience_years", "seniority", "education_titles", "certifications", shown.alias("periods"))


@query(f"WITH {_TYPED} SELECT raw_id FROM ty WHERE bad_email")
def email_quarantine(spark, d):
    """Rows whose e-mail is given but is none."""
    return typed(spark, d).where("bad_email").select("raw_id")


_DOC = "coalesce(nullif(trim(document_id, ' '), ''), id)"
_LAST = f"""la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY extracted_at DESC, raw_id DESC) AS rn FROM ty WHERE document_id IS NOT NULL) q WHERE rn = 1),
rg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC, version DESC, status, row_key, source_path) AS rn FROM registry) q WHERE rn = 1),
pr AS (SELECT {Q.strip(_DOC)} AS document_id, min_by({{'full_name': {_b('full_name')}, 'role': {_b('role')}, 'location': {_b('location')}, 'language': {_b('language')}, 'seniority': {_b('seniority')}, 'availability': availability}}, (-coalesce(score, 0), hit_id)) AS b FROM hits WHERE {_DOC} IS NOT NULL GROUP BY 1),
mg AS (SELECT rg.document_id, rg.source_path, rg.source_paths, rg.version, rg.hash, rg.processed_at, coalesce(la.full_name, b.full_name) AS full_name, coalesce(la.role, b.role) AS role, coalesce(la.location, b.location) AS location, coalesce(la.language, b.language) AS language, coalesce(la.seniority, b.seniority) AS seniority, b.availability AS availability, la.email, la.phone, la.birth_date, la.age, la.skills, la.certifications, la.education_titles, la.employment_dates, la.experience_years FROM rg LEFT JOIN la USING (document_id) LEFT JOIN pr USING (document_id))"""


def merged(spark, d):
    """Registered documents with their last extraction over what their best chunk says, field by field."""
    raw = typed(spark, d).where("document_id is not null")
    rest = [c for c in raw.columns if c not in ("raw_id", "document_id", "extracted_at")]
    last = raw.groupBy("document_id").agg(F.max_by(F.struct(*rest), F.struct("extracted_at", "raw_id")).alias("x"))
    order = [F.desc("loaded_at"), F.desc("version"), F.asc_nulls_last("status"), F.asc_nulls_last("row_key"), F.asc_nulls_last("source_path")]
    known = S.latest(table(spark, d, "registry"), ["document_id"], order).select("document_id", "source_path", "source_paths", "version", "hash", "processed_at")
    fields = ("full_name", "role", "location", "language", "seniority")
    from ..functions import text as T

    base = F.struct(*[T.blank_to_null(F.col(c)).alias(c) for c in fields], "availability")
    best = R.by_document(table(spark, d, "hits")).groupBy("doc").agg(F.max_by(base, F.struct(F.coalesce("score", F.lit(0.0)), -F.col("hit_id"))).alias("b")).withColumnRenamed("doc", "document_id")
    j = known.join(last, "document_id", "left").join(best, "document_id", "left")
    own = [F.col(f"x.{c}").alias(c) for c in ("email", "phone", "birth_date", "age", "skills", "certifications", "education_titles", "employment_dates", "experience_years")]
    return j.select(*known.columns, *[F.coalesce(F.col(f"x.{c}"), F.col(f"b.{c}")).alias(c) for c in fields], F.col("b.availability").alias("availability"), *own)


@query(f"WITH {_TYPED}, {_LAST} SELECT document_id, full_name, role, location, language, seniority, email, age::BIGINT AS age, experience_years FROM mg")
def apply_extraction(spark, d):
    """Metadata of registered documents after their extraction is merged in."""
    return merged(spark, d).select("document_id", "full_name", "role", "location", "language", "seniority", "email", F.col("age").cast("bigint").alias("age"), "experience_years")


def _y(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '''''' WHEN regexp_matches({c}, '[\\s:]') THEN '\"' || replace({c}, '\"', '\\\"') || '\"' ELSE {c} END"


def _scalar(k: str, c: str, pad: str = "") -> str:
    return f"['{pad}{k}: ' || {_y(f'({c})::VARCHAR')}]"


def _texts(k: str, c: str) -> str:
    return f"['{k}:'], list_transform(coalesce({c}, []), lambda s: '  - ' || {_y('s')})"


def _structs(k: str, c: str, a: str, b: str) -> str:
    return f"['{k}:'], list_transform(coalesce({c}, []), lambda s: '  - {a}: ' || {_y(f's.{a}::VARCHAR')} || chr(10) || '    {b}: ' || {_y(f's.{b}::VARCHAR')})"


_PATHS = "list_filter(string_split(coalesce(source_paths, ''), ';'), lambda x: x <> '')"
_KEYS = ", ".join(["['---']", _scalar("document_id", "document_id"), _texts("source_paths", _PATHS), *[_scalar(k, k) for k in ("version", "hash", "processed_at", "language")], "['candidate:']", *[_scalar(k, k, "  ") for k in ("full_name", "role", "location", "email", "phone", "birth_date", "age", "availability", "seniority")], _structs("skills", "skills", "name", "level"), _texts("certifications", "certifications"), _texts("education_titles", "education_titles"), "['languages_spoken:']", _scalar("experience_years", "experience_years"), _structs("employment_dates", "employment_dates", "start_date", "end_date"), "['images:']", _scalar("element_count", "0"), _scalar("image_count", "0"), "['metadata:', '  origin: ' || " + _y("coalesce(source_path, 'none')") + "]", "['---', '']"])


@query(f"WITH {_TYPED}, {_LAST} SELECT document_id, array_to_string(flatten([{_KEYS}]), chr(10)) AS front FROM mg")
def front_matter(spark, d):
    """Front matter of every registered document: 17 keys in order."""
    m = merged(spark, d).withColumn("source_paths", F.filter(F.split(F.coalesce("source_paths", F.lit("")), ";"), lambda x: x != ""))
    m = m.withColumn("languages_spoken", F.array().cast("array<struct<lang:string,level:string>>")).withColumn("images", F.array().cast("array<struct<blob_path:string,description:string>>"))
    m = m.withColumn("skills", F.coalesce("skills", F.array().cast(D.SKILLS))).withColumn("employment_dates", F.coalesce("employment_dates", F.array().cast("array<struct<start_date:date,end_date:date>>")))
    m = m.withColumn("element_count", F.lit(0)).withColumn("image_count", F.lit(0)).withColumn("metadata", F.create_map(F.lit("origin"), F.coalesce("source_path", F.lit("none"))))
    return m.select("document_id", D.front_matter().alias("front"))


@query(f"""WITH s AS (SELECT document_id, 0 AS rank, raw_id AS k, {_b('name')} AS full_name, {_b('role')} AS role, {_b('location')} AS location, {_b('language')} AS language FROM llm_extraction_raw UNION ALL SELECT document_id, 1, hit_id, {_b('full_name')}, {_b('role')}, {_b('location')}, {_b('language')} FROM hits UNION ALL SELECT document_id, 2, doc_id, NULL, NULL, NULL, {_b('lang')} FROM documents)
SELECT document_id, arg_min(full_name, (rank, k)) FILTER (full_name IS NOT NULL) AS full_name, arg_min(role, (rank, k)) FILTER (role IS NOT NULL) AS role, arg_min(location, (rank, k)) FILTER (location IS NOT NULL) AS location, arg_min(language, (rank, k)) FILTER (language IS NOT NULL) AS language FROM s WHERE document_id IS NOT NULL GROUP BY document_id""")
def structured_merge(spark, d):
    """First filled value of each field over extraction, chunks and documents, in this order."""
    raw = table(spark, d, "llm_extraction_raw").select("document_id", F.col("raw_id").alias("k"), F.col("name").alias("full_name"), "role", "location", "language")
    chunks = table(spark, d, "hits").select("document_id", F.col("hit_id").alias("k"), "full_name", "role", "location", "language")
    docs = table(spark, d, "documents").select("document_id", F.col("doc_id").alias("k"), F.col("lang").alias("language"))
    return D.first_of([s.where("document_id is not null") for s in (raw, chunks, docs)], "document_id", ["full_name", "role", "location", "language"])
