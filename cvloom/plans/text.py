"""Queries on scalar text and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U
from ..functions import values as V
from .registry import query, table

NOW = "2026-06-30"
STRIP = "regexp_replace({0}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


_ABBREVIATED = "regexp_replace({0}, '([A-Z]) \\. ([A-Z])([^a-zA-Z]|$)', '\\1.\\2\\3', 'g')"


@query(f"""SELECT hit_id, left(trim(regexp_replace(regexp_replace({_ABBREVIATED.format(_ABBREVIATED.format("replace(content, chr(0), '')"))}, '[ \t]+', ' ', 'g'), '\n{{3,}}', '\n\n', 'g'), ' \n\r\t'), 25000) AS cleaned FROM hits WHERE content IS NOT NULL""")
def clean_text(spark, d):
    """Cleaned contents, spaced abbreviations joined (the SQL does that twice for lack of look-around)."""
    h = table(spark, d, "hits").where("content is not null")
    return h.select("hit_id", T.clean_text(F.col("content")).alias("cleaned"))


@query("""SELECT hit_id, trim(regexp_replace(content, '[\\s\\x{0b}\\x{85}\\p{Z}]+', ' ', 'g'), ' ') AS cleaned FROM hits WHERE content IS NOT NULL""")
def clean_inline(spark, d):
    return table(spark, d, "hits").where("content is not null").select("hit_id", T.clean_inline(F.col("content")).alias("cleaned"))


@query("""SELECT hit_id, trim(regexp_replace(regexp_replace('<p>' || content || '</p><br/>', '<[^>]+>', ' ', 'g'), '[\\s\\x{0b}\\x{85}\\p{Z}]+', ' ', 'g'), ' ') AS plain FROM hits WHERE content IS NOT NULL""")
def html_strip(spark, d):
    c = F.concat(F.lit("<p>"), "content", F.lit("</p><br/>"))
    return table(spark, d, "hits").where("content is not null").select("hit_id", T.html_strip(c).alias("plain"))


@query("""SELECT message_id, trim(regexp_replace(regexp_replace(coalesce(filename, ''), '\\.[^.]+$', ''), '(?i)[_\\-\\s]?(?:vers(?:ione)?|rev|v)[_\\-\\s]*[0-9]+$', ''), '_- .') AS doc FROM queue_messages""")
def document_id(spark, d):
    return table(spark, d, "queue_messages").select("message_id", T.document_id(F.col("filename")).alias("doc"))


@query("""SELECT DISTINCT replace(lower(trim(document_id, ' ')), ' ', '-') AS row_key, CASE WHEN coalesce(trim(source_path, ' '), '') = '' THEN 'default' ELSE left(replace(lower(trim(source_path, ' ')), '/', '_'), 128) END AS part FROM registry""")
def registry_keys(spark, d):
    return table(spark, d, "registry").select(T.registry_id(F.col("document_id")).alias("row_key"), T.partition_key(F.col("source_path")).alias("part")).distinct()


@query("""WITH s AS (SELECT hit_id, version, chunk_index, trim(regexp_replace(coalesce(document_id, ''), '[^\\p{L}\\p{N}_-]', '-', 'g'), '-') AS k FROM hits)
SELECT hit_id, CASE WHEN version IS NULL OR chunk_index IS NULL THEN NULL ELSE printf('%s-v%d-%05d', CASE WHEN k = '' THEN 'doc' ELSE k END, version, chunk_index) END AS chunk FROM s""")
def chunk_ids(spark, d):
    c = T.chunk_id(F.col("document_id"), F.col("version"), F.col("chunk_index"))
    return table(spark, d, "hits").select("hit_id", F.when(F.col("version").isNotNull() & F.col("chunk_index").isNotNull(), c).alias("chunk"))


@query("""SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) END AS hash FROM documents""")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("""SELECT hit_id, nullif(regexp_extract(content, '[\\p{L}\\p{N}\\p{M}_.+-]+@[\\p{L}\\p{N}\\p{M}_.-]+\\.[a-zA-Z]{2,}'), '') AS email, nullif(regexp_extract(content, '\\+?\\p{Nd}[\\p{Nd}\\s().-]{6,}\\p{Nd}'), '') AS phone FROM hits""")
def contact_extract(spark, d):
    return table(spark, d, "hits").select("hit_id", T.first_email(F.col("content")).alias("email"), T.first_phone(F.col("content")).alias("phone"))


_N, _Y = "([0-9]+(?:[.,][0-9]+)?)", "\\s*(?:anni?|years?)\\b"


def _sql_number(pattern: str, group: int) -> str:
    return f"try_cast(replace(nullif(regexp_extract(q, '{pattern}', {group}), ''), ',', '.') AS DOUBLE)"


_R = [rf"\btra\s+{_N}\s+e\s+{_N}{_Y}", rf"\b{_N}\s*[-–]\s*{_N}{_Y}"]
_L = [rf"\balmeno\s+{_N}{_Y}", rf"\bda\s+{_N}{_Y}", rf"\b{_N}\s*\+\s*(?:anni?|years?)\b", rf"\b{_N}\s*(?:anni?|years?)\s*(?:di )?esperienz"]
_M = [rf"\bmassimo\s+{_N}{_Y}", rf"\bentro\s+{_N}{_Y}", rf"\bfino a\s+{_N}{_Y}"]


@query(f"""WITH t AS (SELECT eval_id, lower(query || CASE eval_id % 4 WHEN 0 THEN ' tra 2 e 5,5 anni' WHEN 1 THEN ' da 3 anni, massimo 8 anni' WHEN 2 THEN ' 4-7 years' ELSE '' END) AS q FROM evaluations)
SELECT eval_id, coalesce({_sql_number(_R[0], 1)}, {_sql_number(_R[1], 1)}, {', '.join(_sql_number(p, 1) for p in _L)}) AS min_years,
CASE WHEN coalesce({_sql_number(_R[0], 1)}, {_sql_number(_R[1], 1)}) IS NOT NULL THEN coalesce({_sql_number(_R[0], 2)}, {_sql_number(_R[1], 2)}) ELSE coalesce({', '.join(_sql_number(p, 1) for p in _M)}) END AS max_years FROM t""")
def parse_experience(spark, d):
    k = F.col("eval_id") % 4
    tail = F.when(k == 0, " tra 2 e 5,5 anni").when(k == 1, " da 3 anni, massimo 8 anni").when(k == 2, " 4-7 years").otherwise("")
    low, high = T.experience_bounds(F.concat("query", tail))
    return table(spark, d, "evaluations").select("eval_id", low.alias("min_years"), high.alias("max_years"))


@query("""SELECT hit_id, try_cast(nullif(regexp_extract(availability, '([0-9]+)', 1), '') AS INTEGER) AS days FROM hits""")
def availability_days(spark, d):
    return table(spark, d, "hits").select("hit_id", T.first_integer(F.col("availability")).alias("days"))


@query("""SELECT message_id, regexp_replace(filename, '[^A-Za-z0-9._-]', '_', 'g') AS name, strftime(enqueued_at, '%Y/%m/%d') AS folder FROM queue_messages""")
def safe_filename(spark, d):
    return table(spark, d, "queue_messages").select("message_id", T.safe_filename(F.col("filename")).alias("name"), F.date_format("enqueued_at", "yyyy/MM/dd").alias("folder"))


@query("""SELECT hit_id, CASE WHEN role IS NULL THEN '''''' WHEN regexp_matches(role, '[\\s:]') THEN '"' || replace(role, '"', '\\"') || '"' ELSE role END AS scalar FROM hits""")
def yaml_scalar(spark, d):
    return table(spark, d, "hits").select("hit_id", T.yaml_scalar(F.col("role")).alias("scalar"))


@query("""SELECT hit_id, list_filter(list_transform(string_split(coalesce(location, ''), ','), lambda x: lower(trim(x, ' '))), lambda x: x <> '') AS items FROM hits""")
def norm_list(spark, d):
    return table(spark, d, "hits").select("hit_id", T.norm_list(F.col("location")).alias("items"))


@query("""SELECT raw_id, coalesce(nullif(trim(email, ' '), ''), nullif(trim(phone, ' '), ''), 'none') AS contact FROM llm_extraction_raw""")
def first_non_empty(spark, d):
    return table(spark, d, "llm_extraction_raw").select("raw_id", T.first_non_empty(F.col("email"), F.col("phone"), F.lit("none")).alias("contact"))


_FLAGS = ("yes", " TRUE ", "on", "1", "no", "False", "off", "n", "maybe", "", None)
_FLAG = "CASE event_id % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_FLAGS) if v is not None) + " END"


@query(f"""WITH t AS (SELECT event_id, lower(trim({_FLAG}, ' ')) AS v, CASE event_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '' ELSE 'x' END || regexp_extract(props, '([0-9]+)', 1) AS n, value::VARCHAR AS d FROM events),
p AS (SELECT event_id, v, CASE WHEN v IN ('1','true','yes','y','on') THEN true WHEN v IN ('0','false','no','n','off') THEN false END AS flag, CASE WHEN try_cast(n AS INTEGER) > 0 THEN try_cast(n AS INTEGER) END AS number, n FROM t)
SELECT event_id, flag, number, CASE WHEN v <> '' AND flag IS NULL THEN 'flag' WHEN n <> '' AND number IS NULL THEN 'number' END AS rejected FROM p""")
def parse_scalars(spark, d):
    """Flags and positive numbers from loose texts, and which of them is given but unreadable."""
    v = F.element_at(F.array(*map(F.lit, _FLAGS)), (F.col("event_id") % 11 + 1).cast("int"))
    n = F.concat(F.when(F.col("event_id") % 3 == 0, "-").when(F.col("event_id") % 3 == 1, "").otherwise("x"), F.regexp_extract("props", "([0-9]+)", 1))
    e = table(spark, d, "events").select("event_id", v.alias("v"), n.alias("n"))
    flag, number = V.parse_bool(F.col("v")), V.positive_int(F.col("n"))
    bad = F.when((F.trim("v") != "") & flag.isNull(), "flag").when((F.trim("n") != "") & number.isNull(), "number")
    return e.select("event_id", flag.alias("flag"), number.alias("number"), bad.alias("rejected"))


@query("""SELECT raw_id, CASE WHEN regexp_full_match(trim(birth_date, ' '), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(trim(birth_date, ' ') AS DATE) END AS born FROM llm_extraction_raw""")
def parse_date(spark, d):
    return table(spark, d, "llm_extraction_raw").select("raw_id", V.strict_date(F.col("birth_date")).alias("born"))


@query(f"""WITH b AS (SELECT raw_id, CASE WHEN regexp_full_match(trim(birth_date, ' '), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(trim(birth_date, ' ') AS DATE) END AS born, DATE '{NOW}' AS today FROM llm_extraction_raw),
y AS (SELECT raw_id, year(today) - year(born) - CASE WHEN strftime(today, '%m%d') < strftime(born, '%m%d') THEN 1 ELSE 0 END AS years FROM b)
SELECT raw_id, CASE WHEN years >= 0 THEN years END AS age FROM y""")
def age(spark, d):
    born = V.strict_date(F.col("birth_date"))
    return table(spark, d, "llm_extraction_raw").select("raw_id", V.age(born, F.lit(NOW).cast("date")).cast("bigint").alias("age"))


@query("""SELECT hit_id, CASE WHEN experience_years IS NULL THEN NULL WHEN experience_years < 2 THEN 'junior' WHEN experience_years < 5 THEN 'mid' WHEN experience_years < 10 THEN 'senior' WHEN experience_years < 15 THEN 'lead' ELSE 'principal' END AS bucket FROM hits""")
def seniority_bucket(spark, d):
    return table(spark, d, "hits").select("hit_id", V.seniority(F.col("experience_years")).alias("bucket"))


@query(f"""SELECT hit_id, CASE WHEN floor((epoch(TIMESTAMP '{NOW} 00:00:00') - floor(epoch(loaded_at))) / 86400) <= 180 THEN 0.02 ELSE 0.0 END::DOUBLE AS boost FROM hits""")
def recency_boost(spark, d):
    return table(spark, d, "hits").select("hit_id", V.recency_boost(F.col("loaded_at"), F.lit(NOW).cast("timestamp")).alias("boost"))


@query("""SELECT eval_id, CASE WHEN round_even(final_score, 0) BETWEEN 1 AND 5 THEN round_even(final_score, 0)::INTEGER END AS score FROM evaluations""")
def coerce_score(spark, d):
    return table(spark, d, "evaluations").select("eval_id", V.coerce_score(F.col("final_score")).alias("score"))


@query("""SELECT event_id, least(8.0, 0.75 * pow(2.0, event_id % 6))::DOUBLE AS delay FROM events""")
def backoff(spark, d):
    return table(spark, d, "events").select("event_id", V.backoff(F.col("event_id") % 6 + 1).alias("delay"))


@query("""SELECT c_custkey, 'db' || c_custkey AS host, c_name AS db FROM customer""")
def kv_map(spark, d):
    """A connection string 'k=v;k=v' as a map, two of its values read back."""
    text = F.concat(F.lit("Server=db"), "c_custkey", F.lit(";Database="), "c_name", F.lit(";Pooling=true"))
    m = F.str_to_map(text, F.lit(";"), F.lit("="))
    return table(spark, d, "customer").select("c_custkey", m["Server"].alias("host"), m["Database"].alias("db"))


@query("""SELECT doc_id, CASE WHEN starts_with(text, '---\n') AND strpos(substring(text, 5), '\n---\n') > 0 THEN substring(text, 4 + strpos(substring(text, 5), '\n---\n') + 5) ELSE text END AS body FROM documents WHERE text IS NOT NULL""")
def strip_front_matter(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.strip_front_matter(F.col("text")).alias("body"))


@query("""WITH t AS (SELECT match_key, payload_json AS p, regexp_extract(payload_json, '(?s)\\{.*\\}') AS i FROM candidates WHERE payload_json IS NOT NULL)
SELECT match_key, CASE WHEN json_valid(p) AND starts_with(trim(p, ' '), '{') THEN trim(p, ' ') WHEN i <> '' AND json_valid(i) THEN i END AS json FROM t""")
def json_salvage(spark, d):
    c = table(spark, d, "candidates").where("payload_json is not null")
    return c.select("match_key", V.salvage_json(F.col("payload_json")).alias("json"))


@query()
def normalize_text(spark, d):
    """Normal form of every content: NFKC, single blanks, no control characters. Python, as the JVM functions have no NFKC."""
    return table(spark, d, "hits").where("content is not null").select("hit_id", U.nfkc()("content").alias("normal"))


@query("""WITH s AS (SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS words, len(regexp_extract_all(text, '(?m)^#+ ')) AS headings, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_matches(p, '[^\\s\\x{0b}\\x{85}\\p{Z}]'))) AS paragraphs FROM documents WHERE text IS NOT NULL)
SELECT *, CASE WHEN words > 800 THEN 'chunk' ELSE 'whole' END AS advice FROM s""")
def text_stats(spark, d):
    """Characters, words, headings and paragraphs of each document, and whether to cut it into chunks."""
    c = table(spark, d, "documents").where("text is not null")
    many = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("bigint")
    paragraphs = F.size(F.filter(F.split("text", r"\n\s*\n"), lambda p: T.strip(p) != "")).cast("bigint")
    c = c.select("doc_id", F.length("text").cast("bigint").alias("chars"), many(r"[\p{L}\p{N}_]+").alias("words"), many(r"(?m)^#+ ").alias("headings"), paragraphs.alias("paragraphs"))
    return c.withColumn("advice", F.when(F.col("words") > 800, "chunk").otherwise("whole"))


@query("""WITH s AS (SELECT coalesce(source, 'none') AS source, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS words FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS docs, round(avg(words), 6) AS mean_words, CASE WHEN avg(words) > 800 THEN 'chunk' ELSE 'whole' END AS advice FROM s GROUP BY GROUPING SETS ((source), ())""")
def text_stats_by_source(spark, d):
    """Mean words by source and of all documents, and the advice that follows."""
    c = table(spark, d, "documents").where("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")).alias("words"))
    return c.rollup("source").agg(F.count("*").alias("docs"), F.round(F.avg("words"), 6).alias("mean_words"), F.when(F.avg("words") > 800, "chunk").otherwise("whole").alias("advice"))
