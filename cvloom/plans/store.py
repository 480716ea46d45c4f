"""Queries on the registry, keyed tables and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import store as S
from ..sources import files
from .registry import query, table


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, hit_id DESC) AS rn FROM hits WHERE id IS NOT NULL AND hit_id % 3 = 0),
n AS (SELECT id, hit_id, version FROM r WHERE rn = 1) SELECT id, hit_id, version FROM hits h WHERE id IS NOT NULL AND hit_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = h.id) UNION ALL SELECT * FROM n""")
def chunk_upsert(spark, d):
    """A third of the chunks upserted into the rest by chunk key; rows without a key are left out."""
    h = table(spark, d, "hits").where("id is not null").select("id", "hit_id", "version", "loaded_at")
    base, new = h.where("hit_id % 3 <> 0"), h.where("hit_id % 3 = 0")
    return S.upsert(base, new, ["id"], [F.desc("loaded_at"), F.desc("hit_id")]).select("id", "hit_id", "version")


@query("""SELECT hit_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.status = 'failed' AND r.document_id = h.document_id)""")
def chunk_delete(spark, d):
    """Chunks without those of documents that failed."""
    failed = table(spark, d, "registry").where("status = 'failed'").select("document_id")
    return S.delete(table(spark, d, "hits").select("hit_id", "document_id"), failed, ["document_id"]).select("hit_id")


@query("""WITH c AS (SELECT hash, max(version) AS kept FROM registry WHERE hash IS NOT NULL AND status = 'processed' GROUP BY 1), i AS (SELECT DISTINCT document_id, hash FROM registry WHERE hash IS NOT NULL)
SELECT document_id, hash, kept IS NOT NULL AS hit, coalesce(kept, length(hash)) AS value FROM i LEFT JOIN c USING (hash)""")
def cache_hit_miss(spark, d):
    """Items with what the cache holds for their hash, and the others with what is worked out for them (here: a length)."""
    r = table(spark, d, "registry").where("hash is not null")
    known = r.where("status = 'processed'").groupBy("hash").agg(F.max("version").alias("value"))
    hits, misses = S.cached(r.select("document_id", "hash").distinct(), known, "hash")
    columns = lambda df, hit: df.select("document_id", "hash", F.lit(hit).alias("hit"), "value")
    return columns(hits, True).unionByName(columns(misses.withColumn("value", F.length("hash")), False))


@query("""WITH i AS (SELECT doc_id, source_path, sha256(text) AS hash, replace(lower(trim(document_id, ' ')), ' ', '-') AS row_key FROM documents WHERE text <> ''),
r AS (SELECT source_path, hash, replace(lower(trim(document_id, ' ')), ' ', '-') AS row_key, version FROM registry),
h AS (SELECT hash, max(version) AS v FROM r WHERE hash IS NOT NULL GROUP BY 1), p AS (SELECT source_path, max(version) AS v FROM r WHERE source_path IS NOT NULL GROUP BY 1), k AS (SELECT row_key, max(version) AS v FROM r WHERE row_key IS NOT NULL GROUP BY 1)
SELECT doc_id, CASE WHEN h.v IS NOT NULL THEN 'skip' WHEN p.v IS NOT NULL OR k.v IS NOT NULL THEN 'update' ELSE 'new' END AS decision, coalesce(h.v, p.v + 1, k.v + 1, 1) AS decided_version
FROM i LEFT JOIN h USING (hash) LEFT JOIN p USING (source_path) LEFT JOIN k USING (row_key)""")
def registry_decide(spark, d):
    key = lambda: T.registry_id(F.col("document_id")).alias("row_key")
    incoming = table(spark, d, "documents").where("text <> ''").select("doc_id", "source_path", F.sha2("text", 256).alias("hash"), key())
    known = table(spark, d, "registry").select("source_path", "hash", key(), "version")
    return S.decide(incoming, known).select("doc_id", "decision", "decided_version")


@query("""WITH e AS (SELECT document_id, trim(unnest(list_concat([source_path], string_split(coalesce(source_paths, ''), ';'))), ' ') AS p FROM registry)
SELECT document_id, string_agg(p, ';' ORDER BY p COLLATE C) AS all_paths FROM (SELECT DISTINCT document_id, p FROM e WHERE p <> '') x GROUP BY document_id""")
def registry_alias_union(spark, d):
    return S.aliases(table(spark, d, "registry"), "document_id", "source_path", "source_paths")


@query("""WITH e AS (SELECT source_path, document_id, doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE source_path IS NOT NULL),
c AS (SELECT *, CASE WHEN lag(h) OVER w IS NOT NULL AND h <> lag(h) OVER w THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY source_path, document_id ORDER BY doc_id))
SELECT doc_id, 1 + sum(c) OVER (PARTITION BY source_path, document_id ORDER BY doc_id)::BIGINT AS version_no FROM c""")
def version_numbering(spark, d):
    e = table(spark, d, "documents").where("source_path is not null").select("source_path", "document_id", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return S.versions(e, ["source_path", "document_id"], "h", ["doc_id"]).select("doc_id", "version_no")


@query("""SELECT min(doc_id) AS doc_id, sha256(text) AS hash, count(*) AS copies FROM documents WHERE text <> '' GROUP BY sha256(text)""")
def dedup_by_hash(spark, d):
    t = table(spark, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("hash"))
    return t.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT document_id, status, version FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC, version DESC, status, row_key, source_path) AS rn FROM registry) x WHERE rn = 1""")
def status_latest(spark, d):
    order = [F.desc("loaded_at"), F.desc("version"), F.asc_nulls_last("status"), F.asc_nulls_last("row_key"), F.asc_nulls_last("source_path")]
    return S.latest(table(spark, d, "registry"), ["document_id"], order).select("document_id", "status", "version")


@query("""WITH m AS (SELECT *, row_number() OVER (ORDER BY message_id) AS pos, ends_with(lower(coalesce(filename, '')), '.pdf') AS pdf FROM queue_messages WHERE blob IS NOT NULL),
s AS (SELECT *, sum(pdf::INT) OVER (ORDER BY message_id) AS sel FROM m), c AS (SELECT coalesce(min(pos) FILTER (sel = 40), max(pos)) AS last FROM s)
SELECT count(*) AS scanned, count(*) FILTER (pdf) AS selected, count(*) FILTER (NOT pdf) AS skipped_non_pdf FROM s, c WHERE pos <= last""")
def backfill_scan(spark, d):
    """Counters of a scan in order that stops once 40 PDF files are selected."""
    pdf = F.lower(F.coalesce("filename", F.lit(""))).endswith(".pdf")
    m = table(spark, d, "queue_messages").where("blob is not null").select("message_id", pdf.alias("pdf"))
    # The stop is the 40th selected row in order: found by a top-k, not by a running sum over all rows.
    top = m.where("pdf").orderBy("message_id").limit(40)
    stop = top.agg(F.count("*").alias("n"), F.max("message_id").alias("last"))
    seen = m.crossJoin(F.broadcast(stop)).where((F.col("n") < 40) | (F.col("message_id") <= F.col("last")))
    return seen.agg(F.count("*").alias("scanned"), F.count_if("pdf").alias("selected"), F.count_if(~F.col("pdf")).alias("skipped_non_pdf"))


@query("""SELECT match_key, full_name, role FROM candidates WHERE (full_name ILIKE '%a%' OR role ILIKE '%a%' OR location ILIKE '%a%' OR email ILIKE '%a%') AND location ILIKE '%o%' AND experience_years >= 2 AND experience_years <= 20 ORDER BY updated_at DESC NULLS LAST, match_key LIMIT 50""")
def sql_search(spark, d):
    return S.search(table(spark, d, "candidates"), q="a", like={"location": "o"}, low=2, high=20, limit=80).select("match_key", "full_name", "role")


@query("""SELECT match_key, full_name FROM candidates WHERE match_key = (SELECT lower(min(match_key)) FROM candidates) LIMIT 1""")
def sql_lookup(spark, d):
    c = table(spark, d, "candidates")
    key = c.agg(F.lower(F.min("match_key")).alias("match_key"))
    return c.join(F.broadcast(key), "match_key", "left_semi").select("match_key", "full_name").limit(1)


@query("""SELECT match_key, full_name, role, location, language, seniority FROM candidates""")
def project_public(spark, d):
    """Rows without contact data, age and payload."""
    return table(spark, d, "candidates").drop("email", "phone", "age", "payload_json", "updated_at", "experience_years")


@query("""SELECT message_id FROM queue_messages WHERE blob IS NULL OR filename IS NULL OR source_path IS NULL OR message_id % 11 = 0""")
def queue_rejects(spark, d):
    """Messages that lack a required field or cannot be read; every second comes as base64, every eleventh is cut off."""
    m, k = table(spark, d, "queue_messages"), F.col("message_id")
    body = F.to_json(F.struct("message_id", "blob", "filename", "source_path"))
    sent = F.when(k % 11 == 0, F.left(body, F.length(body) - 5)).when(k % 2 == 0, F.base64(body.cast("binary"))).otherwise(body)
    read = files.messages(m.select("message_id", sent.alias("value")), "message_id BIGINT, blob STRING, filename STRING, source_path STRING", keep=["message_id"])
    return read.where("rejected").select("message_id")
