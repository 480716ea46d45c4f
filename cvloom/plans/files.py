"""Queries that need table functions or pluggable models: rows only, tested by hand-computed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs as U
from ..sources import files as S
from .registry import query, table


@query()
def extract_json_blocks(spark, d):
    """JSON objects embedded in texts made of the events' properties."""
    t = table(spark, d, "events").select("event_id", F.concat(F.lit("note "), "props", F.lit(" and "), "props").alias("t"))
    return t.lateralJoin(U.ExtractJsonBlocks(F.col("t").outer())).select("event_id", "block")


_EVIDENCE = """WITH c AS (SELECT match_key, full_name, role, location FROM candidates) SELECT match_key, (coalesce(full_name, '') <> '' OR role IS NOT NULL OR location IS NOT NULL)::INTEGER AS candidates_count, coalesce(trim(full_name, ' '), '') AS candidates_names FROM c"""


@query(_EVIDENCE)
def search_evidence(spark, d):
    """Different candidates and their first names in recorded responses, here made of candidates twice each, once inside a string."""
    c = table(spark, d, "candidates")
    one = F.to_json(F.struct("full_name", "role", "location"))
    body = F.concat(F.lit('{"data": {"hits": ['), one, F.lit(", "), one, F.lit("]}}"))
    text = F.concat(F.lit('{"output": '), F.to_json(F.struct(body.alias("payload"))), F.lit("}"))
    return c.select("match_key", U.evidence_of()(text).alias("e")).select("match_key", "e.candidates_count", "e.candidates_names")


@query()
def collect_hits(spark, d):
    """Objects under 'hits' in nested and string-encoded JSON made of candidates."""
    c = table(spark, d, "candidates")
    one = F.to_json(F.struct("match_key", "full_name"))
    body = F.concat(F.lit('{"data": {"hits": ['), one, F.lit("]}}"))
    t = c.select("match_key", F.concat(F.lit('{"output": '), F.to_json(F.struct(body.alias("payload"))), F.lit("}")).alias("t"))
    return t.lateralJoin(U.CollectHits(F.col("t").outer())).select("match_key", "hit")


@query()
def chunk_sections(spark, d):
    """Header-aware chunks of all documents."""
    return U.chunked_by_header(table(spark, d, "documents"), "doc_id", "text")


@query()
def nfkc_text(spark, d):
    return table(spark, d, "documents").select("doc_id", U.nfkc()("text").alias("text"))


@query()
def reencoded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", U.reencoded()("text").alias("text"))


@query()
def embedded_chunks(spark, d):
    """Vectors of the chunks by the deterministic stand-in for a model."""
    return table(spark, d, "hits").select("hit_id", U.embedder()("content").alias("e")).select("hit_id", F.col("e.vector").alias("embedding"), "e.error")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS x0, l_suppkey % 50 AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey % 50 + 10.0 AS y1 FROM lineitem),
t AS (SELECT o_orderkey, o_custkey % 80 AS x0, 0.0 AS y0, o_custkey % 80 + 60.0 AS x1, 40.0 AS y1 FROM orders)
SELECT l_orderkey, l_linenumber FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = b.l_orderkey AND greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) > 0.5 * greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0)))""")
def blocks_outside_tables(spark, d):
    """Layout blocks (lines of orders as boxes) that no table box of their page (the order) covers by half."""
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_partkey") % 100).cast("double").alias("bx0"), (F.col("l_suppkey") % 50).cast("double").alias("by0"), (F.col("l_partkey") % 100 + F.col("l_quantity")).alias("bx1"), (F.col("l_suppkey") % 50 + 10.0).alias("by1"))
    x = (F.col("o_custkey") % 80).cast("double")
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), x.alias("tx0"), F.lit(0.0).alias("ty0"), (x + 60).alias("tx1"), F.lit(40.0).alias("ty1"))
    return S.outside_tables(b, t).select("l_orderkey", "l_linenumber")


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_metrics(spark, d):
    """Metric of events by day and type, as the streaming windows give it on a finished stream."""
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""SELECT message_id, CASE WHEN ends_with(lower(filename), '.pdf') THEN 'pdf' WHEN ends_with(lower(filename), '.docx') THEN 'docx' WHEN ends_with(lower(filename), '.txt') THEN 'txt' END AS kind FROM queue_messages""")
def mime_dispatch(spark, d):
    """Format of a message's file by its name."""
    m = S.mime(F.col("filename"))
    return table(spark, d, "queue_messages").select("message_id", F.when(m == "application/pdf", "pdf").when(m.contains("word"), "docx").when(m == "text/plain", "txt").alias("kind"))
