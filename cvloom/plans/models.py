"""Queries on pluggable models, with the answers that hold where none is plugged in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as M
from .registry import query, table


@query("""SELECT eval_id, true AS compatible, 0.5::DOUBLE AS confidence, 'ok' AS verdict, 'no_judge' AS notes FROM evaluations""")
def answer_judged(spark, d):
    """Judgement of every answer where no judge is plugged in."""
    j = table(spark, d, "evaluations").select("eval_id", M.judge()("query", "response").alias("j"))
    return j.select("eval_id", "j.compatible", "j.confidence", "j.verdict", "j.notes")


@query("""SELECT doc_id, CASE WHEN trim(text, ' \n\t\r') <> '' THEN nullif(regexp_extract(left(text, 25000), '[\\p{L}\\p{N}\\p{M}_.+-]+@[\\p{L}\\p{N}\\p{M}_.-]+\\.[a-zA-Z]{2,}'), '') END AS email FROM documents""")
def extracted_mail(spark, d):
    """Mail of each document by the default extractor."""
    e = table(spark, d, "documents").select("doc_id", M.extractor()("text").alias("e"))
    return e.select("doc_id", F.get_json_object("e.json", "$.email").alias("email"))


@query("SELECT hit_id, NULL::VARCHAR AS summary FROM hits")
def evidence_summary(spark, d):
    """Summary of a hit's skills; none without a model."""
    return table(spark, d, "hits").select("hit_id", M.summariser()("skills").alias("summary"))


@query("""SELECT message_id, '' AS description FROM queue_messages""")
def image_described(spark, d):
    """Description of images; empty without a model."""
    return table(spark, d, "queue_messages").select("message_id", M.describer()(F.col("blob").cast("binary")).alias("description"))


@query("""SELECT eval_id, NULL::VARCHAR AS answer, 'no_agent' AS error, 0 AS attempts FROM evaluations""")
def agent_called(spark, d):
    """Call of an external agent; an error where none is plugged in."""
    a = table(spark, d, "evaluations").select("eval_id", M.agent()("query").alias("a"))
    return a.select("eval_id", "a.answer", "a.error", "a.attempts")
