"""Queries on evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from .registry import query, table

# Weights of the judged metrics.
WEIGHTS = {"classification_coherence": 0.35, "search_relevance": 0.30, "candidate_quality": 0.15, "field_completeness": 0.15, "handling_complexity": 0.05}


@query("SELECT eval_id, round(" + " + ".join(f"{w} * {c}" for c, w in WEIGHTS.items()) + ", 2)::DOUBLE AS final FROM evaluations")
def eval_final_score(spark, d):
    """Weighted score of a run; any missing metric makes it null."""
    total = sum(F.lit(w).cast("decimal(4,2)") * F.col(c) for c, w in WEIGHTS.items())
    return table(spark, d, "evaluations").select("eval_id", F.round(total, 2).cast("double").alias("final"))


@query("""SELECT title, round(avg(final_score), 6) AS mean_score, count(*) AS runs FROM evaluations GROUP BY GROUPING SETS ((title), ())""")
def eval_by_category(spark, d):
    """Mean score and number of runs of each category and of all."""
    r = table(spark, d, "evaluations").rollup("title").agg(F.round(F.avg("final_score"), 6).alias("mean_score"), F.count("*").alias("runs"))
    return r


@query("""SELECT classification, count(*) AS runs, round(avg(latency_seconds), 6) AS mean_latency, median(latency_seconds) AS median_latency, round(avg(judge_latency_seconds), 6) AS mean_judge FROM evaluations GROUP BY classification""")
def latency_by_verdict(spark, d):
    return table(spark, d, "evaluations").groupBy("classification").agg(F.count("*").alias("runs"), F.round(F.avg("latency_seconds"), 6).alias("mean_latency"), F.median("latency_seconds").alias("median_latency"), F.round(F.avg("judge_latency_seconds"), 6).alias("mean_judge"))


@query("""SELECT eval_id, CASE WHEN trim(coalesce(candidates_names, ''), ' ') <> '' THEN candidates_names WHEN trim(coalesce(search_index_evidence, ''), ' ') <> '' THEN search_index_evidence ELSE response END AS candidates FROM evaluations""")
def candidate_source(spark, d):
    """Candidates of a run from the first source that holds any."""
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))
    return table(spark, d, "evaluations").select("eval_id", F.coalesce(filled("candidates_names"), filled("search_index_evidence"), F.col("response")).alias("candidates"))


@query("""SELECT count(*) FILTER (agent_error IS NOT NULL AND agent_error <> '') AS failed, count(*) FILTER (coalesce(agent_error, '') = '') AS fine, max(candidates_count) AS most_candidates FROM evaluations""")
def eval_counts(spark, d):
    e = F.coalesce("agent_error", F.lit(""))
    return table(spark, d, "evaluations").agg(F.count_if(e != "").alias("failed"), F.count_if(e == "").alias("fine"), F.max("candidates_count").alias("most_candidates"))
