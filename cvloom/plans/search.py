"""Queries that search from a request to candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import search as A
from .registry import query, table

HYBRID = {"query": "sviluppatore java con docker", "skills": ["java"], "role": "java developer", "location": "milano", "work_mode": "onsite", "min_years": 0.0, "top": 10, "availability_required": True, "available_in": 60}
RARE = {"query": "java e solidity", "skills": ["java", "solidity", "figma"], "role": "backend developer", "location": "atlantide", "work_mode": "hybrid", "top": 10}


def _vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("probe"))
    return R.nearest(e, "vec_id", "embedding", probe, 300).withColumnRenamed("vec_id", "hit_id")


def _shown(answer: DataFrame) -> DataFrame:
    return answer.select("place", "document_id", F.col("best").alias("rank_score"), "full_name", "role", "location", "skills", "semantic_score", "vec_score", "lex_score", "n_chunks", "evidence", "matched_on", "relaxed", "ignored")


@query()
def search_candidates(spark, d):
    """The whole search with all three passes; equal to plain Python on small tables (tests)."""
    return _shown(A.search(table(spark, d, "hits"), HYBRID, _vectors(spark, d)))


@query()
def search_relaxed(spark, d):
    """A request that too few meet: candidates without its skills follow, and its place is ignored."""
    return _shown(A.search(table(spark, d, "hits"), RARE))


@query()
def search_suggestions(spark, d):
    """What to tell of a relaxed answer."""
    return A.suggestions(A.search(table(spark, d, "hits"), RARE), RARE["skills"])
