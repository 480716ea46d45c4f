"""Queries on filters, lexical and vector search, and their merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import retrieval as R
from ..operators import store as S
from .registry import query, table

TERMS = ["java", "docker", "spark"]
QUERY = " ".join(TERMS)

_STRICT = "list_contains(skills, 'java') AND experience_years >= 0 AND experience_years <= 25"


@query(f"SELECT hit_id FROM hits WHERE {_STRICT}")
def filter_strict(spark, d):
    return R.filtered(table(spark, d, "hits"), skills=["java"], low=0, high=25).select("hit_id")


@query("SELECT hit_id FROM hits WHERE experience_years >= 0 AND experience_years <= 25 AND language = 'Italian' AND availability IS NOT NULL")
def filter_relaxed(spark, d):
    return R.filtered(table(spark, d, "hits"), low=0, high=25, language="Italian", available=True).select("hit_id")


_BM = """t AS (SELECT hit_id, regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}]+') AS w FROM hits),
f AS (SELECT hit_id, len(w) AS n, """ + ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS f{k}" for k, w in enumerate(TERMS)) + """ FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, """ + ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(3)) + """ FROM f),
bm AS (SELECT hit_id, round(""" + " + ".join(f"ln(1 + (docs - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * n / mean))" for k in range(3)) + """, 6) AS lex_score FROM f, s WHERE f0 > 0 OR f1 > 0 OR f2 > 0)"""


@query(f"WITH {_BM} SELECT hit_id, lex_score FROM bm ORDER BY lex_score DESC, hit_id LIMIT 100")
def bm25_topk(spark, d):
    return R.bm25(table(spark, d, "hits"), "hit_id", "content", QUERY).orderBy(F.desc("lex_score"), "hit_id").limit(100)


_COS = """q AS (SELECT embedding AS p FROM embeddings WHERE vec_id = 0),
kn AS (SELECT vec_id, round(greatest(0, least(1, list_sum(list_transform(list_zip(embedding, p), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(p, lambda x: x::DOUBLE * x::DOUBLE)))))), 6) AS vec_score FROM embeddings, q)"""


def _probe(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("probe"))


@query(f"WITH {_COS} SELECT vec_id, vec_score FROM kn ORDER BY vec_score DESC, vec_id LIMIT 30")
def knn_topk(spark, d):
    return R.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _probe(spark, d), 30)


_SEM = "sm AS (SELECT hit_id, round(4.0 * (" + " + ".join(f"(f{k} > 0)::INT" for k in range(3)) + ") / 3, 6)::DOUBLE AS semantic_score FROM f WHERE f0 > 0 OR f1 > 0 OR f2 > 0)"


def _semantic(spark, d):
    """Deterministic stand-in for an external scorer: 4 times the share of the query's terms in the chunk."""
    t = table(spark, d, "hits").select("hit_id", T.tokens(F.coalesce("content", F.lit(""))).alias("w"))
    n = sum(F.array_contains("w", x).cast("int") for x in TERMS)
    return t.select("hit_id", F.round(n * 4.0 / len(TERMS), 6).alias("semantic_score")).where("semantic_score > 0")


@query(f"WITH {_BM}, {_SEM} SELECT * FROM sm")
def semantic_proxy(spark, d):
    return _semantic(spark, d)


@query(f"WITH {_BM}, {_SEM}, k AS (SELECT hit_id FROM bm ORDER BY lex_score DESC, hit_id LIMIT 20) SELECT * FROM sm WHERE hit_id IN (SELECT hit_id FROM k)")
def semantic_semi(spark, d):
    """Semantic scores of the best 20 lexical hits only."""
    best = R.bm25(table(spark, d, "hits"), "hit_id", "content", QUERY).orderBy(F.desc("lex_score"), "hit_id").limit(20)
    return _semantic(spark, d).join(F.broadcast(best.select("hit_id")), "hit_id", "left_semi")


def _merged(spark, d):
    lexical = R.bm25(table(spark, d, "hits"), "hit_id", "content", QUERY).orderBy(F.desc("lex_score"), "hit_id").limit(50)
    semantic = _semantic(spark, d).join(F.broadcast(lexical.select("hit_id")), "hit_id", "left_semi")
    vector = R.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _probe(spark, d), 30).withColumnRenamed("vec_id", "hit_id")
    return R.merged(lexical, semantic, vector, "hit_id")


_MERGED = f"""{_BM}, {_SEM}, {_COS}, lx AS (SELECT * FROM bm ORDER BY lex_score DESC, hit_id LIMIT 50), se AS (SELECT * FROM sm WHERE hit_id IN (SELECT hit_id FROM lx)),
ve AS (SELECT vec_id AS hit_id, vec_score FROM kn ORDER BY vec_score DESC, vec_id LIMIT 30),
mg AS (SELECT hit_id, coalesce(lex_score, 0) AS lex_score, coalesce(semantic_score, 0) AS semantic_score, coalesce(vec_score, 0) AS vec_score FROM se FULL JOIN lx USING (hit_id) FULL JOIN ve USING (hit_id)),
m AS (SELECT *, CASE WHEN semantic_score > 0 THEN semantic_score ELSE greatest(lex_score, vec_score) END AS score FROM mg)"""


@query(f"WITH {_MERGED} SELECT * FROM m")
def hybrid_merge(spark, d):
    return _merged(spark, d)


_RANK = "round(0.7 * greatest(0, least(1, semantic_score / 4)) + 0.2 * greatest(0, least(1, vec_score)) + 0.1 * greatest(0, least(1, lex_score)), 6)"


@query(f"WITH {_MERGED} SELECT hit_id, {_RANK} AS rank_score FROM m ORDER BY rank_score DESC, hit_id LIMIT 20")
def rerank(spark, d):
    score = R.rank_score(F.col("semantic_score"), F.col("vec_score"), F.col("lex_score"))
    return R.ranked(_merged(spark, d), score, ["hit_id"], 20).select("hit_id", "rank_score")


@query(f"""SELECT hit_id, round(0.7 * greatest(0, least(1, coalesce(semantic_score, 0) / 4)) + 0.2 * greatest(0, least(1, coalesce(vec_score, 0))) + 0.1 * greatest(0, least(1, coalesce(lex_score, 0))) + CASE WHEN floor((epoch(TIMESTAMP '2026-06-30 00:00:00') - floor(epoch(loaded_at))) / 86400) <= 180 THEN 0.02 ELSE 0.0 END, 8)::DOUBLE AS rank_score FROM hits""")
def rerank_recent(spark, d):
    """Ranking score of every hit with the boost of recent ones."""
    boost = V.recency_boost(F.col("loaded_at"), F.lit("2026-06-30").cast("timestamp"))
    return table(spark, d, "hits").select("hit_id", R.rank_score(F.coalesce("semantic_score", F.lit(0.0)), F.col("vec_score"), F.col("lex_score"), boost, 8).alias("rank_score"))


@query()
def highlight(spark, d):
    """Best sentence of the chunks with a term of the query, the terms marked (look-around: tested by hand)."""
    h = table(spark, d, "hits").select("hit_id", R.highlight(F.col("content"), TERMS).alias("fragment"))
    return h.where("fragment is not null")


@query("""WITH p AS (SELECT hit_id, list_filter(list_transform(flatten(map_values(highlights)), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS parts FROM hits WHERE highlights IS NOT NULL),
u AS (SELECT hit_id, unnest(parts) AS v, generate_subscripts(parts, 1) AS pos FROM p), k AS (SELECT hit_id, lower(v) AS l, min(pos) AS pos FROM u GROUP BY 1, 2), r AS (SELECT k.hit_id, u.v, k.pos, row_number() OVER (PARTITION BY k.hit_id ORDER BY k.pos) AS rn FROM k JOIN u ON k.hit_id = u.hit_id AND k.pos = u.pos)
SELECT hit_id, left(string_agg(v, ' | ' ORDER BY pos), 1000) AS evidence FROM r WHERE rn <= 6 GROUP BY hit_id""")
def semantic_evidence(spark, d):
    """Snippets of a hit's highlights, cleaned, without repeats, six at most."""
    h = table(spark, d, "hits").where("highlights is not null")
    clean = F.transform(F.flatten(F.map_values("highlights")), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")))
    return h.select("hit_id", F.left(R.evidence(clean, 6), F.lit(1000)).alias("evidence")).where("evidence is not null")


@query("""WITH t AS (SELECT document_id FROM hits WHERE document_id IS NOT NULL GROUP BY 1 ORDER BY max(coalesce(score, 0)) DESC, document_id LIMIT 6)
SELECT hit_id, document_id FROM hits WHERE document_id IN (SELECT document_id FROM t) ORDER BY hit_id LIMIT 240""")
def load_chunks(spark, d):
    """All chunks of the best six documents, 40 a document in total."""
    h = table(spark, d, "hits")
    top = h.where("document_id is not null").groupBy("document_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("s")).orderBy(F.desc("s"), "document_id").limit(6)
    return h.join(F.broadcast(top.select("document_id")), "document_id", "left_semi").select("hit_id", "document_id").orderBy("hit_id").limit(240)


@query("""SELECT id, max(coalesce(score, 0)) AS best, arg_max(hit_id, (coalesce(score, 0), -hit_id)) AS hit_id FROM hits WHERE id IS NOT NULL GROUP BY id""")
def dedup_keep_best(spark, d):
    h = table(spark, d, "hits").where("id is not null").withColumn("s", F.coalesce("score", F.lit(0.0)))
    best = h.groupBy("id").agg(F.max(F.struct("s", (-F.col("hit_id")).alias("h"))).alias("b"))
    return best.select("id", F.col("b.s").alias("best"), (-F.col("b.h")).alias("hit_id"))


@query("""SELECT min(hit_id) AS hit_id FROM hits GROUP BY lower(coalesce(full_name, '')), lower(coalesce(role, '')), lower(coalesce(location, ''))""")
def dedup_keep_first(spark, d):
    k = [F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("full_name", "role", "location")]
    return table(spark, d, "hits").groupBy(*k).agg(F.min("hit_id").alias("hit_id")).select("hit_id")


_WORD = """coalesce(regexp_matches(' ' || lower(content) || ' ', (SELECT '[^\\p{L}\\p{N}_](?:' || string_agg(regexp_escape(lower(value)), '|') || ')[^\\p{L}\\p{N}_]' FROM canonical_values WHERE field = 'skill' AND trim(value, ' ') <> '')), false)"""


@query(f"SELECT hit_id FROM hits WHERE content IS NOT NULL AND {_WORD}")
def theta_semi_contains(spark, d):
    """Hits whose content names a skill of the list, of any length, as a whole word."""
    return _named(spark, d, True)


@query(f"SELECT hit_id FROM hits WHERE content IS NOT NULL AND NOT {_WORD}")
def theta_anti_contains(spark, d):
    """Hits whose content names no skill of the list as a whole word."""
    return _named(spark, d, False)


def _named(spark, d, wanted: bool):
    """A plain look for a name goes first; its pattern is tried only where its letters are."""
    name = F.lower("value")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.regexp_replace(name, r"([^\p{L}\p{N}])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}_])"))
    values = table(spark, d, "canonical_values").where("field = 'skill' and trim(value) <> ''").agg(F.collect_set(F.struct(name.alias("name"), pattern.alias("pattern"))).alias("values"))
    h = table(spark, d, "hits").where("content is not null").select("hit_id", F.lower("content").alias("c")).crossJoin(F.broadcast(values))  # one row
    some = F.exists("values", lambda v: F.contains(F.col("c"), v.getField("name")) & (F.regexp_instr(F.col("c"), v.getField("pattern"), F.lit(0)) > 0))
    return h.where(some if wanted else ~some).select("hit_id")


@query(f"""WITH {_BM} SELECT hit_id, bm.lex_score FROM bm JOIN hits USING (hit_id) WHERE {_STRICT} AND hit_id IN (SELECT doc_id FROM documents WHERE lang IS NOT NULL)""")
def id_set_filter(spark, d):
    """Hits of a set of ids that also meet the filter, with their lexical score."""
    h, ids = table(spark, d, "hits"), table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("hit_id"))
    kept = R.filtered(h, skills=["java"], low=0, high=25).select("hit_id").join(ids, "hit_id", "left_semi")
    return R.bm25(h, "hit_id", "content", QUERY).join(kept, "hit_id", "left_semi")


# Fields of a candidate that an evaluation sees.
PUBLIC = ["id", "document_id", "full_name", "role", "location", "skills", "certifications", "seniority", "experience_years", "language", "availability", "version", "source_path", "semantic_score", "highlights"]


@query("SELECT hit_id, " + ", ".join(c for c in PUBLIC if c != "highlights") + " FROM hits")
def project_allowed(spark, d):
    """The fields of hits that an evaluation may see (highlights aside)."""
    return table(spark, d, "hits").select("hit_id", *[c for c in PUBLIC if c != "highlights"])


@query()
def knn_approximate(spark, d):
    """Near neighbours of one vector by random hyperplanes; recall against the exact ones is measured in the tests."""
    return R.nearest_approximate(table(spark, d, "embeddings"), "vec_id", "embedding", _probe(spark, d), 30)
