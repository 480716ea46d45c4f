"""A search from request to candidates: filter, three passes, ranking, grouping by document, relaxation, features, soft constraints.

Everything is planned lazily; whether to relax, and whether a constraint would empty the answer, is decided by windows over the few rows of an answer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking as K
from . import retrieval as R
from ..functions import text as T

# Documents of an answer, chunks that are ranked at least, chunks read by the semantic pass, stored chunks
# loaded for a document, and the share of the wanted number below which criteria are relaxed.
CANDIDATES, CHUNKS, SEMANTIC, STORED, RELAX_BELOW = 6, 60, 20, 40, 0.20
NONE = "array<string>"


def term_share(content: Column, terms: list[str]) -> Column:
    """Default semantic score, from 0 to 4: the share of the query's words that a chunk holds."""
    words = T.tokens(F.coalesce(content, F.lit("")))
    return F.round(sum(F.array_contains(words, t).cast("int") for t in terms) * 4.0 / max(1, len(terms)), 6)


def passes(chunks: DataFrame, words: str, top: int, vectors: DataFrame | None = None, scorer=term_share) -> DataFrame:
    """hit_id with its three scores: the lexical pass keeps five times top, the semantic one reads the first of these, the vector one (hit_id, vec_score) keeps three times top."""
    lexical = R.bm25(chunks, "hit_id", "content", words).orderBy(F.desc("lex_score"), "hit_id").limit(5 * top)
    terms = [] if words == "*" else list(dict.fromkeys(words.lower().split()))
    first = lexical.orderBy(F.desc("lex_score"), "hit_id").limit(SEMANTIC).select("hit_id")
    semantic = chunks.select("hit_id", "content").join(F.broadcast(first), "hit_id", "left_semi").select("hit_id", scorer(F.col("content"), terms).alias("semantic_score"))
    near = vectors if vectors is not None else chunks.sparkSession.createDataFrame([], "hit_id bigint, vec_score double")
    near = near.join(chunks.select("hit_id"), "hit_id", "left_semi").orderBy(F.desc("vec_score"), "hit_id").limit(3 * top)
    return R.merged(lexical, semantic, near, "hit_id")


def candidates(chunks: DataFrame, ranked: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Candidates of ranked chunks (hit_id, rank_score and the scores): one row a document, the best first in place.

    Scores are maxima over the ranked chunks of a document; skills and certificates are sets over these and its stored
    chunks; the other attributes are those of its best ranked chunk; evidence comes from highlights, skills and stored
    chunks. Chunks without document and id belong to nobody. Stored chunks are loaded up to 40 a document, in all.
    """
    keyed = R.by_document(chunks)
    top = keyed.drop("lex_score", "vec_score", "semantic_score", "score").join(F.broadcast(ranked), "hit_id")  # CHUNKS rows or five times top
    docs = top.groupBy("doc").agg(F.max("rank_score").alias("best")).orderBy(F.desc("best"), "doc").limit(most)
    wanted = F.broadcast(docs)
    own = top.join(wanted, "doc")
    stored = keyed.join(wanted.select("doc"), "doc", "left_semi").orderBy("hit_id").limit(min(1000, STORED * most))
    order = F.struct("rank_score", (-F.col("hit_id")).alias("h"))
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast(NONE)), T.strip), lambda x: x != "")
    first = F.struct("id", "full_name", "role", "location", "seniority", "experience_years", "language", "availability", "version", "source_path")
    marked = F.transform(F.slice(F.sort_array(F.collect_list(F.struct(order.alias("o"), R.highlight_pieces(F.col("highlights")).alias("e"))), asc=False), 1, 4), lambda x: x.e)
    a = own.groupBy("doc").agg(
        F.max("best").alias("best"), *[F.max(c).alias(c) for c in ("semantic_score", "vec_score", "lex_score")], F.max("score").alias("score"), F.max_by(first, order).alias("p"),
        F.flatten(marked).alias("marked"), F.flatten(F.collect_list(T.clean_set(F.col("skills")))).alias("s"), F.flatten(F.collect_list(clean(F.col("certifications")))).alias("c"), F.count("*").alias("n_chunks"),
    )
    heads = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("hit_id", F.left(T.strip(F.coalesce("content", F.lit(""))), F.lit(140)).alias("c")))), 1, 8), lambda x: x.c)
    b = stored.groupBy("doc").agg(heads.alias("heads"), F.flatten(F.collect_list(T.clean_set(F.col("skills")))).alias("s2"), F.flatten(F.collect_list(clean(F.col("certifications")))).alias("c2"))
    none = F.array().cast(NONE)
    j = a.join(b, "doc", "left")
    j = j.withColumn("skills", F.array_sort(F.array_distinct(F.concat("s", F.coalesce("s2", none))))).withColumn("certifications", F.array_sort(F.array_distinct(F.concat("c", F.coalesce("c2", none)))))
    parts = F.concat("marked", F.slice("skills", 1, 6), F.coalesce("heads", none))
    return j.select(F.col("doc").alias("document_id"), "best", "p.*", "skills", "certifications", T.first_integer(F.col("p.availability")).alias("availability_days"), "semantic_score", "vec_score", "lex_score", F.round("score", 6).alias("score"), "n_chunks", R.evidence(parts).alias("evidence"))


def found(chunks: DataFrame, request: dict, words: str, skills: list[str], vectors: DataFrame | None) -> DataFrame:
    """Candidates of one pass: chunks that meet the filter, ranked and grouped."""
    kept = R.filtered(chunks, skills=skills, seniority=request.get("seniority"), low=request.get("min_years"), high=request.get("max_years"), language=request.get("language"))
    many = max(CHUNKS, 5 * request.get("top", 10))
    hits = passes(kept, words, many, vectors)
    score = R.rank_score(F.col("semantic_score"), F.col("vec_score"), F.col("lex_score"))
    return candidates(chunks, R.ranked(hits, score, ["hit_id"], many))


def softly(df: DataFrame, test: Column, name: str) -> DataFrame:
    """Rows that meet the test; if none does, all of them with the name among the ignored criteria."""
    any_ok = F.max("_ok").over(Window.partitionBy(F.lit(1)))  # the candidates of an answer
    j = df.withColumn("_ok", F.coalesce(test, F.lit(False))).withColumn("_any", any_ok).where(F.col("_ok") | ~F.col("_any"))
    return j.withColumn("ignored", F.when(F.col("_any"), F.col("ignored")).otherwise(F.concat("ignored", F.array(F.lit(name))))).drop("_ok", "_any")


def search(chunks: DataFrame, request: dict, vectors: DataFrame | None = None) -> DataFrame:
    """Answer to a normalised request: candidates in place, with match features, whether they came by relaxation, and the criteria ignored.

    request: query, skills, role, location, work_mode, seniority, language, min_years, max_years, top, available_in,
    availability_required; missing ones do not matter. It must name a query, skills or a role. Too few candidates, and
    skills asked for: those found without the skills follow.
    """
    skills, role, query, top = request.get("skills") or [], request.get("role") or "", request.get("query") or "", request.get("top", 10)
    if not (query or skills or role):
        raise ValueError("a request must name a query, skills or a role")
    words = " ".join([x for x in (role, " ".join(skills)) if x]) or query or "*"
    strict = found(chunks, request, words, skills, vectors).withColumn("relaxed", F.lit(False))
    answer = strict
    if skills:
        # Some twelve rows: windows over them decide, so that each pass is worked out once.
        both = strict.unionByName(found(chunks, request, role or query or "*", [], vectors).withColumn("relaxed", F.lit(True)))
        own = F.sum((~F.col("relaxed")).cast("int")).over(Window.partitionBy(F.lit(1)))
        known = F.max(~F.col("relaxed")).over(Window.partitionBy("document_id"))
        both = both.withColumn("_n", own).withColumn("_k", known).where(~F.col("relaxed") | ((F.col("_n") < math.ceil(top * RELAX_BELOW)) & ~F.col("_k")))
        answer = both.drop("_n", "_k")
        answer = answer.orderBy("relaxed", F.desc("best"), "document_id").limit(CANDIDATES)
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    said = lambda k: F.lit((request.get(k) or "").strip().lower())
    mode = request.get("work_mode") or "unknown"
    features = {
        "skills": K.skills(F.array(*map(F.lit, skills)).cast(NONE), F.col("skills")), "role": K.role(said("role"), low("role")), "location": K.location(said("location"), low("location"), F.lit(mode)), "language": K.language(said("language"), low("language")),
        "seniority": K.seniority(said("seniority"), low("seniority")), "availability": K.availability(F.lit(bool(request.get("availability_required"))), F.col("availability_days")),
    }
    answer = answer.withColumn("features", F.struct(*[c.alias(k) for k, c in features.items()])).withColumn("ignored", F.array().cast(NONE))
    answer = answer.withColumn("matched_on", K.matched_on({k: F.col("features")[k] for k in features}))
    if request.get("location") and mode in ("onsite", "hybrid", "unknown"):
        answer = softly(answer, F.col("features.location.score") > 0, "work_mode")
    if request.get("available_in") is not None:
        answer = softly(answer, F.col("availability_days") <= request["available_in"], "availability_date")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("relaxed", F.desc("best"), "document_id"))  # CANDIDATES rows
    return answer.withColumn("place", place)


def suggestions(answer: DataFrame, skills: list[str]) -> DataFrame:
    """One row: whether anything was relaxed, and what to tell of it: skills that are not strict, criteria that were ignored."""
    one = answer.agg(F.coalesce(F.max("relaxed"), F.lit(False)).alias("r"), F.coalesce(F.first("ignored"), F.array().cast(NONE)).alias("i"), F.count("*").alias("total"))
    told = F.concat(F.when(F.col("r"), F.array(*[F.lit(f"skill_not_strict:{s}") for s in skills]).cast(NONE)).otherwise(F.array().cast(NONE)), F.transform("i", lambda x: F.concat(F.lit("ignored:"), x)))
    return one.select("total", (F.col("r") | (F.size("i") > 0)).alias("relaxed"), told.alias("suggestions"))
