"""Search over chunks: filters, lexical and vector scores, merging, ranking and grouping by document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Constants of BM25 (Robertson and Zaragoza).
K1, B = 1.2, 0.75
# Weights of the ranking formula.
W_SEMANTIC, W_VECTOR, W_LEXICAL, W_RECENT = 0.70, 0.20, 0.10, 0.02


def conditions(skills: list[str] | None = None, seniority: str | None = None, low: float | None = None, high: float | None = None, language: str | None = None, available: bool = False) -> Column | None:
    """Conjunction of the given constraints as columns, so that scalar ones are pushed into the scan; None without any."""
    tests = [F.array_contains("skills", s) for s in skills or []]
    if seniority:
        tests.append(F.col("seniority") == seniority)
    if low is not None:
        tests.append(F.col("experience_years") >= low)
    if high is not None:
        tests.append(F.col("experience_years") <= high)
    if language:
        tests.append(F.col("language") == language)
    if available:
        tests.append(F.col("availability").isNotNull())
    return reduce(lambda a, b: a & b, tests) if tests else None


def filtered(df: DataFrame, *args, **kwargs) -> DataFrame:
    test = conditions(*args, **kwargs)
    return df if test is None else df.where(test)


def bm25(chunks: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, lex_score of every chunk with a term of the query ('*': all chunks with 1.0); several terms are OR-ed.

    Only the query's terms are counted: their frequencies come from the arrays of words, without exploding the corpus.
    """
    if query.strip() == "*":
        return chunks.select(key, F.lit(1.0).alias("lex_score"))
    terms = list(dict.fromkeys(query.lower().split()))
    text_of = F.lower(F.coalesce(text, F.lit("")))

    def counted(rows: DataFrame) -> DataFrame:
        t = rows.select(key, T.tokens(F.coalesce(text, F.lit(""))).alias("_w"))
        return t.select(key, F.size("_w").alias("_n"), *[(F.size("_w") - F.size(F.array_remove("_w", w))).alias(f"_f{k}") for k, w in enumerate(terms)])

    stats = counted(chunks).agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(terms))])
    # A plain look for the letters of a term goes first; a test on the counts would be pushed below them and split each text again.
    s = counted(chunks.where(reduce(lambda a, b: a | b, [F.contains(text_of, F.lit(w)) for w in terms]))).crossJoin(F.broadcast(stats))  # one row of statistics

    def part(k: int) -> Column:
        idf = F.log(1 + (F.col("_docs") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5))
        f = F.col(f"_f{k}")
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))

    scored = s.select(key, F.round(sum(part(k) for k in range(len(terms))), 6).alias("lex_score"))
    return scored.where("lex_score > 0")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [0, 1]; 0 for a vector without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def nearest(vectors: DataFrame, key: str, vector: str, probe: DataFrame, k: int) -> DataFrame:
    """The k rows most similar to the one vector of probe (column probe)."""
    v = vectors.crossJoin(F.broadcast(probe.select("probe")))  # one row
    return v.select(key, F.round(cosine(F.col(vector), F.col("probe")), 6).alias("vec_score")).orderBy(F.desc("vec_score"), key).limit(k)


def nearest_approximate(vectors: DataFrame, key: str, vector: str, probe: DataFrame, k: int, planes: int = 16, tables: int = 8, flips: int = 5, seed: int = 7) -> DataFrame:
    """Up to k rows near the one vector of probe, compared exactly within the buckets of random hyperplanes.

    A row is compared if in one of the tables its side of the planes differs from the probe's in a few of them at most. The
    planes are made from the seed, so every row, also a later one, has the same buckets in every session.
    """
    import numpy as np

    size = len(vectors.select(vector).where(F.col(vector).isNotNull()).limit(1).collect()[0][0]) if not vectors.isEmpty() else 0
    made = np.random.default_rng(seed).normal(size=(tables, planes, size)).round(4).tolist()
    dot = lambda x, plane: F.aggregate(F.zip_with(x, F.array(*map(F.lit, plane)), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda a, v: a + v)

    def sides(x: Column) -> Column:
        return F.array(*[sum(F.when(dot(x, p) > 0, F.lit(1 << n)).otherwise(F.lit(0)) for n, p in enumerate(t)) for t in made])

    if not size:
        return vectors.select(key, F.lit(0.0).alias("vec_score")).limit(0)
    one = F.broadcast(probe.select("probe", sides(F.col("probe")).alias("_p")))  # one row
    near = F.exists(F.zip_with("_s", "_p", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= flips), lambda x: x)
    v = vectors.withColumn("_s", sides(F.col(vector))).crossJoin(one).where(near)
    return v.select(key, F.round(cosine(F.col(vector), F.col("probe")), 6).alias("vec_score")).orderBy(F.desc("vec_score"), key).limit(k)


def merged(lexical: DataFrame, semantic: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """Full outer merge of the three passes; a missing score is 0. score: semantic if positive, else the better other."""
    m = semantic.join(lexical, key, "full_outer").join(vector, key, "full_outer")
    m = m.select(key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lex_score", "semantic_score", "vec_score")])
    return m.withColumn("score", F.when(F.col("semantic_score") > 0, F.col("semantic_score")).otherwise(F.greatest("lex_score", "vec_score")))


def rank_score(semantic: Column, vector: Column, lexical: Column, recent: Column | None = None, places: int = 6) -> Column:
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    s = W_SEMANTIC * clamp(semantic / 4) + W_VECTOR * clamp(vector) + W_LEXICAL * clamp(lexical)
    return F.round(s if recent is None else s + recent, places)


def ranked(df: DataFrame, score: Column, tie: list, top: int) -> DataFrame:
    return df.withColumn("rank_score", score).orderBy(F.desc("rank_score"), *tie).limit(top)


def document_key() -> Column:
    """Document of a chunk, or the chunk itself where none is named."""
    return F.coalesce(T.blank_to_null(F.col("document_id")), F.col("id"))


def by_document(chunks: DataFrame) -> DataFrame:
    """Chunks with the document they belong to in doc; chunks without any key are dropped."""
    return chunks.withColumn("doc", document_key()).where("doc is not null")


def evidence(parts: Column, most: int = 8) -> Column:
    """First items of a list without repeats (case aside), joined by ' | '; null if none."""
    zero = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("kept"))

    def add(acc, p):
        new = ~F.array_contains(acc.keys, F.lower(p)) & (F.size(acc.kept) < most)
        return F.struct(F.when(new, F.concat(acc.keys, F.array(F.lower(p)))).otherwise(acc.keys).alias("keys"), F.when(new, F.concat(acc.kept, F.array(p))).otherwise(acc.kept).alias("kept"))

    return F.nullif(F.array_join(F.aggregate(F.filter(parts, lambda p: F.trim(p) != ""), zero, add, lambda acc: acc.kept), " | "), F.lit(""))


def highlight_pieces(highlights: Column) -> Column:
    """Pieces between '|' of the evidence of a chunk: its first six marked parts without marks and repeats (case aside), 1,000 characters in all."""
    none = F.array().cast("array<string>")
    snippets = F.flatten(F.transform(F.coalesce(F.map_values(highlights), F.array().cast("array<array<string>>")), lambda v: F.coalesce(v, none)))
    clean = F.slice(F.filter(F.transform(snippets, T.html_strip), lambda x: x != ""), 1, 6)
    text = F.left(F.coalesce(evidence(clean), F.lit("")), F.lit(1000))
    return F.filter(F.transform(F.split(text, r"\|"), T.strip), lambda x: x != "")


def filter_or_all(df: DataFrame, test: Column) -> DataFrame:
    """Rows that meet the test, or all of them if none does. One row says whether any does; no window over everything."""
    marked = df.withColumn("_ok", F.coalesce(test, F.lit(False)))
    some = marked.agg(F.max("_ok").alias("_any"))
    return marked.crossJoin(F.broadcast(some)).where(F.col("_ok") | ~F.coalesce("_any", F.lit(False))).drop("_ok", "_any")


def highlight(content: Column, terms: list[str]) -> Column:
    """Sentence with most terms of the query, these between <em> marks."""
    count = lambda s: sum(F.lower(s).contains(t).cast("int") for t in terms)
    sentences = F.split(content, r"(?<=[.!?])\s+|\n+")
    best = F.array_max(F.transform(sentences, lambda s, k: F.struct(count(s).alias("n"), (-k).alias("k"), s.alias("s"))))
    return F.when(best.n > 0, F.regexp_replace(best.s, "(?i)(" + "|".join(terms) + ")", "<em>$1</em>"))
