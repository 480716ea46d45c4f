"""Queries on documents as groups of chunks, match features and relaxation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import ranking as K
from ..operators import retrieval as R
from . import sql as Q
from .registry import query, table

_DOC = "coalesce(nullif(trim(document_id, ' '), ''), id)"


@query(f"""WITH g AS (SELECT {_DOC} AS doc, * FROM hits), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY coalesce(score, 0) DESC, hit_id) AS rn FROM g WHERE doc IS NOT NULL)
SELECT doc, count(*) AS chunks, max(coalesce(semantic_score, 0)) AS semantic_score, max(coalesce(vec_score, 0)) AS vec_score, max(coalesce(lex_score, 0)) AS lex_score, max(coalesce(score, 0)) AS score, min(hit_id) FILTER (rn = 1) AS best_hit FROM r GROUP BY doc""")
def doc_group(spark, d):
    """Documents with the best of each score and their best chunk; one partial aggregation."""
    h = R.by_document(table(spark, d, "hits"))
    top = F.max_by("hit_id", F.struct(F.coalesce("score", F.lit(0.0)), -F.col("hit_id")))
    return h.groupBy("doc").agg(F.count("*").alias("chunks"), *[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("semantic_score", "vec_score", "lex_score", "score")], top.alias("best_hit"))


@query(f"""WITH g AS (SELECT {_DOC} AS doc, * FROM hits), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY coalesce(score, 0) DESC, hit_id) AS rn FROM g WHERE doc IS NOT NULL)
SELECT doc, full_name, role, location, source_path FROM r WHERE rn = 1""")
def doc_primary(spark, d):
    """Attributes of a document's best chunk."""
    h = R.by_document(table(spark, d, "hits"))
    best = F.max_by(F.struct("full_name", "role", "location", "source_path"), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("hit_id")))
    return h.groupBy("doc").agg(best.alias("b")).select("doc", "b.*")


@query(f"""WITH g AS (SELECT {_DOC} AS doc, skills, certifications FROM hits), s AS (SELECT DISTINCT doc, lower(trim(unnest(skills), ' ')) AS v FROM g WHERE doc IS NOT NULL), c AS (SELECT DISTINCT doc, trim(unnest(certifications), ' ') AS v FROM g WHERE doc IS NOT NULL),
a AS (SELECT doc, list_sort(list(v)) AS skills FROM s WHERE v <> '' GROUP BY doc), b AS (SELECT doc, list_sort(list(v)) AS certs FROM c WHERE v <> '' GROUP BY doc)
SELECT doc, coalesce(skills, []) AS skills, coalesce(certs, []) AS certs FROM (SELECT DISTINCT doc FROM g WHERE doc IS NOT NULL) d LEFT JOIN a USING (doc) LEFT JOIN b USING (doc)""")
def skills_agg(spark, d):
    """Sets of skills and certificates of a document. Values are made distinct before they are gathered."""
    h = R.by_document(table(spark, d, "hits"))
    lists = F.array(F.struct(F.lit("s").alias("k"), T.clean_set(F.col("skills")).alias("vs")), F.struct(F.lit("c").alias("k"), F.filter(F.transform(F.coalesce("certifications", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "").alias("vs")))
    each = h.select("doc", F.explode(lists).alias("l")).select("doc", "l.k", F.explode_outer("l.vs").alias("v")).distinct()
    gather = lambda k: F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("v"))))
    return each.groupBy("doc").agg(gather("s").alias("skills"), gather("c").alias("certs"))


@query(f"""WITH g AS (SELECT {_DOC} AS doc, * FROM hits), r AS (SELECT doc, hit_id, highlights, left({Q.strip('content')}, 140) AS head, row_number() OVER (PARTITION BY doc ORDER BY coalesce(score, 0) DESC, hit_id) AS rn FROM g WHERE doc IS NOT NULL),
t AS (SELECT * FROM r WHERE rn <= 8),
m AS (SELECT doc, rn, list_filter(list_transform(flatten(list_transform(map_values(highlights), lambda v: coalesce(v, []))), lambda x: {Q.inline("regexp_replace(x, '<[^>]+>', ' ', 'g')")}), lambda x: x <> '')[1:6] AS ms FROM t WHERE rn <= 4 AND highlights IS NOT NULL),
d1 AS (SELECT doc, rn, list_filter(ms, lambda x, k: list_position(list_transform(ms, lambda y: lower(y)), lower(x)) = k) AS ms FROM m),
p1 AS (SELECT doc, 1 AS src, rn, list_filter(list_transform(string_split(left(array_to_string(ms, ' | '), 1000), '|'), lambda x: {Q.strip('x')}), lambda x: x <> '') AS ps FROM d1),
sk AS (SELECT DISTINCT doc, lower(trim(unnest(skills), ' ')) AS v FROM g WHERE doc IS NOT NULL), s6 AS (SELECT doc, v, row_number() OVER (PARTITION BY doc ORDER BY v COLLATE C) AS rn FROM sk WHERE v <> ''),
ps AS (SELECT doc, src, rn, unnest(ps) AS v, generate_subscripts(ps, 1) AS k FROM p1 UNION ALL SELECT doc, 2, rn, v, 1 FROM s6 WHERE rn <= 6 UNION ALL SELECT doc, 3, rn, head, 1 FROM t WHERE head <> ''),
f AS (SELECT doc, v, src, rn, k, row_number() OVER (PARTITION BY doc, lower(v) ORDER BY src, rn, k) AS again FROM ps WHERE trim(v, ' ') <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY src, rn, k) AS place FROM f WHERE again = 1)
SELECT doc, string_agg(v, ' | ' ORDER BY place) FILTER (place <= 8) AS evidence FROM (SELECT DISTINCT doc FROM g WHERE doc IS NOT NULL) x LEFT JOIN n USING (doc) GROUP BY doc""")
def evidence_agg(spark, d):
    """Highlights of a document's best four chunks, its first six skills and the heads of its best eight chunks: the first eight of these without repeats.

    A blank chunk among the eight has no head; a document without any piece has null. Both windows keep a few rows of a document, never all.
    """
    h = R.by_document(table(spark, d, "hits"))
    w = Window.partitionBy("doc").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "hit_id")
    t = h.select("doc", "hit_id", "score", F.left(T.strip(F.col("content")), F.lit(140)).alias("c"), R.highlight_pieces(F.col("highlights")).alias("e")).withColumn("rn", F.row_number().over(w)).where("rn <= 8")
    t = t.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rn", "c", "e"))).alias("t"))
    s = h.select("doc", F.explode(T.clean_set(F.col("skills"))).alias("v")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("v"))).where("k <= 6")
    s = s.groupBy("doc").agg(F.array_sort(F.collect_list("v")).alias("s"))
    none = F.array().cast("array<string>")
    marked, heads = F.flatten(F.transform(F.slice("t", 1, 4), lambda x: x.e)), F.transform("t", lambda x: F.coalesce(x.c, F.lit("")))
    return t.join(s, "doc", "left").select("doc", R.evidence(F.concat(marked, F.coalesce("s", none), heads)).alias("evidence"))


@query(f"""WITH g AS (SELECT {_DOC} AS doc, coalesce(lex_score, 0) AS l, coalesce(vec_score, 0) AS v, coalesce(semantic_score, 0) AS s FROM hits ),
r AS (SELECT doc, max(round(0.7 * greatest(0, least(1, s / 4)) + 0.2 * greatest(0, least(1, v)) + 0.1 * greatest(0, least(1, l)), 8)) AS rank_score, max(l) AS lex_score, max(v) AS vec_score, count(*) AS n_chunks FROM g WHERE doc IS NOT NULL GROUP BY doc)
SELECT doc AS document_id, rank_score::DOUBLE AS rank_score, lex_score, vec_score, n_chunks FROM r ORDER BY rank_score DESC, doc LIMIT 6""")
def top_candidates(spark, d):
    """The six documents with the best ranked chunk, by the scores of the table."""
    h = R.by_document(table(spark, d, "hits"))
    score = R.rank_score(F.coalesce("semantic_score", F.lit(0.0)), F.col("vec_score"), F.col("lex_score"), None, 8)
    best = h.groupBy("doc").agg(F.max(score).alias("rank_score"), *[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("lex_score", "vec_score")], F.count("*").alias("n_chunks"))
    return best.orderBy(F.desc("rank_score"), "doc").limit(6).withColumnRenamed("doc", "document_id")


@query("""WITH s AS (SELECT hit_id, coalesce(score, 0) AS score FROM hits WHERE list_contains(skills, 'java') AND list_contains(skills, 'docker') ORDER BY 2 DESC, 1 LIMIT 10), n AS (SELECT count(*) AS n FROM s),
r AS (SELECT hit_id, coalesce(score, 0) AS score FROM hits WHERE list_contains(skills, 'java') AND hit_id NOT IN (SELECT hit_id FROM s) ORDER BY 2 DESC, 1 LIMIT 10)
SELECT * FROM (SELECT hit_id, score, false AS relaxed FROM s UNION ALL SELECT hit_id, score, true FROM r, n WHERE n < 8) x ORDER BY relaxed, score DESC, hit_id LIMIT 10""")
def relax_union(spark, d):
    """Hits with both skills; if fewer than eight, those with one of them follow. One row decides; no action is needed."""
    h = table(spark, d, "hits").select("hit_id", F.coalesce("score", F.lit(0.0)).alias("score"), "skills")
    strict = h.where(R.conditions(skills=["java", "docker"])).orderBy(F.desc("score"), "hit_id").limit(10).drop("skills")
    few = strict.agg((F.count("*") < 8).alias("few"))
    more = h.where(R.conditions(skills=["java"])).drop("skills").join(F.broadcast(strict.select("hit_id")), "hit_id", "left_anti").orderBy(F.desc("score"), "hit_id").limit(10)
    more = more.crossJoin(F.broadcast(few)).where("few").drop("few")
    both = strict.withColumn("relaxed", F.lit(False)).unionByName(more.withColumn("relaxed", F.lit(True)))
    return both.orderBy("relaxed", F.desc("score"), "hit_id").limit(10)


@query("""WITH m AS (SELECT hit_id, coalesce(contains(lower(location), 'milano'), false) AS ok FROM hits) SELECT hit_id FROM m WHERE ok OR NOT (SELECT bool_or(ok) FROM m)""")
def soft_filter_location(spark, d):
    return R.filter_or_all(table(spark, d, "hits").select("hit_id", "location"), F.lower("location").contains("milano")).select("hit_id")


@query("""WITH m AS (SELECT hit_id, coalesce(try_cast(nullif(regexp_extract(availability, '([0-9]+)', 1), '') AS INTEGER) <= 30, false) AS ok FROM hits) SELECT hit_id FROM m WHERE ok OR NOT (SELECT bool_or(ok) FROM m)""")
def soft_filter_availability(spark, d):
    return R.filter_or_all(table(spark, d, "hits").select("hit_id", "availability"), T.first_integer(F.col("availability")) <= 30).select("hit_id")


WANTED = ["java", "docker", "power"]
_W = "['java', 'docker', 'power']"
_OWN = "list_sort(list_distinct(list_filter(list_transform(coalesce(skills, []), lambda x: lower(trim(x, ' '))), lambda x: x IS NOT NULL AND x <> '')))"
_SK = f"""o AS (SELECT hit_id, {_OWN} AS own FROM hits), m AS (SELECT hit_id, own, list_filter({_W}, lambda r: list_contains(own, r)) AS exact, list_filter({_W}, lambda r: NOT list_contains(own, r) AND len(list_filter(own, lambda c: contains(c, r) OR contains(r, c))) > 0) AS near FROM o)"""


def _skills(spark, d) -> DataFrame:
    wanted = F.array(*map(F.lit, WANTED))
    return table(spark, d, "hits").select("hit_id", K.skills(wanted, T.clean_set(F.col("skills"))).alias("f"))


@query(f"WITH {_SK} SELECT hit_id, round((len(exact) + 0.7 * len(near)) / 3, 4)::DOUBLE AS score, list_sort(exact) AS matched, list_sort(near) AS semantic_matches FROM m")
def skills_match(spark, d):
    return _skills(spark, d).select("hit_id", "f.*")


@query(f"""WITH o AS (SELECT hit_id, unnest({_OWN}) AS s FROM hits), w AS (SELECT unnest({_W}) AS r) SELECT r, count(DISTINCT hit_id) AS hits FROM o JOIN w ON contains(s, r) OR contains(r, s) GROUP BY r""")
def skills_match_theta(spark, d):
    """Hits per wanted skill by containment; the few wanted ones are an array in each row, not a join."""
    each = table(spark, d, "hits").select("hit_id", F.explode(T.clean_set(F.col("skills"))).alias("s"))
    near = F.filter(F.array(*map(F.lit, WANTED)), lambda r: T.contains_either(F.col("s"), r))
    return each.select("hit_id", F.explode(near).alias("r")).distinct().groupBy("r").agg(F.count("*").alias("hits"))


_ROLE = """b AS (SELECT hit_id, 'senior java developer' AS w, lower(trim(coalesce(role, ''), ' ')) AS o FROM hits), t AS (SELECT *, ['java','developer'] AS a, list_filter(list_distinct(regexp_split_to_array(o, '\\s+')), lambda x: x NOT IN ('', 'junior','mid','middle','senior','lead','principal','staff')) AS c FROM b),
s AS (SELECT *, len(list_intersect(a, c)) / 2.0 AS sh FROM t)"""


@query(f"WITH {_ROLE} SELECT hit_id, CASE WHEN w = o THEN 'exact' WHEN contains(o, w) OR contains(w, o) THEN 'semantic' WHEN sh >= 0.4 THEN 'semantic' WHEN sh > 0 THEN 'partial' ELSE 'none' END AS match, round(CASE WHEN w = o THEN 1.0 WHEN contains(o, w) OR contains(w, o) THEN 0.8 ELSE sh END, 4)::DOUBLE AS score FROM s")
def role_match(spark, d):
    f = K.role(F.lit("senior java developer"), F.lower(F.trim(F.coalesce("role", F.lit("")))))
    return table(spark, d, "hits").select("hit_id", f.alias("f")).select("hit_id", "f.match", "f.score")


@query("""WITH b AS (SELECT hit_id, lower(trim(coalesce(location, ''), ' ')) AS o FROM hits), s AS (SELECT *, len(list_intersect(['reggio','emilia'], regexp_split_to_array(o, '\\s+'))) > 0 AS ov FROM b)
SELECT hit_id, CASE WHEN o = '' THEN 'none' WHEN o = 'reggio emilia' THEN 'exact' WHEN contains(o, 'reggio emilia') OR contains('reggio emilia', o) THEN 'soft' WHEN ov THEN 'weak' ELSE 'none' END AS match, (CASE WHEN o = '' THEN 0 WHEN o = 'reggio emilia' THEN 1 WHEN contains(o, 'reggio emilia') OR contains('reggio emilia', o) THEN 0.6 WHEN ov THEN 0.35 ELSE 0 END)::DOUBLE AS score FROM s""")
def location_match(spark, d):
    f = K.location(F.lit("reggio emilia"), F.lower(F.trim(F.coalesce("location", F.lit("")))), F.lit("onsite"))
    return table(spark, d, "hits").select("hit_id", f.alias("f")).select("hit_id", "f.match", "f.score")


@query("""WITH a AS (SELECT hit_id, try_cast(nullif(regexp_extract(availability, '([0-9]+)', 1), '') AS INTEGER) AS n FROM hits) SELECT hit_id, (CASE WHEN n IS NULL THEN 0 WHEN n <= 30 THEN 1 WHEN n <= 60 THEN 0.6 ELSE 0.2 END)::DOUBLE AS score FROM a""")
def availability_score(spark, d):
    return table(spark, d, "hits").select("hit_id", V.availability_score(T.first_integer(F.col("availability"))).alias("score"))


def features(spark, d) -> DataFrame:
    h = table(spark, d, "hits")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    f = {
        "skills": K.skills(F.array(*map(F.lit, WANTED)), T.clean_set(F.col("skills"))), "role": K.role(F.lit("senior java developer"), low("role")), "location": K.location(F.lit("reggio emilia"), low("location"), F.lit("onsite")),
        "language": K.language(F.lit("italian"), low("language")), "seniority": K.seniority(F.lit("senior"), low("seniority")), "availability": K.availability(F.lit(True), T.first_integer(F.col("availability"))),
    }
    h = h.select("hit_id", F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"), *[c.alias(k) for k, c in f.items()])
    return h


_FEATURES = f"""{_SK}, {_ROLE}, k AS (SELECT hit_id, round((len(exact) + 0.7 * len(near)) / 3, 4)::DOUBLE AS sk FROM m), ro AS (SELECT hit_id, round(CASE WHEN w = o THEN 1.0 WHEN contains(o, w) OR contains(w, o) THEN 0.8 ELSE sh END, 4)::DOUBLE AS ro FROM s),
z AS (SELECT hit_id, lower(trim(coalesce(location, ''), ' ')) AS o, lower(trim(coalesce(language, ''), ' ')) AS l, lower(trim(coalesce(seniority, ''), ' ')) AS e, try_cast(nullif(regexp_extract(availability, '([0-9]+)', 1), '') AS INTEGER) AS n, coalesce(semantic_score, 0) AS ss FROM hits),
x AS (SELECT hit_id, (CASE WHEN o = '' THEN 0 WHEN o = 'reggio emilia' THEN 1 WHEN contains(o, 'reggio emilia') OR contains('reggio emilia', o) THEN 0.6 WHEN len(list_intersect(['reggio','emilia'], regexp_split_to_array(o, '\\s+'))) > 0 THEN 0.35 ELSE 0 END)::DOUBLE AS lo,
(l <> '' AND (contains(l, 'italian') OR contains('italian', l)))::INT::DOUBLE AS la, (e = 'senior')::INT::DOUBLE AS se, (CASE WHEN n IS NULL THEN 0 WHEN n <= 30 THEN 1 WHEN n <= 60 THEN 0.6 ELSE 0.2 END)::DOUBLE AS av, ss FROM z),
f AS (SELECT * FROM k JOIN ro USING (hit_id) JOIN x USING (hit_id))"""


@query(f"WITH {_FEATURES} SELECT hit_id, sk AS skills_score, ro AS role_score, lo AS location_score, la AS language_score, se AS seniority_score, av AS availability_score, list_filter([CASE WHEN sk > 0 THEN 'skills' END, CASE WHEN ro > 0 THEN 'role' END, CASE WHEN lo > 0 THEN 'location' END, CASE WHEN la > 0 THEN 'language' END, CASE WHEN se > 0 THEN 'seniority' END, CASE WHEN av > 0 THEN 'availability' END], lambda v: v IS NOT NULL) AS matched_on FROM f")
def match_features(spark, d):
    names = ("skills", "role", "location", "language", "seniority", "availability")
    return features(spark, d).select("hit_id", *[F.col(f"{n}.score").alias(f"{n}_score") for n in names], K.matched_on({n: F.col(n) for n in names}).alias("matched_on"))


_SCORE = "round((0.5 * sk + 0.25 * ro + 0.1 * lo + 0.05 * se + 0.05 * la + 0.05 * av + CASE WHEN ss > 0 THEN 0.05 * ss / (1 + ss) ELSE 0 END) / (1.0 + CASE WHEN ss > 0 THEN 0.05 ELSE 0 END), 6)::DOUBLE"


def scored(spark, d) -> DataFrame:
    f = features(spark, d)
    on = F.lit(True)
    parts = {n: (on, F.col(f"{n}.score")) for n in ("skills", "role", "location", "seniority", "language", "availability")} | {"semantic": (F.col("semantic_score") > 0, V.saturation(F.col("semantic_score")))}
    return f.withColumn("match_score", K.match_score(parts, 6))


@query(f"""WITH {_FEATURES}, g AS (SELECT hit_id, {_SCORE} AS match_score FROM f ORDER BY 2 DESC, 1 LIMIT 6) SELECT hit_id, CASE WHEN row_number() OVER (ORDER BY match_score DESC, hit_id) <= 3 THEN 'match' ELSE 'extra' END AS place FROM g""")
def answer_cardinality(spark, d):
    """Three main answers and three more."""
    top = scored(spark, d).select("hit_id", "match_score").orderBy(F.desc("match_score"), "hit_id").limit(6)
    rn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("match_score"), "hit_id"))  # six rows
    return top.select("hit_id", F.when(rn <= 3, "match").otherwise("extra").alias("place"))
