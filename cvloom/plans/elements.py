"""Queries on layout elements and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import elements as E
from . import sql as S
from .registry import query, table

# Stop words by which a document's language is detected.
STOP_WORDS = {"it": "il lo la i gli le un una uno di del della delle che per con nel nella nelle".split(), "en": "the and of to in for with on from".split()}

_MARK = "^(?:[•*-]|[0-9]+[.)])\\s+"
_LINES = f"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(t, '{_MARK}') THEN 'list_item' WHEN length(t) <= 120 AND NOT regexp_matches(t, '[.;,]$') THEN 'heading' ELSE 'paragraph' END AS element_type FROM l WHERE t <> ''),
e AS (SELECT doc_id, idx, element_type, CASE WHEN element_type = 'list_item' THEN regexp_replace(t, '{_MARK}', '') ELSE t END AS text,
CASE WHEN element_type = 'heading' THEN {S.depth('t', '3')} END AS level,
regexp_matches(t, '^[0-9]+[.)]\\s') AS list_ordered FROM k)"""


def _elements(spark, d):
    return E.lines(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {_LINES} SELECT * FROM e")
def line_elements(spark, d):
    return _elements(spark, d)


@query(f"""WITH s AS (SELECT doc_id, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) - 1 AS idx, {S.strip("unnest(regexp_split_to_array(text, '\\n\\s*\\n'))")} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, strpos(t, chr(10)) = 0 AS one, {S.cleaned('t')} AS cl FROM s WHERE t <> ''),
k AS (SELECT *, CASE WHEN one AND cl <> '' AND length(cl) <= 120 AND NOT regexp_matches(cl, '[.;,]$') AND NOT regexp_matches(cl, '{S.MARK}') THEN 'heading' WHEN one AND regexp_matches(t, '{S.MARK}') THEN 'list_item' ELSE 'paragraph' END AS element_type FROM c),
e AS (SELECT doc_id, idx, element_type, CASE WHEN element_type = 'list_item' THEN {S.cleaned(f"regexp_replace(t, '{S.MARK}', '')")} ELSE cl END AS text, CASE element_type WHEN 'heading' THEN {S.depth('cl', '3')} WHEN 'list_item' THEN 1 END AS level, one AND regexp_matches(t, '^[0-9]+[.)]\\s') AS list_ordered FROM k),
p AS (SELECT *, CASE WHEN element_type = 'paragraph' AND lag(element_type) OVER (PARTITION BY doc_id ORDER BY idx) = 'paragraph' THEN 0 ELSE 1 END AS s FROM e), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS g FROM p)
SELECT doc_id, min(idx) AS idx, min_by(element_type, idx) AS element_type, CASE WHEN count(*) > 1 THEN {S.cleaned("string_agg(text, chr(10) || chr(10) ORDER BY idx)")} ELSE min(text) END AS text, min_by(level, idx) AS level, min_by(list_ordered, idx) AS list_ordered FROM g GROUP BY doc_id, g""")
def txt_elements(spark, d):
    """Elements of the documents read as plain text."""
    return E.sections(table(spark, d, "documents").select("doc_id", "text")).drop("island", "page_number")


@query(f"""WITH {_LINES}, p AS (SELECT *, lag(element_type) OVER (PARTITION BY doc_id ORDER BY idx) AS b, idx // 10 AS page, lag(idx // 10) OVER (PARTITION BY doc_id ORDER BY idx) AS bp FROM e),
g AS (SELECT *, sum(CASE WHEN element_type = 'paragraph' AND b = 'paragraph' AND page = bp THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM p)
SELECT doc_id, island::BIGINT AS island, min(idx) AS idx, min(element_type) AS element_type, CASE WHEN count(*) > 1 THEN {S.cleaned("string_agg(text, chr(10) || chr(10) ORDER BY idx)")} ELSE min(text) END AS text FROM g GROUP BY doc_id, island""")
def coalesce_paragraphs(spark, d):
    """Neighbouring paragraphs of one page as one (ten lines a page)."""
    e = _elements(spark, d).withColumn("page_number", F.floor(F.col("idx") / 10))
    return E.joined_paragraphs(e).select("doc_id", "island", "idx", "element_type", "text")


@query("""WITH t AS (SELECT o_custkey, string_agg(o_orderkey || '  ' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '  x' ELSE '' END, chr(10) ORDER BY o_orderkey) AS txt FROM orders GROUP BY 1),
r AS (SELECT o_custkey, list_transform(string_split(txt, chr(10)), lambda l: regexp_split_to_array(l, '\\s{2,}')) AS rows FROM t)
SELECT o_custkey, CASE WHEN len(rows) >= 2 THEN list_transform(rows, lambda x: list_concat(x, list_transform(range(list_max(list_transform(rows, lambda y: len(y))) - len(x)), lambda z: ''))) END AS cells FROM r""")
def table_detect(spark, d):
    """Tables found in texts made of each customer's orders, one a line."""
    line = F.concat(F.col("o_orderkey"), F.lit("  "), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, "  x").otherwise(""))
    txt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x.l), "\n")
    t = table(spark, d, "orders").groupBy("o_custkey").agg(txt.alias("t"))
    return t.select("o_custkey", E.tables(F.col("t")).alias("cells"))


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, sum(CASE WHEN gap <= 3600000000 AND event_type = b THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS block FROM s""")
def lag_sessionize(spark, d):
    """Blocks of events of a user: a new one after an hour or when the type changes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    start = F.when((gap <= 3_600_000_000) & (F.col("event_type") == F.lag("event_type").over(w)), 0).otherwise(1)
    e = table(spark, d, "events").withColumn("s", start)
    return e.select("user_id", "event_id", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("block"))


@query("""WITH RECURSIVE y AS (SELECT l_orderkey AS k, list_sort(list(l_quantity)) AS ys FROM lineitem GROUP BY 1),
f AS (SELECT k, ys, 1 AS i, NULL::DOUBLE AS a, 0 AS r, []::INTEGER[] AS rows FROM y
UNION ALL SELECT k, ys, i + 1, CASE WHEN a IS NOT NULL AND abs(ys[i] - a) <= 3.0 THEN a ELSE ys[i] END, CASE WHEN a IS NOT NULL AND abs(ys[i] - a) <= 3.0 THEN r ELSE r + 1 END, list_append(rows, CASE WHEN a IS NOT NULL AND abs(ys[i] - a) <= 3.0 THEN r ELSE r + 1 END) FROM f WHERE i <= len(ys))
SELECT k AS l_orderkey, rows FROM f WHERE i = len(ys) + 1""")
def anchor_sessionize(spark, d):
    """Visual rows of spots by their distance from the first of the row (an order's quantities as heights)."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("ys"))
    return t.select("l_orderkey", E.anchored_rows(F.col("ys"), 3.0).alias("rows"))


_MD = "CASE WHEN element_type = 'heading' THEN repeat('#', greatest(1, least(6, coalesce(level, 1)))) || ' ' || text WHEN element_type = 'list_item' THEN CASE WHEN list_ordered THEN '1. ' ELSE '- ' END || text ELSE text END"


@query(f"WITH {_LINES} SELECT doc_id, string_agg({_MD}, chr(10) || chr(10) ORDER BY idx) AS markdown FROM e GROUP BY doc_id")
def render_markdown(spark, d):
    return E.rendered(_elements(spark, d), E.markdown_line(), "\n\n", "markdown")


@query(f"WITH {_LINES} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS plain FROM e GROUP BY doc_id")
def render_text(spark, d):
    return E.rendered(_elements(spark, d), F.col("text"), "\n\n", "plain")


@query(f"WITH {_LINES} SELECT doc_id, arg_min(text, idx) AS title FROM e WHERE element_type = 'heading' GROUP BY doc_id")
def first_heading(spark, d):
    return _elements(spark, d).where("element_type = 'heading'").groupBy("doc_id").agg(F.min_by("text", "idx").alias("title"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS elements, count(*) FILTER (element_type = 'heading') AS headings, count(*) FILTER (element_type = 'list_item') AS items FROM e GROUP BY doc_id")
def element_counts(spark, d):
    k = F.col("element_type")
    return _elements(spark, d).groupBy("doc_id").agg(F.count("*").alias("elements"), F.count_if(k == "heading").alias("headings"), F.count_if(k == "list_item").alias("items"))


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, idx, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, idx, n::BIGINT AS n FROM r WHERE before < 12000""")
def lang_sample_prefix(spark, d):
    """Leading elements of a document up to and with the one that crosses 12,000 characters."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    e = _elements(spark, d).withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    return e.where("before < 12000").select("doc_id", "idx", F.length("text").cast("bigint").alias("n"))


def _in(lang):
    return "len(list_filter(t, lambda x: x IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS[lang]) + ")))"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zàèéìíîòóùúçñäöüß]+') AS t FROM documents), s AS (SELECT doc_id, {_in('it')} AS a, {_in('en')} AS b FROM w)
SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'en' WHEN a >= b THEN 'it' ELSE 'en' END AS lang, greatest(a, b) AS hits FROM s""")
def lang_detect(spark, d):
    out = E.detected_language(table(spark, d, "documents"), "doc_id", "text", STOP_WORDS, "en")
    return out.withColumn("hits", F.col("hits").cast("bigint"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, ps, 1 AS i, '' AS b, []::VARCHAR[] AS c FROM p
UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(n) >= 2000 THEN right(n, 200) ELSE n END, CASE WHEN length(n) >= 2000 THEN list_append(c, n) ELSE c END FROM (SELECT *, CASE WHEN b = '' THEN ps[i] ELSE b || chr(10) || chr(10) || ps[i] END AS n FROM f WHERE i <= len(ps)) x)
SELECT doc_id, CASE WHEN trim(b, ' ') <> '' THEN list_append(c, b) ELSE c END AS chunks FROM f WHERE i = len(ps) + 1""")
def chunk_fold(spark, d):
    """Chunks of 2,000 characters with 200 of overlap over the lines of each document."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", E.folded_chunks(F.split("text", "\n"), 2000, 200).alias("chunks"))


@query("""WITH l AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), a AS (SELECT avg(n) AS mean_chars, median(n) AS median_chars, count(*) FILTER (n > 2000) * 1.0 / count(*) AS share FROM l)
SELECT round(mean_chars, 6) AS mean_chars, median_chars::DOUBLE AS median_chars, round(share, 6)::DOUBLE AS share, CASE WHEN share = 0 THEN 'no_chunking' WHEN share < 0.15 THEN 'chunk_long_only' ELSE 'chunk_all' END AS advice FROM a""")
def length_stats(spark, d):
    n = table(spark, d, "documents").where("text is not null").select(F.length("text").alias("n"))
    a = n.agg(F.avg("n").alias("mean_chars"), F.median("n").alias("median_chars"), (F.count_if(F.col("n") > 2000) / F.count("*")).alias("share"))
    advice = F.when(F.col("share") == 0, "no_chunking").when(F.col("share") < 0.15, "chunk_long_only").otherwise("chunk_all")
    return a.select(F.round("mean_chars", 6).alias("mean_chars"), "median_chars", F.round("share", 6).alias("share"), advice.alias("advice"))
