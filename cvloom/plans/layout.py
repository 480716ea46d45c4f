"""Queries on layout: spans made of the documents' lines, brought to rows, blocks, elements, markdown and plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import elements as E
from ..operators import layout as L
from . import sql as S
from .registry import query, table

LINES_A_PAGE = 30


def spans(spark, d) -> DataFrame:
    """Every line of a document as a line on a page: the part before ': ' in one or two spans, what follows as a cell to the right, a little lower."""
    each = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "t")).select("doc_id", "idx", F.trim("t").alias("t")).where("t <> ''")
    cut, t = F.instr("t", ": "), F.col("t")
    left, right = F.when(cut > 0, F.left(t, cut)).otherwise(t), F.when(cut > 0, F.trim(F.substring(t, cut + 2, F.length(t))))
    size = F.when(F.col("idx") == 0, 20.0).when((F.length(t) < 25) & ~t.rlike("[.:;,]$"), 15.0).otherwise(11.0)
    z = each.select("doc_id", "idx", (F.floor(F.col("idx") / LINES_A_PAGE) + 1).cast("int").alias("page"), ((F.col("idx") % LINES_A_PAGE) * 14.0).alias("y"), size.alias("size"), left.alias("a"), right.alias("b"))
    gap = F.instr("a", " ")
    head, rest = F.when(gap > 0, F.left("a", gap - 1)).otherwise(F.col("a")), F.when(gap > 0, F.substring(F.col("a"), gap, F.length("a")))
    end = 50.0 + F.length(head) * 5.0
    start = end + F.length("a") % 3
    span = lambda line, n, x0, y, x1, s, text: F.struct(F.lit(line).alias("line_no"), F.lit(n).alias("span_no"), x0.alias("x0"), y.alias("y0"), x1.alias("x1"), s.alias("size"), text.alias("text"))
    y = F.col("y")
    parts = F.array(span(0, 0, F.lit(50.0), y, end, F.col("size"), head), span(0, 1, start, y, start + 40.0, F.col("size"), rest), span(1, 0, F.lit(300.0), y + 2.0, F.lit(400.0), F.lit(11.0), F.col("b")))
    return z.select("doc_id", "page", F.col("idx").alias("block_no"), F.explode(F.filter(parts, lambda p: p["text"].isNotNull())).alias("p")).select("doc_id", "page", "block_no", "p.*")


_ROWS = f"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents WHERE text IS NOT NULL),
z AS (SELECT doc_id, idx, (idx // {LINES_A_PAGE} + 1)::INTEGER AS page, (idx % {LINES_A_PAGE}) * 14.0::DOUBLE AS y, CASE WHEN idx = 0 THEN 20.0 WHEN length(t) < 25 AND NOT regexp_matches(t, '[.:;,]$') THEN 15.0 ELSE 11.0 END::DOUBLE AS size, CASE WHEN strpos(t, ': ') > 0 THEN left(t, strpos(t, ': ')) ELSE t END AS a, CASE WHEN strpos(t, ': ') > 0 THEN trim(substring(t, strpos(t, ': ') + 2), ' ') END AS b FROM l WHERE t <> ''),
h AS (SELECT *, strpos(a, ' ') AS p, {S.strip('a')} = '' AS void_a, coalesce({S.strip('b')}, '') = '' AS void_b FROM z),
c AS (SELECT *, {S.strip("CASE WHEN p > 0 THEN regexp_replace(left(a, p - 1), '" + S.SPACE + "+$', '') || CASE WHEN length(a) % 3 < 1.5 THEN '' ELSE ' ' END || regexp_replace(substring(a, p), '^" + S.SPACE + "+', '') ELSE a END")} AS la FROM h),
sz AS (SELECT doc_id, median(s) AS base FROM (SELECT doc_id, unnest(CASE WHEN void_a THEN [] WHEN p > 0 THEN [size, size] ELSE [size] END::DOUBLE[] || CASE WHEN void_b THEN [] ELSE [11.0] END::DOUBLE[]) AS s FROM h) q GROUP BY 1),
r AS (SELECT doc_id, page, idx, CASE WHEN void_a THEN {S.strip('b')} WHEN void_b THEN la ELSE la || '  ' || {S.strip('b')} END AS text, CASE WHEN void_a THEN 11.0 WHEN void_b THEN size ELSE (size + 11.0) / 2 END::DOUBLE AS size, CASE WHEN void_a THEN y + 2 ELSE y END AS y0, CASE WHEN void_a THEN 300.0 ELSE 50.0 END::DOUBLE AS x0 FROM c WHERE NOT (void_a AND void_b))"""


@query(f"WITH {_ROWS} SELECT doc_id, page, y0, x0, text, size FROM r")
def layout_rows(spark, d):
    """Visual rows of every page: spans joined to lines, lines of one height to rows of cells."""
    return L.rows(L.lines(spans(spark, d))).select("doc_id", "page", "y0", "x0", "text", "size")


_BLOCKS = f"""{_ROWS}, w AS (SELECT r.*, contains(text, '  ') AS wide, size >= 1.15::DOUBLE * base AS big, base FROM r JOIN sz USING (doc_id)),
v AS (SELECT *, CASE WHEN lag(page) OVER o = page AND y0 - lag(y0) OVER o <= 2.5 * greatest(size, lag(size) OVER o, 1.0) AND lag(wide) OVER o = wide AND lag(big) OVER o = big THEN 0 ELSE 1 END AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY page, idx)),
u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY page, idx)::BIGINT AS block FROM v),
bl AS (SELECT doc_id, block, list(text ORDER BY idx) AS lines, avg(size) AS size, any_value(base) AS base, any_value(page) AS page, min_by(y0, idx) AS y0, min_by(x0, idx) AS x0 FROM u GROUP BY 1, 2)"""


def _blocks(spark, d) -> DataFrame:
    s = spans(spark, d)
    return L.blocks(L.rows(L.lines(s)), L.body_sizes(s))


@query(f"WITH {_BLOCKS} SELECT doc_id, block, page, lines, y0 FROM bl")
def layout_blocks(spark, d):
    """Blocks of rows, split by page, gap, columns and size of type."""
    return _blocks(spark, d).select("doc_id", "block", "page", "lines", "y0")


_CELLS = "list_transform(lines, lambda l: list_filter(regexp_split_to_array(trim(l, ' '), '\\s{2,}|\\t+'), lambda x: x <> ''))"
_ELEMENTS = f"""{_BLOCKS}, ce AS (SELECT *, {_CELLS} AS cells, CASE WHEN len(lines) = 1 THEN lines[1] END AS one FROM bl),
ta AS (SELECT *, len(cells) >= 2 AND len(list_filter(cells, lambda x: len(x) < 2)) = 0 AND len(list_distinct(list_transform(cells, lambda x: len(x)))) <= 2 AS is_table, list_max(list_transform(cells, lambda x: len(x))) AS width, coalesce({S.cleaned('one')}, '') AS cl, {S.cleaned("array_to_string(lines, chr(10))")} AS whole FROM ce),
ki AS (SELECT *, CASE WHEN is_table THEN 'table' WHEN coalesce(regexp_matches(one, '{S.MARK}'), false) THEN 'list_item' WHEN one IS NOT NULL AND cl <> '' AND length(cl) <= 120 AND NOT regexp_matches(cl, '[.;,]$') AND NOT regexp_matches(cl, '{S.MARK}') AND (regexp_matches(cl, '{S.NUMBERED}') OR size >= base * 1.2::DOUBLE OR (len(regexp_split_to_array(cl, '\\s+')) <= 10 AND upper(cl) = cl AND lower(cl) <> cl)) THEN 'heading' ELSE 'paragraph' END AS element_type FROM ta),
el AS (SELECT doc_id, block AS idx, element_type, CASE element_type WHEN 'table' THEN NULL WHEN 'list_item' THEN {S.cleaned(f"regexp_replace(one, '{S.MARK}', '')")} ELSE whole END AS text, CASE element_type WHEN 'heading' THEN {S.depth('cl', 'CASE WHEN size / greatest(base, 1) >= 1.8 THEN 1 WHEN size / greatest(base, 1) >= 1.5 THEN 2 ELSE 3 END')} WHEN 'list_item' THEN 1 END AS level,
coalesce(regexp_matches(one, '^[0-9]+[.)]\\s'), false) AS list_ordered, CASE WHEN is_table THEN list_transform(cells, lambda x: list_concat(x, list_transform(range(width - len(x)), lambda y: ''))) END AS rows, page AS page_number FROM ki),
ef AS (SELECT * FROM el WHERE element_type = 'table' OR text <> ''),
ei AS (SELECT *, CASE WHEN element_type = 'paragraph' AND lag(element_type) OVER o = 'paragraph' AND lag(page_number) OVER o = page_number THEN 0 ELSE 1 END AS s FROM ef WINDOW o AS (PARTITION BY doc_id ORDER BY idx)),
eg AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY idx) AS g FROM ei),
e AS (SELECT doc_id, min(idx) AS idx, min_by(element_type, idx) AS element_type, CASE WHEN min_by(element_type, idx) = 'paragraph' AND count(*) > 1 THEN {S.cleaned("string_agg(text, chr(10) || chr(10) ORDER BY idx)")} ELSE min(text) END AS text, min_by(level, idx) AS level, min_by(list_ordered, idx) AS list_ordered, any_value(rows) AS rows, any_value(page_number) AS page_number FROM eg GROUP BY doc_id, g)"""


def _elements(spark, d) -> DataFrame:
    return E.joined_paragraphs(L.elements(_blocks(spark, d)))


@query(f"WITH {_ELEMENTS} SELECT doc_id, idx, element_type, text, level, list_ordered, rows, page_number FROM e")
def layout_elements(spark, d):
    """Elements of the pages: tables, list items, headings by number, size or capitals, and paragraphs."""
    return _elements(spark, d).select("doc_id", "idx", "element_type", "text", "level", "list_ordered", "rows", "page_number")


_KEPT = f"list_filter(rows, lambda r: len(list_filter(r, lambda c: {S.strip('c')} <> '')) > 0)"
_ROW = "'| ' || array_to_string({0}, ' | ') || ' |'"
_TABLE = f"""tb AS (SELECT *, list_transform({_KEPT}, lambda r: list_transform(r, lambda c: replace({S.inline('c')}, '|', '\\|'))) AS kept FROM e),
md AS (SELECT doc_id, idx, CASE element_type WHEN 'heading' THEN repeat('#', greatest(1, least(6, coalesce(level, 1)))) || ' ' || {S.inline('text')} WHEN 'paragraph' THEN {S.paragraph('text')} WHEN 'list_item' THEN CASE WHEN list_ordered THEN '1. ' ELSE '- ' END || {S.inline('text')}
WHEN 'table' THEN array_to_string(list_concat([{_ROW.format('kept[1]')}, {_ROW.format("list_transform(kept[1], lambda c: '---')")}], CASE WHEN len(kept) > 1 THEN list_transform(kept[2:], lambda r: {_ROW.format('r')}) ELSE [{_ROW.format("list_transform(kept[1], lambda c: '')")}] END), chr(10)) END AS p,
CASE WHEN element_type = 'table' THEN array_to_string(list_transform({_KEPT}, lambda r: array_to_string(list_filter(list_transform(r, lambda c: {S.inline('c')}), lambda c: c <> ''), ' | ')), chr(10)) ELSE {S.paragraph('text')} END AS q FROM tb)"""


@query(f"WITH {_ELEMENTS}, {_TABLE} SELECT doc_id, {S.strip('string_agg(p, chr(10) || chr(10) ORDER BY idx)')} AS markdown FROM md WHERE p <> '' GROUP BY doc_id")
def layout_markdown(spark, d):
    """Markdown of the pages, tables with header and rule."""
    return L.rendered(_elements(spark, d), L.markdown_piece(), "markdown")


@query(f"WITH {_ELEMENTS}, {_TABLE}, t AS (SELECT doc_id, {S.strip('string_agg(q, chr(10) || chr(10) ORDER BY idx)')} AS plain FROM md WHERE q <> '' GROUP BY doc_id) SELECT doc_id, length(plain) AS chars, sha256(plain) AS hash FROM t")
def layout_hash(spark, d):
    """Length and hash of the plain text of the pages, by which a document is known."""
    t = L.rendered(_elements(spark, d), L.text_piece(), "plain")
    return t.select("doc_id", F.length("plain").cast("bigint").alias("chars"), T.content_hash(F.col("plain")).alias("hash"))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, idx, t, CASE WHEN idx % 7 = 6 THEN 'image' ELSE 'paragraph' END AS kind, lower({S.inline('t')}) AS n FROM l WHERE t <> ''),
co AS (SELECT doc_id, string_agg(n, ' ' ORDER BY idx) AS corpus FROM (SELECT doc_id, idx, n FROM m WHERE kind = 'image' AND n <> '') i GROUP BY 1),
x AS (SELECT m.*, coalesce(kind = 'paragraph' AND n <> '' AND length(n) <= 48 AND len(string_split(n, ' ')) <= 4 AND contains(' ' || corpus || ' ', ' ' || n || ' '), false) AS dup FROM m LEFT JOIN co USING (doc_id)),
p AS (SELECT *, lag(dup) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM x), g AS (SELECT *, sum(CASE WHEN dup = b THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, r) AS k FROM g) SELECT doc_id, idx, t AS text FROM n WHERE NOT (dup AND k >= 3)""")
def ocr_dup_runs(spark, d):
    """Elements without runs of three or more short paragraphs that the images of their own document repeat (every seventh line is read from an image)."""
    each = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "t")).select("doc_id", "idx", F.trim("t").alias("text")).where("text <> ''")
    image = F.col("idx") % 7 == 6
    e = each.withColumn("element_type", F.when(image, "image").otherwise("paragraph")).withColumn("ocr_text", F.when(image, F.col("text")))
    return L.without_image_repeats(e).select("doc_id", "idx", "text")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, idx, CASE WHEN idx % 5 <> 0 THEN idx // 10 END AS page, CASE WHEN idx % 5 NOT IN (0, 1) THEN length(t)::DOUBLE END AS y, CASE WHEN idx % 2 = 0 THEN (idx % 3)::DOUBLE END AS x FROM l WHERE t <> '')
SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page IS NOT NULL AND y IS NOT NULL THEN 0 WHEN page IS NOT NULL THEN 1 ELSE 2 END, coalesce(page, 0), CASE WHEN page IS NOT NULL AND y IS NOT NULL THEN y ELSE 0 END, CASE WHEN page IS NOT NULL AND y IS NOT NULL THEN coalesce(x, 0) ELSE 0 END, idx) AS place FROM p""")
def reading_order(spark, d):
    """Order of elements with a full place, with a page only and with none."""
    from pyspark.sql import Window

    each = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "t")).where("trim(t) <> ''")
    i = F.col("idx")
    e = each.select("doc_id", "idx", F.when(i % 5 != 0, F.floor(i / 10)).alias("page_number"), F.when(~(i % 5).isin(0, 1), F.length(F.trim("t")).cast("double")).alias("vertical_position"), F.when(i % 2 == 0, (i % 3).cast("double")).alias("horizontal_position"))
    return e.select("doc_id", "idx", F.row_number().over(Window.partitionBy("doc_id").orderBy(*L.reading_order())).alias("place"))
