"""From spans on pages to elements: lines, visual rows, blocks, headings by size, tables and paragraphs; and their rendering.

A page's lines and a document's elements are bounded by the document (25,000 characters), so arrays hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import elements as E
from ..functions import text as T

# Distances in points, and sizes against the body's.
SPAN_GAP, ROW_TOLERANCE, BLOCK_GAP, BLOCK_SIZE, BODY_SIZE = 1.5, 3.0, 2.5, 1.15, 11.0


def lines(spans: DataFrame) -> DataFrame:
    """Lines of spans (doc_id, page, block_no, line_no, span_no, x0, y0, x1, size, text): blank spans are left out; spans that nearly touch join without a blank."""
    s = spans.where(T.strip(F.col("text")) != "")
    w = Window.partitionBy("doc_id", "page", "block_no", "line_no").orderBy("span_no")
    before = F.lag("x1").over(w)
    right, left = F.regexp_replace("text", r"(?U)\s+$", ""), F.regexp_replace("text", r"(?U)^\s+", "")
    piece = F.when(before.isNull(), right).otherwise(F.concat(F.when(F.col("x0") - before < SPAN_GAP, "").otherwise(" "), left))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "piece"))), lambda x: x.piece), "")
    got = s.withColumn("piece", piece).groupBy("doc_id", "page", "block_no", "line_no").agg(T.strip(text).alias("text"), F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(0.0)).alias("size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"))
    return got.where("text <> ''")


def body_sizes(spans: DataFrame) -> DataFrame:
    """doc_id, base: median size of the spans of a document."""
    s = spans.where((T.strip(F.col("text")) != "") & (F.col("size") > 0))
    return s.groupBy("doc_id").agg(F.median("size").alias("base"))


def rows(lines: DataFrame) -> DataFrame:
    """Visual rows of a page: a line joins the row whose first line is near enough in height; cells from left to right, two blanks between."""
    at = F.array_sort(F.collect_list(F.struct("y0", "x0", "block_no", "line_no", "text", "size")))
    p = lines.groupBy("doc_id", "page").agg(at.alias("ls")).withColumn("rs", E.anchored_rows(F.transform("ls", lambda l: l.y0), ROW_TOLERANCE))
    each = p.select("doc_id", "page", F.posexplode(F.arrays_zip("ls", "rs")).alias("pos", "z")).select("doc_id", "page", "pos", F.col("z.rs").alias("row"), "z.ls.*")
    first = lambda c: F.min_by(c, "pos").alias(c)
    cells = F.array_sort(F.collect_list(F.struct("x0", "pos", "text")))
    return each.groupBy("doc_id", "page", "row").agg(first("y0"), first("x0"), F.array_join(F.transform(cells, lambda c: c.text), "  ").alias("text"), F.avg("size").alias("size"))


def blocks(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Blocks of rows: a new one on a new page, after a wide gap, where columns begin or end, or where large type does."""
    w = Window.partitionBy("doc_id").orderBy("page", "row")
    r = rows.join(base, "doc_id", "left").withColumn("base", F.coalesce("base", F.lit(BODY_SIZE)))
    r = r.withColumn("wide", F.col("text").contains("  ")).withColumn("big", F.col("size") >= BLOCK_SIZE * F.col("base"))
    before = lambda c: F.lag(c).over(w)
    same = (before("page") == F.col("page")) & (F.col("y0") - before("y0") <= BLOCK_GAP * F.greatest("size", before("size"), F.lit(1.0))) & (before("wide") == F.col("wide")) & (before("big") == F.col("big"))
    r = r.withColumn("_n", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    r = r.withColumn("block", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.array_sort(F.collect_list(F.struct("row", "text")))
    top = lambda c: F.min_by(c, "row").alias(c)
    return r.groupBy("doc_id", "block").agg(F.transform(line, lambda l: l.text).alias("lines"), F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(0.0)).alias("size"), F.first("base").alias("base"), F.first("page").alias("page"), top("y0"), top("x0"))


def is_heading(t: Column, size: Column, base: Column) -> Column:
    """Whether a line of that size is one: no longer than 120, no end of a sentence, no list; with a number, large, or few words in capitals."""
    loud = (F.size(F.split(t, r"\s+")) <= 10) & (F.upper(t) == t) & (F.lower(t) != t)
    return (t != "") & (F.length(t) <= 120) & ~t.rlike(r"[.;,]$") & ~t.rlike(E.LIST_MARK) & (t.rlike(E.NUMBERING) | (size >= base * 1.2) | loud)


def heading_level(t: Column, size: Column, base: Column) -> Column:
    """Depth of a leading number, else by size against the body."""
    ratio = size / F.greatest(base, F.lit(1.0))
    return F.coalesce(E.number_depth(t), F.when(ratio >= 1.8, 1).when(ratio >= 1.5, 2).otherwise(3))


def elements(blocks: DataFrame) -> DataFrame:
    """Elements of blocks: doc_id, idx, element_type, text, level, list_ordered, rows, page_number and position."""
    whole = F.array_join("lines", "\n")
    one = F.when(F.size("lines") == 1, F.col("lines")[0])
    clean = T.clean_text(one)
    table = E.tables(whole)
    kind = F.when(table.isNotNull(), "table").when(one.rlike(E.LIST_MARK), "list_item").when(is_heading(clean, F.col("size"), F.col("base")), "heading").otherwise("paragraph")
    text = F.when(kind == "list_item", T.clean_text(F.regexp_replace(one, E.LIST_MARK, ""))).when(kind != "table", T.clean_text(whole))
    e = blocks.select(
        "doc_id", F.col("block").alias("idx"), kind.alias("element_type"), text.alias("text"), F.when(kind == "heading", heading_level(clean, F.col("size"), F.col("base"))).when(kind == "list_item", 1).alias("level"),
        F.coalesce(one.rlike(r"^[0-9]+[.)]\s"), F.lit(False)).alias("list_ordered"), table.alias("rows"), F.col("page").alias("page_number"), F.col("y0").alias("vertical_position"), F.col("x0").alias("horizontal_position"),
    )
    return e.where("element_type = 'table' or text <> ''")


def reading_order() -> list[Column]:
    """Order of elements: those with a place by page, height and side, then those with a page, then the rest."""
    placed = F.col("page_number").isNotNull() & F.col("vertical_position").isNotNull()
    kind = F.when(placed, 0).when(F.col("page_number").isNotNull(), 1).otherwise(2)
    return [kind, F.coalesce("page_number", F.lit(0)), F.when(placed, F.col("vertical_position")).otherwise(0.0), F.when(placed, F.coalesce("horizontal_position", F.lit(0.0))).otherwise(0.0), F.col("idx")]


def _filled(rows: Column) -> Column:
    return F.filter(rows, lambda r: F.exists(r, lambda c: T.strip(F.coalesce(c, F.lit(""))) != ""))


def table_markdown(rows: Column) -> Column:
    """Header, rule and body of a table of rows, blank rows left out, shorter ones padded, '|' escaped; "" without any."""
    cell = lambda c: F.replace(T.clean_inline(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))
    kept = F.transform(_filled(rows), lambda r: F.transform(r, cell))
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    even = F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    shown = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    body = F.when(F.size(even) > 1, F.slice(even, 2, F.size(even))).otherwise(F.array(F.array_repeat(F.lit(""), width)))
    lines = F.concat(F.array(shown(even[0]), shown(F.array_repeat(F.lit("---"), width))), F.transform(body, shown))
    return F.when(F.size(kept) > 0, F.array_join(lines, "\n")).otherwise("")


def table_text(rows: Column) -> Column:
    kept = F.transform(_filled(rows), lambda r: F.array_join(F.filter(F.transform(r, lambda c: T.clean_inline(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | "))
    return F.array_join(kept, "\n")


def markdown_piece() -> Column:
    """Markdown of an element; images and unknown kinds have none."""
    kind, t = F.col("element_type"), F.coalesce("text", F.lit(""))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), T.clean_inline(t))).when(kind == "paragraph", T.clean_paragraph(t)).when(kind == "list_item", F.concat(F.when(F.col("list_ordered"), "1. ").otherwise("- "), T.clean_inline(t))).when(kind == "table", table_markdown(F.col("rows"))).otherwise("")


def text_piece() -> Column:
    """Plain text of an element; the hash of a document is taken over these."""
    kind = F.col("element_type")
    return F.when(kind.isin("heading", "paragraph", "list_item"), T.clean_paragraph(F.coalesce("text", F.lit("")))).when(kind == "table", table_text(F.col("rows"))).otherwise("")


def rendered(elements: DataFrame, piece: Column, name: str, key: str = "doc_id") -> DataFrame:
    """Pieces of a document in order, blank ones left out, a blank line between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))), lambda x: x.p)
    return elements.groupBy(key).agg(T.strip(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")).alias(name))


def without_image_repeats(elements: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Elements without runs of so many short paragraphs that stand in the text read from their own document's images (ocr_text)."""
    norm = lambda c: F.lower(T.clean_inline(F.coalesce(c, F.lit(""))))
    seen = norm(F.col("ocr_text"))
    corpus = elements.where((F.col("element_type") == "image") & (seen != "")).groupBy(key)
    corpus = corpus.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", seen.alias("o")))), lambda x: x.o), " ").alias("_corpus"))
    t = norm(F.col("text"))
    short = (F.col("element_type") == "paragraph") & (t != "") & (F.length(t) <= 48) & (F.size(F.split(t, " ")) <= 4)
    e = elements.join(corpus, key, "left")
    repeat = short & F.coalesce(F.contains(F.concat(F.lit(" "), "_corpus", F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))), F.lit(False))
    return E.without_ocr_runs(e, repeat, key, least).drop("_corpus")
