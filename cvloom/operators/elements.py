"""Layout elements of documents: reading, ordering, grouping, rendering and folding into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LIST_MARK = r"^(?:[•*-]|[0-9]+[.)])\s+"
NUMBERING = r"^([0-9]+(?:\.[0-9]+){0,4})\s+"


def number_depth(t: Column) -> Column:
    """Parts of a number at the start of a text, six at most; null without one."""
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\."))))


def is_heading(t: Column) -> Column:
    return (t != "") & (F.length(t) <= 120) & ~t.rlike(r"[.;,]$") & ~t.rlike(LIST_MARK)


def heading_level(t: Column) -> Column:
    """Depth of a leading number, else 3."""
    return F.coalesce(number_depth(t), F.lit(3))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One element per line that is not blank: idx, element_type, text, level, list_ordered."""
    each = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "t")).select(key, "pos", F.trim("t").alias("t")).where("t <> ''")
    t = F.col("t")
    kind = F.when(t.rlike(LIST_MARK), "list_item").when(is_heading(t), "heading").otherwise("paragraph")
    return each.select(
        key, F.col("pos").alias("idx"), kind.alias("element_type"), F.when(kind == "list_item", F.regexp_replace(t, LIST_MARK, "")).otherwise(t).alias("text"),
        F.when(kind == "heading", heading_level(t)).alias("level"), t.rlike(r"^[0-9]+[.)]\s").alias("list_ordered"),
    )


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Elements of a plain text: parts between blank lines. A part of one line is a heading if it looks like one, else maybe a list item; paragraphs that follow one another are one."""
    each = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("idx", "t")).select(key, "idx", T.strip(F.col("t")).alias("t")).where("t <> ''")
    t = F.col("t")
    one, clean = ~t.contains("\n"), T.clean_text(t)
    kind = F.when(one & is_heading(clean), "heading").when(one & t.rlike(LIST_MARK), "list_item").otherwise("paragraph")
    body = F.when(kind == "list_item", T.clean_text(F.regexp_replace(t, LIST_MARK, ""))).otherwise(clean)
    e = each.select(key, "idx", kind.alias("element_type"), body.alias("text"), F.when(kind == "heading", heading_level(clean)).when(kind == "list_item", 1).alias("level"), (one & t.rlike(r"^[0-9]+[.)]\s")).alias("list_ordered"), F.lit(None).cast("int").alias("page_number"))
    return joined_paragraphs(e, key)


def islands(df: DataFrame, key: list[str], order: str, same: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; a run goes on while same holds between a row and the one before."""
    w = Window.partitionBy(*key).orderBy(order)
    start = F.when(same, 0).otherwise(1)
    return df.withColumn("_s", start).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def joined_paragraphs(elements: DataFrame, key: str = "doc_id", between: str = "\n\n") -> DataFrame:
    """Neighbouring paragraphs of one page as one, with a blank line between; other elements stay as they are, with all their columns."""
    w = Window.partitionBy(key).orderBy("idx")
    page = F.col("page_number") if "page_number" in elements.columns else F.lit(0)
    e = elements.withColumn("_p", F.lag("element_type").over(w)).withColumn("_g", F.lag(page).over(w))
    e = islands(e, [key], "idx", (F.col("element_type") == "paragraph") & (F.col("_p") == "paragraph") & F.col("_g").eqNullSafe(page)).drop("_p", "_g")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x.text), between)
    rest = [F.min_by(c, "idx").alias(c) for c in elements.columns if c not in (key, "idx", "text")]
    joined = F.when((F.min_by("element_type", "idx") == "paragraph") & (F.count("*") > 1), T.clean_text(text)).otherwise(F.min_by("text", "idx"))
    return e.groupBy(key, "island").agg(F.min("idx").alias("idx"), joined.alias("text"), *rest)


def without_ocr_runs(elements: DataFrame, duplicate: Column, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Elements without runs of at least so many in which duplicate holds."""
    w = Window.partitionBy(key).orderBy("idx")
    e = elements.withColumn("_d", duplicate).withColumn("_b", F.lag("_d").over(w))
    e = islands(e, [key], "idx", F.col("_d") == F.col("_b"), "_r")
    n = F.count("*").over(Window.partitionBy(key, "_r"))
    return e.withColumn("_n", n).where(~(F.col("_d") & (F.col("_n") >= least))).drop("_d", "_b", "_r", "_n")


def tables(t: Column) -> Column:
    """Cells of a text that is a table (two lines at least, two cells each, at most two widths), padded; else null."""
    rows = F.transform(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), lambda x: F.filter(F.split(F.trim(x), r"\s{2,}|\t+"), lambda c: c != ""))
    widths = F.array_distinct(F.transform(rows, lambda r: F.size(r)))
    good = (F.size(rows) >= 2) & F.forall(rows, lambda r: F.size(r) >= 2) & (F.size(widths) <= 2)
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.array_max(widths) - F.size(r))))
    return F.when(good, padded)


def markdown_line() -> Column:
    """Markdown of an element from its type, text and level."""
    kind, t = F.col("element_type"), F.col("text")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t)).when(kind == "list_item", F.concat(F.when(F.col("list_ordered"), "1. ").otherwise("- "), t)).otherwise(t)


def rendered(elements: DataFrame, piece: Column, between: str, name: str, key: str = "doc_id") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))), lambda x: x.p)
    return elements.groupBy(key).agg(F.array_join(parts, between).alias(name))


def folded_chunks(paragraphs: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Chunks of an array of paragraphs: paragraphs are joined until size is reached, then the last characters go on.

    A last buffer that is not blank is a chunk too, even if it is only the overlap. An overlap of 0 starts anew.
    """
    kept = (lambda b: F.right(b, F.lit(overlap))) if overlap > 0 else (lambda b: F.lit(""))
    zero = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("chunks"))

    def add(acc, p):
        b = F.when(acc.buffer == "", p).otherwise(F.concat(acc.buffer, F.lit("\n\n"), p))
        full = F.length(b) >= size
        return F.struct(F.when(full, kept(b)).otherwise(b).alias("buffer"), F.when(full, F.concat(acc.chunks, F.array(b))).otherwise(acc.chunks).alias("chunks"))

    clean = F.filter(F.transform(paragraphs, lambda p: F.trim(p)), lambda p: p != "")
    return F.aggregate(clean, zero, add, lambda acc: F.when(F.trim(acc.buffer) != "", F.concat(acc.chunks, F.array(acc.buffer))).otherwise(acc.chunks))


def anchored_rows(spots: Column, tolerance: float) -> Column:
    """Rows of an array of sorted numbers: a number joins the row of the first one as long as it is near enough to it."""
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def add(acc, y):
        go = acc.anchor.isNotNull() & (F.abs(y - acc.anchor) <= tolerance)
        row = F.when(go, acc.row).otherwise(acc.row + 1)
        return F.struct(F.when(go, acc.anchor).otherwise(y).alias("anchor"), row.alias("row"), F.concat(acc.rows, F.array(row)).alias("rows"))

    return F.aggregate(spots, zero, add, lambda acc: acc.rows)


def _among(words: list[str]):
    return lambda x: x.isin(*words)


def detected_language(docs: DataFrame, key: str, text: str, stop_words: dict[str, list[str]], default: str) -> DataFrame:
    """Language with most stop words in a text; the first named wins a tie, the default if there are none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zàèéìíîòóùúçñäöüß]+)"), F.lit(1))
    d = docs.withColumn("_t", found)
    for lang, words in stop_words.items():
        d = d.withColumn(f"_{lang}", F.size(F.filter("_t", _among(words))))
    best = F.greatest(*[F.col(f"_{lang}") for lang in stop_words])
    choice = F.when(best == 0, default)
    for lang in stop_words:
        choice = choice.when(F.col(f"_{lang}") == best, lang)
    return d.select(key, choice.alias("lang"), best.alias("hits"))
