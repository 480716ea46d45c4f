"""Files as rows: scans, format dispatch, DOCX and PDF spans, JSON lines, logs; and the sinks of reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest file that is read.
MOST_BYTES = 10 * 1024 * 1024
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, folder: str, prefix: str | None = None, only_pdf: bool = False) -> DataFrame:
    """Files below a folder with their bytes; the filters use path columns, so unwanted bytes are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if only_pdf:
        reader = reader.option("pathGlobFilter", "*.[pP][dD][fF]")
    found = reader.load(folder).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return found.where(F.col("filename").startswith(prefix)) if prefix else found


def mime(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".pdf"), "application/pdf").when(n.endswith(".docx"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(n.endswith(".txt"), "text/plain")


def file_format(content: Column, kind: Column) -> Column:
    """PDF by type or first bytes, DOCX by type, anything else as text."""
    pdf = (kind == "application/pdf") | (F.substring(content, 1, 4) == F.lit(b"%PDF"))
    return F.when(pdf, "pdf").when(kind.contains("officedocument") | kind.contains("word"), "docx").otherwise("txt")


def accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are neither empty nor too large, and the rejected ones with a reason."""
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too_large")
    marked = files.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are none."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def docx_paragraphs(data: bytes) -> list[tuple[int, str, str, int | None, bool]]:
    """(idx, element_type, text, level, list_ordered) of a DOCX body by the names of paragraph styles; tables are left out.

    Paragraphs that follow one another are one. An unreadable file has none.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_NS}body")
            styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    names = {s.get(f"{WORD_NS}styleId", ""): n.get(f"{WORD_NS}val", "") for s in styles for n in s.findall(f"{WORD_NS}name")}
    out: list[tuple] = []
    for p in body.findall(f"{WORD_NS}p") if body is not None else ():
        text = re.sub(r"[ \t]+", " ", "".join(t.text or "" for t in p.iter(f"{WORD_NS}t"))).strip()
        if not text:
            continue
        style = next((s.get(f"{WORD_NS}val", "") for s in p.iter(f"{WORD_NS}pStyle")), "")
        style = names.get(style, style).lower()
        mark = re.match(r"(?:[•*-]|(\d+)[.)])\s+", text)
        if style.startswith("heading"):
            number = re.search(r"(\d+)$", style)
            out.append((len(out), "heading", text, min(6, max(1, int(number[1]) if number else 1)), False))
        elif mark or "list" in style:
            out.append((len(out), "list_item", text[mark.end() :] if mark else text, 1, bool(mark and mark[1])))
        elif out and out[-1][1] == "paragraph":
            out[-1] = (*out[-1][:2], f"{out[-1][2]}\n\n{text}", *out[-1][3:])
        else:
            out.append((len(out), "paragraph", text, None, False))
    return out


def docx_elements(files: DataFrame) -> DataFrame:
    """Elements of DOCX files (path, content)."""

    def run(batches):
        for part in batches:
            rows = [(p, *e) for p, c in zip(part.path, part.content) for e in docx_paragraphs(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "idx", "element_type", "text", "level", "list_ordered"]).astype({"level": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, idx int, element_type string, text string, level int, list_ordered boolean")


SPANS = "doc_id string, page int, block_no int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double, size double, text string"


def pdf_spans(files: DataFrame, reader: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Spans of PDF files by a pluggable reader: bytes to rows of SPANS without doc_id."""

    def run(batches):
        for part in batches:
            rows = [(p, *s) for p, c in zip(part.path, part.content) for s in reader(bytes(c))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SPANS.split(", ")])

    return files.select("path", "content").mapInPandas(run, SPANS)


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Blocks (doc_id, page, bx0, by0, bx1, by1) that no table (doc_id, page, tx0, ...) covers by more than the share.

    Only boxes of one page meet: the join is on document and page.
    """
    wide = F.greatest(F.lit(0.0), F.least("bx1", "tx1") - F.greatest("bx0", "tx0"))
    high = F.greatest(F.lit(0.0), F.least("by1", "ty1") - F.greatest("by0", "ty0"))
    area = F.greatest(F.lit(1.0), (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")))
    t = tables.select(F.col("doc_id").alias("td"), F.col("page").alias("tp"), "tx0", "ty0", "tx1", "ty1")
    return blocks.join(t, (F.col("doc_id") == F.col("td")) & (F.col("page") == F.col("tp")) & (wide * high > share * area), "left_anti")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """Objects of a JSON-lines file; lines that are none are dropped."""
    found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return found.limit(limit) if limit else found


def messages(texts: DataFrame, schema: str, body: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Queue messages from JSON, or from JSON in base64; those unreadable or without a required field are marked rejected. keep: columns that come along."""
    plain = F.from_json(body, schema)
    coded = F.from_json(F.try_to_binary(body, F.lit("base64")).cast("string"), schema)
    m = texts.select(*(keep or []), F.when(F.trim(body).startswith("{"), plain).otherwise(coded).alias("m"))
    given = m.select(*(keep or []), *[F.col("m")[f].alias(f) for f in (x.split()[0] for x in schema.split(", ")) if f not in (keep or [])])
    bad = F.col("blob").isNull() | F.col("filename").isNull() | F.col("source_path").isNull()
    return given.withColumn("rejected", bad)


def error_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").rlike("(?i)error|exception|traceback"))


# Columns of the evaluation report, in order.
REPORT = [
    "query", "title", "response", "agent_error", "classified_skills", "classified_role", "classified_location", "classified_seniority", "classified_language", "classified_work_mode", "candidates_count", "candidates_names", "search_index_evidence", "classification", "final_score",
    "classification_coherence", "field_completeness", "search_relevance", "candidate_quality", "handling_complexity", "reasoning_classification_coherence", "reasoning_field_completeness", "reasoning_search_relevance", "reasoning_candidate_quality", "reasoning_handling_complexity",
    "classifier_strengths", "classifier_weaknesses", "improvement_suggestion", "query_clarity", "query_complexity", "query_specificity", "query_extractability", "query_root_cause", "query_eval_notes", "latency_seconds", "judge_latency_seconds", "response_id",
]


def report_rows(df: DataFrame, columns: list[str] = REPORT) -> DataFrame:
    """Columns of a report in order; other columns are left out, missing ones are empty."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] = REPORT) -> None:
    """Report as CSV in UTF-8 with a byte order mark before the header; only values that need it are quoted."""
    rows = report_rows(df, columns)
    marked = rows.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    marked.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


# Colours of cells, as in score_colour().
FILLS = {"green": "C6EFCE", "yellow": "FFEB9C", "red": "FFC7CE", "grey": "D9D9D9"}


def workbook(df: DataFrame, score: str = "final_score", most: int = 100_000) -> bytes:
    """A report as XLSX with the score's cell coloured. A workbook is a file for people: more than `most` rows are refused."""
    rows = df.withColumn("_colour", score_colour(F.col(score))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a workbook holds {most} rows at most; write CSV instead")
    from xml.sax.saxutils import escape

    styles = [*FILLS]

    def cell(value, style: int = 0) -> str:
        mark = f' s="{style}"' if style else ""
        if value is None:
            return f"<c{mark}/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c{mark}><v>{value}</v></c>"
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
        return f'<c t="inlineStr"{mark}><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    body = ["<row>" + "".join(map(cell, df.columns)) + "</row>"]
    body += ["<row>" + "".join(cell(r[c], 1 + styles.index(r["_colour"]) if c == score else 0) for c in df.columns) + "</row>" for r in rows]
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    fills = "<fill/><fill/>" + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS.values())
    kinds = "<xf/>" + "".join(f'<xf fillId="{k + 2}" applyFill="1"/>' for k in range(len(FILLS)))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="b" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="report" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts><font/></fonts><fills>{fills}</fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs><cellXfs>{kinds}</cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def score_colour(score: Column) -> Column:
    """Colour of a score from 1 to 5 in a spreadsheet report."""
    return F.when(score.isNull(), "grey").when(score >= 4, "green").when(score >= 3, "yellow").otherwise("red")


def recent(files: DataFrame, n: int) -> DataFrame:
    """The n files changed last."""
    return files.orderBy(F.desc("modificationTime"), "path").limit(n)


def blob_writer(folder: str):
    """Function for foreachPartition: writes rows (blob, content) as files below a folder, each over an older one of its name."""
    import os

    def write(rows):
        for r in rows:
            path = os.path.join(folder, r.blob.lstrip("/"))
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.part", "wb") as out:
                out.write(bytes(r.content))
            os.replace(f"{path}.part", path)  # a task that runs again leaves the same file

    return write


def delete_blob(spark: SparkSession, path: str) -> bool:
    """Whether a file was there; deleting one that is not is no error. Works on every file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there; for the few of one batch."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return [x for x in paths if (p := jvm.org.apache.hadoop.fs.Path(x)).getFileSystem(conf).exists(p)]


def tailed(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Stream of the lines of log files that tell of errors, appended as text."""
    lines = spark.readStream.text(folder)
    return error_lines(lines).writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
