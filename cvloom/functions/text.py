"""Column functions on text: cleaning, keys, markers and small parsers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest text that is kept of a document.
TEXT_LIMIT = 25_000


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither null nor blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def clean_inline(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_paragraph(c: Column) -> Column:
    """CRLF as newline, at most one empty line in a row, every line trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(c, "\n"), strip), "\n"))


def join_abbreviations(c: Column) -> Column:
    """'S . R . L' as 'S.R.L': a spaced full stop between single capitals loses its spaces."""
    return F.regexp_replace(c, r"(?<=[A-Z]) \. (?=[A-Z](?![a-zA-Z]))", ".")


def clean_text(c: Column) -> Column:
    """Document text: no NUL, abbreviations joined, blanks and empty lines collapsed, bounded length."""
    c = join_abbreviations(F.translate(c, "\0", ""))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.left(strip(c), F.lit(TEXT_LIMIT))


def html_strip(c: Column) -> Column:
    return clean_inline(F.regexp_replace(c, "<[^>]+>", " "))


def drop_controls(c: Column) -> Column:
    return clean_inline(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"[\x00-\x1F\x7F-\x9F]", ""))


def heading(c: Column) -> Column:
    return strip(F.regexp_replace(clean_inline(c), r"[.,:;!?]+$", ""))


def document_id(filename: Column) -> Column:
    """File name without extension and version suffix."""
    name = F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]+$", "")
    name = F.regexp_replace(name, r"(?i)[_\-\s]?(?:vers(?:ione)?|rev|v)[_\-\s]*[0-9]+$", "")
    return F.regexp_replace(name, r"^[_\- .]+|[_\- .]+$", "")


def registry_id(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-"))


def partition_key(path: Column) -> Column:
    key = F.left(F.replace(F.lower(F.trim(path)), F.lit("/"), F.lit("_")), F.lit(128))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("default")).otherwise(key)


def safe_id(c: Column) -> Column:
    """Letters, digits, '-' and '_' kept, anything else as '-'; 'doc' if nothing remains."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.when(kept == "", F.lit("doc")).otherwise(kept)


def chunk_id(doc: Column, version: Column, index: Column) -> Column:
    return F.format_string("%s-v%d-%05d", safe_id(doc), version, index)


def blob_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(folder, "^/+|/+$", ""), F.regexp_replace(name, "^/+", ""))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def content_hash(c: Column) -> Column:
    """SHA-256 of a text; null for an empty one."""
    return F.when(F.length(c) > 0, F.sha2(c, 256))


def signature(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("", *parts), 256), F.lit(12))


def strip_front_matter(c: Column) -> Column:
    """Body after a leading block between '---' lines; the whole text if the block is not closed."""
    end = F.locate("\n---\n", c, 5)
    return F.when(c.startswith("---\n") & (end > 0), F.substring(c, end + 5, F.length(c))).otherwise(c)


def yaml_scalar(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(c.isNull(), F.lit("''")).when(c.rlike(r"[\s:]"), quoted).otherwise(c)


# Forms of an address of mail and of a telephone number, letters of any script.
MAIL, PHONE = r"(?U)[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}", r"(?U)\+?\d[\d\s().-]{6,}\d"


def first_email(c: Column) -> Column:
    return F.regexp_substr(c, F.lit(MAIL))


def first_phone(c: Column) -> Column:
    return F.regexp_substr(c, F.lit(PHONE))


# How a request states years of experience.
NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
YEARS = r"\s*(?:anni?|years?)\b"
RANGES = [rf"\btra\s+{NUMBER}\s+e\s+{NUMBER}{YEARS}", rf"\b{NUMBER}\s*[-–]\s*{NUMBER}{YEARS}"]
LEAST = [rf"\balmeno\s+{NUMBER}{YEARS}", rf"\bda\s+{NUMBER}{YEARS}", rf"\b{NUMBER}\s*\+\s*(?:anni?|years?)\b", rf"\b{NUMBER}\s*(?:anni?|years?)\s*(?:di )?esperienz"]
MOST = [rf"\bmassimo\s+{NUMBER}{YEARS}", rf"\bentro\s+{NUMBER}{YEARS}", rf"\bfino a\s+{NUMBER}{YEARS}"]


def _found(c: Column, pattern: str, group: int) -> Column:
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", F.replace(got, F.lit(","), F.lit(".")).try_cast("double"))


def experience_bounds(c: Column) -> tuple[Column, Column]:
    """Least and most years of experience that a request asks for: a range first, else single bounds."""
    c = F.lower(c)
    ranged = F.coalesce(*[_found(c, p, 1) for p in RANGES])
    low = F.coalesce(ranged, *[_found(c, p, 1) for p in LEAST])
    high = F.when(ranged.isNotNull(), F.coalesce(*[_found(c, p, 2) for p in RANGES])).otherwise(F.coalesce(*[_found(c, p, 1) for p in MOST]))
    return low, high


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def norm_list(c: Column) -> Column:
    """Comma-separated text as a list of trimmed lower-case items without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def clean_set(c: Column) -> Column:
    """Array as a sorted set of trimmed lower-case items without nulls and blanks."""
    lowered = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(lowered, lambda x: x.isNotNull() & (x != ""))))


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)
