"""Untyped extractions brought to typed, enriched rows, merged with what is known, and written as front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

# Form of an address of mail that is accepted.
MAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SKILLS = "array<struct<name:string,level:string>>"
NONE = "array<string>"


def periods(c: Column) -> Column:
    """Periods as dates; those with neither end given are dropped, unreadable ends are null."""
    given = F.filter(F.coalesce(c, F.array().cast("array<struct<start_date:string,end_date:string>>")), lambda x: (F.coalesce(x.start_date, F.lit("")) != "") | (F.coalesce(x.end_date, F.lit("")) != ""))
    return F.transform(given, lambda x: F.struct(V.strict_date(x.start_date).alias("start_date"), V.strict_date(x.end_date).alias("end_date")))


def skills(c: Column) -> Column:
    """Skills with names in lower case, blank ones left out, the first of equal names kept, sorted by name."""
    clean = F.filter(F.transform(F.coalesce(c, F.array().cast(SKILLS)), lambda s: F.struct(F.lower(F.trim(F.coalesce(s["name"], F.lit("")))).alias("name"), F.nullif(F.trim(s["level"]), F.lit("")).alias("level"))), lambda s: s["name"] != "")
    first = F.filter(clean, lambda s, k: F.array_position(F.transform(clean, lambda x: x["name"]), s["name"]) == k + 1)
    return F.array_sort(first)


def strings(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast(NONE)), lambda x: F.trim(x)), lambda x: x != "")


def typed(raw: DataFrame, today: Column, keep: list[str]) -> DataFrame:
    """All fields of an extraction in their types, with age, years of experience and seniority; keep: key columns.

    Blank texts are null; a mail that is none is null and marked in bad_email, so that its row can be set aside.
    """
    text = lambda c: T.blank_to_null(F.col(c)).alias(c)
    mail = F.trim("email")
    r = raw.select(
        *keep, T.blank_to_null(F.col("name")).alias("full_name"), text("role"), text("location"), F.when(mail.rlike(MAIL), F.lower(mail)).alias("email"), (F.coalesce(mail != "", F.lit(False)) & ~F.coalesce(mail.rlike(MAIL), F.lit(False))).alias("bad_email"), text("phone"), text("language"),
        V.strict_date(F.col("birth_date")).alias("birth_date"), skills(F.col("skills")).alias("skills"), strings(F.col("education_titles")).alias("education_titles"), strings(F.col("certifications")).alias("certifications"), periods(F.col("employment_dates")).alias("employment_dates"),
    )
    r = r.withColumn("age", V.age(F.col("birth_date"), today)).withColumn("experience_years", V.years_of(F.col("employment_dates"), today))
    return r.withColumn("seniority", V.seniority(F.col("experience_years")))


def _entries(items: Column, fields: list[str]) -> Column:
    """List of structs as entries: the first field after a dash, the others below it."""
    def entry(x: Column) -> Column:
        parts = [F.concat(F.lit(("  - " if k == 0 else "    ") + f"{f}: "), T.yaml_scalar(x[f].cast("string"))) for k, f in enumerate(fields)]
        return F.concat_ws("\n", *parts)

    return F.transform(items, entry)


def front_matter() -> Column:
    """Front matter of a row with the 17 keys in their order: scalars, lists of texts and of structs, and nested maps."""
    scalar = lambda k, c, pad="": F.array(F.concat(F.lit(f"{pad}{k}: "), T.yaml_scalar(c.cast("string"))))
    head = lambda k: F.array(F.lit(f"{k}:"))
    texts = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(NONE)), lambda x: F.concat(F.lit("  - "), T.yaml_scalar(x)))
    candidate = [scalar(k, F.col(k), "  ") for k in ("full_name", "role", "location", "email", "phone", "birth_date", "age", "availability", "seniority")]
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), T.yaml_scalar(e["value"])))
    lines = F.concat(
        F.array(F.lit("---")), scalar("document_id", F.col("document_id")), head("source_paths"), texts("source_paths"), *[scalar(k, F.col(k)) for k in ("version", "hash", "processed_at", "language")], head("candidate"), *candidate,
        head("skills"), _entries(F.col("skills"), ["name", "level"]), head("certifications"), texts("certifications"), head("education_titles"), texts("education_titles"), head("languages_spoken"), _entries(F.col("languages_spoken"), ["lang", "level"]), scalar("experience_years", F.col("experience_years")),
        head("employment_dates"), _entries(F.col("employment_dates"), ["start_date", "end_date"]), head("images"), _entries(F.col("images"), ["blob_path", "description"]), *[scalar(k, F.col(k)) for k in ("element_count", "image_count")], head("metadata"), pairs, F.array(F.lit("---"), F.lit("")),
    )
    return F.array_join(lines, "\n")


def with_front_matter(front: Column, markdown: Column) -> Column:
    """Markdown whose front matter, if any, gives way to a new one; the body stays as it is."""
    return F.concat(front, F.lit("\n"), T.strip_front_matter(markdown))


def first_of(sources: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Each field's first filled value over the sources in order, then by their column k; null where none has it. One partial aggregation."""
    out = None
    for rank, s in enumerate(sources):
        part = s.select(key, F.lit(rank).alias("rank"), F.col("k").cast("bigint").alias("k"), *[(T.blank_to_null(F.col(f)) if f in s.columns else F.lit(None).cast("string")).alias(f) for f in fields])
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.struct("rank", "k"))).alias(f) for f in fields])
