"""Relational tables over JDBC and the chunk table's definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHUNK_SCHEMA = """id STRING, document_id STRING, full_name STRING, role STRING, location STRING, skills ARRAY<STRING>, certifications ARRAY<STRING>, seniority STRING, experience_years DOUBLE, language STRING, availability STRING, version INT, chunk_index INT, section STRING, content STRING, source_path STRING, processed_at TIMESTAMP, content_hash STRING, embedding ARRAY<FLOAT>"""


def settings(text: str | None, **given: str) -> dict[str, str]:
    """Settings of a connection string 'k=v;k=v'; values given by name come first."""
    parts = (p.split("=", 1) for p in (text or "").split(";") if "=" in p)
    return {k.strip().lower(): v.strip() for k, v in parts} | {k.lower(): v for k, v in given.items() if v}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC, read in parallel ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def connection(env: dict[str, str], text: str | None = None, **defaults: str) -> dict[str, str]:
    """Settings of a database: those of the environment (DB_HOST and so on) come first, then the connection string's, then the defaults."""
    given = {k[3:].lower(): v for k, v in env.items() if k.startswith("DB_") and v}
    return {k.lower(): v for k, v in defaults.items()} | settings(text) | given


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 5000, parts: int = 16, **options: str) -> None:
    """Rows to a table over JDBC in batches, over a bounded number of connections."""
    df.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()


def create_chunk_table(spark: SparkSession, name: str, buckets: int = 64) -> None:
    """The chunk table, bucketed by document so that group-bys and joins by document need no shuffle."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({CHUNK_SCHEMA}) USING parquet CLUSTERED BY (document_id) INTO {int(buckets)} BUCKETS")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def clear_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")
