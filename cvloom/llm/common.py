"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one word: a longest run of Unicode letters and digits.
WORD = r"[\p{L}\p{Nd}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; without one the operators that write tables refuse to run."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _hadoop_dir(spark)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return path


def _hadoop_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again; survives lost executors and is columnar."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_file(spark: SparkSession, data: bytes, name: str, fetch: bool | None = None):
    """Function that gives, on any machine, the path of a file with these bytes.

    A folder that all machines mount is used as it is. From any other file system (or with fetch) Spark brings the file to
    every executor.
    """
    url = urlparse(work_dir(spark))
    own = f"{name}-{uuid.uuid4().hex}"
    if not fetch and url.scheme in ("", "file"):
        folder = os.path.join(url.path, "cvloom-files")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, own)
        with open(path, "wb") as out:
            out.write(data)
        return lambda: path
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark).rstrip('/')}/cvloom-files/{own}")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(where.toString())

    def fetched() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(own)

    return fetched


def words(col) -> "F.Column":
    """Lower-cased words of a text, repeats kept."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"({WORD})"), F.lit(1))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Enough partitions for a Python stage when the input is a single small file; larger inputs keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    least = least or cores
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(least) if parts < max(2, least // 2) else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (src, dst) as rows (id, component); component is the least id.

    Alternates large-star and small-star, each a group-by of links by vertex in which a vertex sends its neighbours to
    the least of them. The least neighbour is an aggregate and comes back by a join, so that no task collects a
    vertex's links. Every few rounds the links are written to the shared folder. Nulls and self links are dropped, an
    empty input gives an empty output.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null and u <> v")
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:  # every round shortens the paths; the links stay as they are once each leads to the least of its component
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = saved(small.where("u <> v").distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    heads = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return heads.unionByName(heads.select(F.col("component").alias("id"), "component").distinct())
