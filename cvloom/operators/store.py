"""Keyed tables without MERGE: upserts, deletes, caches, registries and dynamic searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order. Null keys form one key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """base with the last change of each key in the place of its row; new keys are added."""
    last = latest(changes, key, order)
    return base.join(last.select(*key).distinct(), key, "left_anti").unionByName(last)


def delete(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys.select(*on).distinct(), on, "left_anti")


def cached(items: DataFrame, cache: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Hits with what the cache holds, and misses that must be computed."""
    return items.join(cache, on), items.join(cache.select(on), on, "left_anti")


def like_any(columns: list[str], text: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns])


def search(df: DataFrame, q: str | None = None, like: dict[str, str] | None = None, seniority: str | None = None, low: float | None = None, high: float | None = None, limit: int = 20) -> DataFrame:
    """Rows that meet every given condition, the last updated first; the limit is kept from 1 to 50."""
    tests = [like_any(["full_name", "role", "location", "email"], q)] if q else []
    tests += [F.col(c).ilike(f"%{v}%") for c, v in (like or {}).items() if v]
    if seniority:
        tests.append(F.col("seniority") == seniority.lower())
    if low is not None:
        tests.append(F.col("experience_years") >= low)
    if high is not None:
        tests.append(F.col("experience_years") <= high)
    found = reduce(lambda d, t: d.where(t), tests, df)
    return found.orderBy(F.desc_nulls_last("updated_at"), "match_key").limit(max(1, min(50, limit)))


def versions(events: DataFrame, key: list[str], hash_column: str, order: list[str]) -> DataFrame:
    """events with a version per key: 1 at first, one more whenever the hash differs from the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(hash_column).over(w)
    moved = F.when(before.isNotNull() & ~F.col(hash_column).eqNullSafe(before), 1).otherwise(0)
    return events.withColumn("_c", moved).withColumn("version_no", 1 + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def decide(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """What to do with each incoming file (source_path, hash, row_key) given the registry.

    A known hash is skipped with its version; else a known path, else a known row key goes to the next version; else it
    is new with version 1. The three lookups are joins on keys; each takes the greatest version.
    """
    top = lambda k, name: registry.where(F.col(k).isNotNull()).groupBy(k).agg(F.max("version").alias(name))
    j = incoming.join(top("hash", "v_hash"), "hash", "left").join(top("source_path", "v_path"), "source_path", "left").join(top("row_key", "v_row"), "row_key", "left")
    step = F.when(F.col("v_hash").isNotNull(), "skip").when(F.col("v_path").isNotNull() | F.col("v_row").isNotNull(), "update").otherwise("new")
    version = F.coalesce("v_hash", F.col("v_path") + 1, F.col("v_row") + 1, F.lit(1))
    return j.withColumn("decision", step).withColumn("decided_version", version).drop("v_hash", "v_path", "v_row")


def aliases(registry: DataFrame, key: str, path: str, paths: str) -> DataFrame:
    """All known paths of each key, sorted and joined by ';'."""
    each = F.explode(F.concat(F.array(path), F.split(F.coalesce(paths, F.lit("")), ";")))
    p = registry.select(key, each.alias("p")).select(key, F.trim("p").alias("p")).where("p <> ''").distinct()
    return p.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("p")), ";").alias("all_paths"))
