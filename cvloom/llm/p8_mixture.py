"""Problem 8: a mixture in which each source has its target share of all tokens.

The size is the largest at which no source needs more copies than it may have. Each source is cut into blocks of
documents. Whole rounds take every block; the rest of a quota takes blocks in permuted order, the last one in part. A
splitting tree over the output shards gives each half its number of blocks by a multivariate hypergeometric draw of the
sources, down to single shards. A shard then gets the next blocks of each source's permutation, so blocks are disjoint,
and is shuffled by itself.

Rows of null source or of a source without target, and documents without tokens, take no part. A source without tokens
gets share 0 and does not bound the size. Repeated doc_ids are documents of their own; an empty table gives an empty mixture.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .p7_encode import TOKENIZERS, with_lengths

#: Tokens of a block and of a shard, and the numbers that the driver handles at most; blocks and shards grow beyond.
BLOCK_TOKENS, SHARD_TOKENS = 20_000, 250_000
MOST_BLOCKS, MOST_SHARDS = 50_000, 20_000
SEED = 42


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources); columns sum to counts."""
    out = np.zeros((shards, len(counts)), int)
    stack = [(0, shards, counts)]
    while stack:
        a, b, own = stack.pop()
        if b - a == 1:
            out[a] = own
            continue
        middle = (a + b) // 2
        left = rng.multivariate_hypergeometric(own, int(round(own.sum() * (middle - a) / (b - a))))
        stack += [(middle, b, own - left), (a, middle, left)]
    return out


def plan(blocks: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], seed: int = SEED):
    """(block assignments (source, block, copy, shard, tokens wanted or None for all), total tokens aimed at).

    blocks: (source, block, tokens); targets: (source, share, repeats).
    """
    own: dict[str, list[tuple[int, int]]] = {}
    for s, k, n in sorted(blocks):
        own.setdefault(s, []).append((k, n))
    able = [(s, w, m) for s, w, m in targets if w > 0 and m > 0 and s in own]
    if not able:
        return [], 0.0
    size = {s: sum(n for _, n in own[s]) for s, _, _ in able}
    total = min(m * size[s] / w for s, w, m in able)
    rng = np.random.default_rng(seed)
    drawn: dict[str, list[tuple[int, int, int | None]]] = {}
    for s, w, m in sorted(able):
        quota = w * total
        rounds = min(m, int(quota / size[s] + 1e-9))
        rest = quota - rounds * size[s] if rounds < m else 0.0
        taken = [(k, c, None) for c in range(1, rounds + 1) for k, _ in own[s]]
        for at in rng.permutation(len(own[s])):
            if rest < 0.5:
                break
            k, n = own[s][at]
            taken.append((k, rounds + 1, None if n <= rest else int(round(rest))))
            rest -= min(n, rest)
        drawn[s] = [taken[i] for i in rng.permutation(len(taken))]
    names = sorted(drawn)
    counts = np.array([len(drawn[s]) for s in names])
    shards = int(max(1, min(MOST_SHARDS, math.ceil(total / SHARD_TOKENS), counts.sum())))
    table = split(counts, shards, rng)
    out = []
    for j, s in enumerate(names):
        owner = np.repeat(np.arange(shards), table[:, j])
        out += [(s, k, c, int(shard), want) for (k, c, want), shard in zip(drawn[s], owner)]
    return out, total


def mixture(docs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, n_tokens, copy, shard, position), and the report of shares by source."""
    spark = docs.sparkSession
    goal = [(r.source, r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()]  # one row a source
    known = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").select("doc_id", "source", "text")
    sized = common.saved(with_lengths(known, folder=folder).where("n_tokens > 0"), "sizes")
    size = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    unit = max(BLOCK_TOKENS, math.ceil(sum(size.values()) / MOST_BLOCKS))
    cut = [(s, max(1, math.ceil(n / unit))) for s, n in size.items()]
    number = F.broadcast(spark.createDataFrame(cut, "source string, blocks int"))
    blocked = sized.join(number, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int")).drop("blocks")
    blocks = [(r.source, r.block, r.n) for r in blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect()]
    assigned, _ = plan(blocks, goal, seed)
    where = spark.createDataFrame(assigned, "source string, block int, copy int, shard int, want long")  # MOST_BLOCKS times the repeats at most
    rows = blocked.join(F.broadcast(where), ["source", "block"])
    # A block taken in part gives its documents in permuted order as far as the wanted tokens go.
    order = F.xxhash64("doc_id", "copy", F.lit(seed + 1))
    whole, part = rows.where("want is null"), rows.where("want is not null")
    before = F.sum("n_tokens").over(Window.partitionBy("source", "block", "copy").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = part.withColumn("upto", before).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("want")).drop("upto")
    # The position in a shard is a local shuffle of its rows; a shard is bounded by its tokens.
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", "shard", F.lit(seed + 2)), "doc_id", "copy"))
    mixed = whole.unionByName(part).select("doc_id", "source", "n_tokens", "copy", "shard", place.alias("position"))
    return mixed, targets


def p8_mixture(spark, sf_dir: str) -> DataFrame:
    return mixture(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """source, target_share, actual_share, tokens, rows, documents, most_repeats of the mixture."""
    mixed, targets = mixture(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "mix_targets"))
    per = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("times")).groupBy("source")
    got = per.agg(F.sum("tokens").alias("tokens"), F.sum("times").alias("rows"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # one row a source
    shown = targets.join(got, "source", "left").select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / total).alias("actual_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "rows", "documents", "most_repeats")])
    return shown
