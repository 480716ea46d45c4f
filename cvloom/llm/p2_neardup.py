"""Problem 2: hits that carry the same chunk with small edits, insertions or another order.

Chosen-path set similarity join. Contents with the same distinct words are one class with one representative. In each of
several independent trees a representative branches by the words that come first under a hash that depends on the path
so far. A path ends when the document frequencies of its words promise a node of few documents; a word outside the table
of frequent words ends it at once where the corpus is small enough. Nodes are compared exhaustively by sketches of the
word sets; nodes beyond a bound are split into blocks and the blocks compared, so nothing is dropped. Candidates are then
checked on the words themselves.

Null and short contents (under 70 words) take part in no pair. Very long texts count as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.7
LEAST_WORDS = 70
#: Independent trees, and the branches of a path at each depth (the last holds for all deeper ones).
TREES = 8
BRANCHES = (2, 1)
#: Documents that a node should hold, nodes compared at once, and the greatest depth.
NODE = 50
LIMIT = 1024
DEPTH = 12
#: The table of frequent words holds words of at least this share of the documents, so at most its inverse times the
#: mean number of words.
RAREST_SHARE = 1 / 20_000
#: Standard deviations by which a sketch may fall short.
SLACK = 5.0
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LAST = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers mixed."""
    x = x ^ (x >> np.uint64(31))
    x *= M1
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def nodes(values: np.ndarray, lengths: np.ndarray, frequent: np.ndarray, share: np.ndarray, n_docs: int, rare: float, chunk: int = 4096):
    """Pairs (document, node) of all trees; documents are given one after another in values.

    frequent (sorted) and share are the table of frequent words; any other word counts as having the share rare.
    """
    n = len(lengths)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    token = mixed(values)
    weight = np.full(len(values), rare)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        weight = np.where(frequent[at] == values, share[at], rare)
    weight = np.log(weight)
    target, lowest = math.log(min(1.0, NODE / max(n_docs, 1))), math.log(rare) + 1e-9
    doc = np.tile(np.arange(n), TREES)
    path = mixed(np.repeat(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(7919), n))
    key, total, used = np.zeros(len(doc), np.uint64), np.zeros(len(doc)), np.zeros((len(doc), 0), np.uint64)
    ends = []
    for depth in range(DEPTH):
        later = []
        for a in range(0, len(doc), chunk):
            d, p, k0, t0, u = doc[a : a + chunk], path[a : a + chunk], key[a : a + chunk], total[a : a + chunk], used[a : a + chunk]
            size = lengths[d]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            index = np.repeat(starts[d] - begin, size) + np.arange(size.sum())
            word = token[index]
            order = mixed(word ^ np.repeat(p, size))
            for q in range(u.shape[1]):
                order[word == np.repeat(u[:, q], size)] = LAST
            row = np.repeat(np.arange(len(d)), size)
            for _ in range(BRANCHES[min(depth, len(BRANCHES) - 1)]):
                first = np.minimum.reduceat(order, begin)
                pick = np.flatnonzero((order == np.repeat(first, size)) & (order != LAST))
                who, one = np.unique(row[pick], return_index=True)
                pick = pick[one]
                chosen, cost = word[pick], weight[index[pick]]
                alone = cost <= lowest
                sum_cost = t0[who] + cost
                # A node is the set of its words; one rare word is a node by itself as far as that keeps it small.
                name = np.where(alone & (cost <= target), chosen, k0[who] + chosen)
                stop = (sum_cost <= target) | (depth == DEPTH - 1)
                ends.append((d[who[stop]], name[stop]))
                go = ~stop
                w = who[go]
                later.append((d[w], mixed(p[w] ^ chosen[go]), name[go], sum_cost[go], np.concatenate([u[w], chosen[go][:, None]], axis=1)))
                # A document whose words are used up ends where it is.
                spent = np.setdiff1d(np.arange(len(d)), who)
                ends.append((d[spent], k0[spent]))
                order[pick] = LAST
        doc, path, key, total, used = (np.concatenate(x) for x in zip(*later)) if later else ([],) * 5
        if not len(doc):
            break
    docs, names = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
    both = np.unique(np.rec.fromarrays([names, docs], names="n,d"))
    return both.d, both.n


def sketches(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Odd sketch of 256 bits of each document's words, as four numbers."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = mixed(values ^ np.uint64(0x5DEECE66D))
    bit = np.uint64(1) << (h & np.uint64(63))
    part = (h >> np.uint64(6)) & np.uint64(3)
    return np.stack([np.bitwise_xor.reduceat(np.where(part == np.uint64(k), bit, np.uint64(0)), starts) for k in range(4)], axis=1)


def alike(size_a, size_b, differing) -> np.ndarray:
    """Whether sketches that differ in so many bits leave the threshold possible."""
    smaller, larger = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    most = (size_a + size_b) * (1 - THRESHOLD) / (1 + THRESHOLD)
    expected = 128 * (1 - np.exp(most * math.log(1 - 2 / 256)))
    return (smaller >= THRESHOLD * larger) & (differing <= expected + SLACK * np.sqrt(expected) + 1)


def compare(node, ident, size, bits):
    """Pairs of rows of the same node (rows are sorted by node) whose sketches are alike."""
    found, at = [], np.arange(len(node))
    for step in range(1, len(node)):
        at = at[at + step < len(node)]
        at = at[node[at] == node[at + step]]
        if not len(at):
            break
        other = at + step
        differing = np.bitwise_count(bits[at] ^ bits[other]).sum(axis=1)
        good = alike(size[at], size[other], differing) & (ident[at] != ident[other])
        a, b = ident[at[good]], ident[other[good]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


ROW = "node bigint, id bigint, size int, b0 bigint, b1 bigint, b2 bigint, b3 bigint"


def _columns(batch):
    c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
    return c[0], c[1], c[2], np.stack(c[3:7], axis=1).view(np.uint64)


def comparing(limit: int):
    """Worker for rows sorted by node: pairs (a, b); rows of nodes beyond the limit come out again, to be split."""
    names = ["a", "b", "node", "id", "size", "b0", "b1", "b2", "b3"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]

    def give(pairs=None, rows=None):
        n = len(pairs) if pairs is not None else len(rows[0])
        if pairs is not None:
            cols = [pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), *[pa.nulls(n, k) for k in kinds[2:]]]
        else:
            cols = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *[pa.array(x, k) for x, k in zip([*rows[:3], *rows[3].view(np.int64).T], kinds[2:])]]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches):
        kept, large = None, None
        for batch in batches:
            rows = _columns(batch)
            if kept is not None:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(kept, rows))
            if large is not None:
                same = rows[0] == large
                if same.any():
                    yield give(rows=tuple(x[same] for x in rows))
                rows = tuple(x[~same] for x in rows)
                kept = None
                if not len(rows[0]):
                    continue
                large = None
            last = rows[0] == rows[0][-1]
            kept, done = tuple(x[last] for x in rows), tuple(x[~last] for x in rows)
            yield from finish(done)
            if len(kept[0]) > limit:
                yield give(rows=kept)
                kept, large = None, kept[0][0]
        if kept is not None:
            yield from finish(kept)

    def finish(rows):
        if not len(rows[0]):
            return
        change = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        count = np.repeat(np.diff(np.concatenate([change, [len(rows[0])]])), np.diff(np.concatenate([change, [len(rows[0])]])))
        big = count > limit
        if big.any():
            yield give(rows=tuple(x[big] for x in rows))
        small = ~big & (count > 1)
        pairs = compare(*(x[small] for x in rows))
        if len(pairs):
            yield give(pairs=pairs)

    return run, "a bigint, b bigint, " + ROW


def shingled(hits: DataFrame, key: str = "hit_id", text: str = "content") -> DataFrame:
    """id, signature and hashed distinct words of each text that is long enough."""
    rows = hits.where(F.length(text) >= 2 * LEAST_WORDS - 1).select(F.col(key).alias("id"), common.words(F.col(text)).alias("w")).where(F.size("w") >= LEAST_WORDS)
    rows = rows.select("id", F.array_distinct("w").alias("w"))
    ordered = F.array_sort("w")
    return rows.select("id", F.concat_ws("-", F.xxhash64(ordered), F.hash(ordered), F.size("w")).alias("signature"), F.transform("w", lambda x: F.hash(x)).alias("tokens"))


def frequent_words(reps: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Words of at least a share of the documents with their shares, and that share; bounded by 1 / share times the mean size."""
    rare = max(RAREST_SHARE, min(0.01, NODE / max(n_docs, 1)))
    least = max(2, math.ceil(rare * n_docs))
    counts = reps.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= least).collect()
    pairs = sorted((r.t & 0xFFFFFFFF, r["count"] / n_docs) for r in counts)
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]), rare


def candidates(reps: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of representatives (id, tokens); a pair may come several times."""
    n_docs = reps.count()
    table = reps.sparkSession.sparkContext.broadcast(frequent_words(reps, n_docs))

    def branch(batches):
        frequent, share, rare = table.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1500):
                batch = whole.slice(at, 1500)
                lists = batch.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32).astype(np.uint64)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                doc, name = nodes(values, lengths, frequent, share, n_docs, rare)
                bits = sketches(values, lengths).view(np.int64)[doc]
                ident = batch.column(0).to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), ident, lengths[doc].astype(np.int32), *bits.T)], ["node", "id", "size", "b0", "b1", "b2", "b3"])

    rows = reps.select("id", "tokens").mapInArrow(branch, ROW)
    run, kind = comparing(LIMIT)
    first = common.saved(rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, kind), "candidates")
    pairs = first.where("a is not null").select("a", "b")
    large = first.where("a is null").drop("a", "b")
    if large.isEmpty():
        return pairs
    blocks = large.groupBy("node").agg(F.ceil(F.count("*") / (LIMIT // 2)).cast("int").alias("blocks"))
    split = large.join(blocks, "node").withColumn("own", F.pmod(F.xxhash64("id", "node"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).select(*large.columns)
    run, kind = comparing(64 * LIMIT)
    more = split.repartition("node").sortWithinPartitions("node").mapInArrow(run, kind).where("a is not null").select("a", "b")
    return pairs.unionByName(more)


def links(hits: DataFrame, key: str = "hit_id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of representatives, and membership (id, rep) of all texts that are long enough."""
    rows = common.saved(shingled(common.spread(hits.select(key, text)), key, text), "word-sets")
    heads = rows.groupBy("signature").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = heads.where("n > 1").select("signature", "rep")
    members = rows.select("id", "signature").join(copies, "signature", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    members = common.saved(members, "membership")
    reps = rows.join(members.where("id <> rep").select("id"), "id", "left_anti").select("id", "tokens")
    pairs = common.saved(candidates(reps).distinct(), "candidate-pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = hits.select(F.col(key).alias("id"), F.col(text).alias("t")).join(wanted, "id", "left_semi").select("id", F.array_distinct(common.words(F.col("t"))).alias("w"))
    texts = common.saved(texts, "candidate-words")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(texts.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    both = both.select("a", "b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("similarity"))
    return both.where(F.col("similarity") >= THRESHOLD - 1e-12), members


def p2_found(spark, sf_dir: str) -> DataFrame:
    pairs, members = links(common.table(spark, sf_dir, "hits").select("hit_id", "content"))
    a, b = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.join(a, "a").join(b, "b").select(F.least("x", "y").alias("hit_a"), F.greatest("x", "y").alias("hit_b"))
    copied = members.where("id <> rep").select("rep").distinct()
    own = members.join(copied, "rep", "left_semi")
    within = own.select(F.col("id").alias("hit_a"), "rep").join(own.select(F.col("id").alias("hit_b"), "rep"), "rep").where("hit_a < hit_b").select("hit_a", "hit_b")
    return across.unionByName(within)


def p2_groups(spark, sf_dir: str) -> DataFrame:
    """One row per hit that is long enough: its class (the least hit of the connected texts) and its number of links."""
    pairs, members = links(common.table(spark, sf_dir, "hits").select("hit_id", "content"))
    pairs = common.saved(pairs, "pairs")
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    degree = ends.join(sizes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("across"))
    classes = common.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("rep"), "component")
    per = sizes.join(degree, "rep", "left").join(classes, "rep", "left")
    per = per.select("rep", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("across", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return members.join(per, "rep").select(F.col("id").alias("hit_id"), "class_id", "links")
