"""Problem 9: texts that were read in a wrong character encoding, found and restored.

The encoding chain of a line is a latent variable: what the text was written in and what it was read as, once or twice.
A chain explains a word if undoing it gives a word that is more likely in the corpus; words that are rare themselves are
judged by their characters. Expectation-maximisation per source estimates how often each chain occurs, so that weak
evidence of one record is read in the light of all others of its source. Records are repaired by posterior.

Null, empty and pure ASCII texts are no cases. A null source is a source of its own. Repeated rows are kept.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A word with anything beyond ASCII, as Java's and as Python's pattern: only ASCII white space ends it.
ODD = r"[^ \t\n\r\x0B\f]*[^\x00-\x7f][^ \t\n\r\x0B\f]*"
#: Chains as (written in, read as); "x2" undoes the reading twice.
ONCE_READ = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp866", "iso8859-2", "iso8859-5", "iso8859-15", "koi8-r")
CHAINS = [("utf-8", r, 1) for r in ONCE_READ] + [("utf-8", r, 2) for r in ("latin-1", "cp1252")] + [("cp1252", r, 1) for r in ("latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8-r")] + [("mac_roman", "cp1252", 1), ("cp850", "cp1252", 1), ("cp437", "cp1252", 1)]
NAMES = [f"{w}>{r}" + "x2" * (n == 2) for w, r, n in CHAINS]
LOST = "lost"
#: Chains that start with the larger share.
USUAL = {LOST, *(f"utf-8>{r}" for r in ONCE_READ[:7]), *(f"cp1252>{r}" for r in ("mac_roman", "cp437", "cp850", "cp1251")), "utf-8>cp1252x2"}
#: Weight of the character model in a word's probability, in words.
ALPHA = 300.0
#: Shares of a line's odd words that a garbling touches; the two are averaged.
SHARES = (0.95, 0.25)
ROUNDS = 6
#: Characters the character model knows; with the bigrams of these its size is bounded.
KNOWN = 0x250
# Signs beyond that range that are common in clean texts, and letters that a lost character may have been.
SIGNS = "€“”„–—…•’‘"
LETTERS = "àèéìòùáíóúñüäößçêâôîûÀÈÉÓÜ€“”–"
WEST = frozenset(map(chr, range(0xA0, 0x100))) | frozenset("œŒšŠžŽŸ" + SIGNS)
#: Log-probability of a sign in a word that only a misread UTF-8 sequence would hold.
STRANGE = -6.0
#: Fillings of lost characters that are kept after each of them; the likeliest one is always among them.
FILLINGS = 100


@lru_cache(maxsize=None)
def back(read: str) -> dict[str, bytes]:
    """Byte of each character in a one-byte encoding; bytes that Windows code pages leave undefined stand for themselves."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(read)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, bytes([b]))
    return table


def undo(text: str, chain: tuple[str, str, int]) -> str | None:
    """The text before the chain, or None if the chain cannot have given it."""
    written, read, times = chain
    table = back(read)
    for _ in range(times):
        try:
            text = b"".join([table[c] for c in text]).decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def characters(tokens: DataFrame) -> dict[tuple[str, str], float]:
    """Log-probabilities of character bigrams, counted over all odd words; bounded by the known characters."""
    inner = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda k: F.substring(F.col("token"), k, F.lit(2)))
    pairs = tokens.where(F.length("token") > 1).select(F.explode(inner).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    allowed = pairs.where(F.col("p").rlike(f"^[\\x00-\\u024f{SIGNS}]{{2}}$"))
    counts = {(r.p[0], r.p[1]): r.n for r in allowed.collect() if len(r.p) == 2}
    first: dict[str, int] = {}
    for (a, _), n in counts.items():
        first[a] = first.get(a, 0) + n
    return {(a, b): math.log((n + 0.05) / (first[a] + 15)) for (a, b), n in counts.items()} | {(a, ""): math.log(0.05 / (n + 15)) for a, n in first.items()}


def likelihood(text: str, model: dict) -> float:
    total = -3.0
    for a, b in zip(text, text[1:]):
        p = model.get((a, b))
        total += p if p is not None else model.get((a, ""), -6.0)
    if len(text) == 1:
        total -= 4.0
    return total


def filled(token: str, model: dict) -> list[str]:
    """The token with its lost characters filled in, one after another by the bigrams on both sides; the likeliest fillings."""
    ways = [(0.0, "")]
    for a, c in enumerate(token):
        if c != "\ufffd":
            ways = [(s, w + c) for s, w in ways]
            continue
        after = token[a + 1 : a + 2]
        pair = lambda x, y: model.get((x, y), model.get((x, ""), -6.0)) if x and y else 0.0
        right = {x: pair(x, after) if after != "\ufffd" else 0.0 for x in LETTERS}
        # What a later lost character adds is the same for equal last letters, so the likeliest filling stays.
        ways = sorted(((s + pair(w[-1:], x) + right[x], w + x) for s, w in ways for x in LETTERS), reverse=True)[:FILLINGS]
    return [w for _, w in ways]


@lru_cache(maxsize=4096)
def script(c: str) -> str:
    """Script of a letter, by its name; "" for anything else."""
    return unicodedata.name(c, "").split(" ")[0].split("-")[0] if c.isalpha() else ""


def readable(text: str) -> bool:
    """Whether a text can stand in a clean document: western letters and signs, or letters of one other script."""
    if any(0x7F <= ord(c) < 0xA0 for c in text):
        return False
    other = {script(c) for c in text if ord(c) >= KNOWN and c not in SIGNS}
    if not other:
        return True
    own = {script(c) for c in text if c.isalpha() and not c.isascii()}
    return "" not in other and len(own) == 1 and "LATIN" not in own


def readings(token: str, model: dict) -> list[tuple[str, str]]:
    """Chains that can have given the token, with what it was before."""
    if "\ufffd" in token:
        return [(LOST, before) for before in filled(token, model)]
    found = []
    for name, chain in zip(NAMES, CHAINS):
        before = undo(token, chain)
        if before is not None and before != token and (readable(before) if chain[0] == "utf-8" else western(before)):
            found.append((name, before))
    return found


def western(text: str) -> bool:
    return all(ord(c) < KNOWN or c in SIGNS for c in text) and not any(0x7F <= ord(c) < 0xA0 for c in text)


def misread(token: str) -> bool:
    """Whether the word holds UTF-8 sequences of western letters and signs, or of letters of one other script, that were read byte by byte.

    Such a word says nothing about clean texts, so the corpus model leaves it out.
    """
    if "\ufffd" in token:
        return True
    for chain in CHAINS:
        if chain[0] == "utf-8":
            before = undo(token, chain)
            if before is not None and before != token and (all(c.isascii() or c in WEST for c in before) or not western(before)) and readable(before):
                return True
    return False


def evidence(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each line with a word that some chain explains: its log-likelihood under each chain against a clean line.

    Second: the readings (token, chain, before, gain).
    """
    line = F.posexplode(F.split("text", "\n"))
    each = docs.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), line.alias("line", "t"))
    odd = each.select("doc_id", "source", "line", F.explode(F.regexp_extract_all("t", F.lit(f"({ODD})"), F.lit(1))).alias("token"))
    odd = common.saved(odd.groupBy("doc_id", "source", "line", "token").agg(F.count("*").alias("n")), "odd-words")

    @F.pandas_udf("boolean")
    def is_misread(tokens: pd.Series) -> pd.Series:
        return tokens.map(misread).astype(bool)

    types = common.spread(odd.groupBy("token").agg(F.sum("n").alias("n"))).withColumn("strange", is_misread("token"))
    types = common.saved(types, "odd-types")
    model = odd.sparkSession.sparkContext.broadcast(characters(types.where("not strange")))
    total = types.agg(F.sum("n")).first()[0] or 0

    def read(batches):
        for part in batches:
            rows = []
            for token, n, strange in zip(part.token, part.n, part.strange):
                own = likelihood(token, model.value)
                if strange:
                    n, own = 0, own + STRANGE * sum(not c.isascii() for c in token)
                for chain, before in readings(token, model.value):
                    after = likelihood(before, model.value) if not before.isascii() else -2.5 * len(before) - 3
                    if chain != LOST and misread(before):
                        after += STRANGE * sum(not c.isascii() for c in before)
                    if after > own - 12 or chain == LOST:
                        rows.append((token, n, chain, before, own, after))
            yield pd.DataFrame(rows, columns=["token", "n", "chain", "before", "own", "after"])

    read_as = common.spread(types).mapInPandas(read, "token string, n bigint, chain string, before string, own double, after double")
    known = types.where("not strange").select(F.col("token").alias("before"), F.col("n").alias("n_before"))
    p = lambda n, c: F.log((F.coalesce(n, F.lit(0)) + F.lit(ALPHA) * F.exp(c)) / (total + ALPHA))
    gain = p(F.col("n_before"), F.col("after")) - p(F.col("n"), F.col("own"))
    # Joins by word grow with the words of the corpus: they are sorted joins at any size.
    best = read_as.join(known.hint("merge"), "before", "left").withColumn("gain", gain)
    best = common.saved(best.groupBy("token", "chain").agg(F.max(F.struct("gain", "before")).alias("b")).select("token", "chain", "b.gain", "b.before"), "readings")
    lines = odd.groupBy("doc_id", "source", "line").agg(F.sum("n").alias("odd"))
    helped = best.where("gain > 0").select("token").distinct()
    near = odd.join(odd.join(helped.hint("merge"), "token", "left_semi").select("doc_id", "line").distinct().hint("merge"), ["doc_id", "line"], "left_semi")
    gains = near.join(best.hint("merge"), "token")
    term = lambda w: F.sum(F.col("n") * F.log(F.lit(w) * F.exp(F.least("gain", F.lit(30.0))) + (1 - w)))
    sums = gains.groupBy("doc_id", "source", "line", "chain").agg(F.sum("n").alias("touched"), *[term(w).alias(f"s{k}") for k, w in enumerate(SHARES)], F.max("gain").alias("most"))
    sums = sums.where("most > 0").join(lines.hint("merge"), ["doc_id", "source", "line"])
    full = [F.col(f"s{k}") + (F.col("odd") - F.col("touched")) * math.log(1 - w) for k, w in enumerate(SHARES)]
    top = F.greatest(*full)
    return sums.select("doc_id", "source", "line", "chain", (top + F.log(sum(F.exp(f - top) for f in full) / len(full))).alias("ll")), best


def posteriors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, line, chain, posterior of the most likely chain of each line with any evidence; and the readings."""
    ll, best = evidence(docs)
    packed = ll.groupBy("doc_id", "source", "line").agg(F.collect_list(F.struct("chain", "ll")).alias("ways"))  # at most one entry a chain
    packed = common.saved(packed, "line-evidence")
    size = {r.source: r.n for r in docs.where(F.length("text") > 0).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.size(F.split("text", "\n"))).alias("n")).collect()}
    # One number for each source and chain; sources are names of feeds, not of records.
    share = {(s, c): 0.002 if c in USUAL else 0.0002 for s in size for c in [*NAMES, LOST]}
    for _ in range(ROUNDS):
        scored = _posterior(packed, share)
        got = {(r.source, r.chain): r.w for r in scored.select("source", F.explode("ways").alias("w")).groupBy("source", F.col("w.chain").alias("chain")).agg(F.sum("w.p").alias("w")).collect()}
        share = {(s, c): (got.get((s, c), 0.0) + 0.2) / (n + 10) for s, n in size.items() for c in [*NAMES, LOST]}
    final = _posterior(packed, share).select("doc_id", "line", F.explode("ways").alias("w")).select("doc_id", "line", "w.*")
    most = final.groupBy("doc_id", "line").agg(F.sum("p").alias("garbled"), F.max_by("chain", "p").alias("chain"), F.max("p").alias("posterior"))
    return most, best


def _posterior(packed: DataFrame, share: dict) -> DataFrame:
    spark = packed.sparkSession
    rows = [(s, c, math.log(w)) for (s, c), w in share.items()]
    prior = spark.createDataFrame(rows or [("", LOST, -9.0)], "source string, chain string, lp double").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "lp"))).alias("prior"))
    joined = packed.join(prior, "source")
    scored = F.transform("ways", lambda w: F.struct(w.chain.alias("chain"), F.exp(F.least(w.ll + F.col("prior")[w.chain], F.lit(300.0))).alias("e")))
    joined = joined.withColumn("scored", scored).withColumn("z", F.aggregate("scored", F.lit(1.0), lambda a, w: a + w.e))
    return joined.select("doc_id", "source", "line", F.transform("scored", lambda w: F.struct(w.chain.alias("chain"), (w.e / F.col("z")).alias("p"))).alias("ways"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    lines, _ = posteriors(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return lines.where("garbled > 0.5").select("doc_id").distinct()


def repaired(docs: DataFrame) -> DataFrame:
    """doc_id, lines (garbled ones), chain, text (restored; null where characters were lost)."""
    lines, best = posteriors(docs)
    bad = lines.where("garbled > 0.5").select("doc_id", "line", "chain", "posterior")
    each = docs.join(bad.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    tokens = each.join(bad, ["doc_id", "line"]).select("doc_id", "line", "chain", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(f"({ODD})"), F.lit(1)))).alias("token"))
    swaps = tokens.join(best.where("gain > -1"), ["token", "chain"]).groupBy("doc_id", "line").agg(F.map_from_entries(F.collect_list(F.struct("token", "before"))).alias("swaps"))

    @F.pandas_udf("string")
    def mend(text: pd.Series, swaps: pd.Series) -> pd.Series:
        import re

        word = re.compile("[^ \t\n\r\x0b\f]+")
        return pd.Series([t if not s else word.sub(lambda m, s=dict(s): s.get(m.group(), m.group()), t) for t, s in zip(text, swaps)], dtype=object)

    fixed = each.join(swaps, ["doc_id", "line"], "left").select("doc_id", "line", mend("t", "swaps").alias("t"))
    whole = fixed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x.t), "\n").alias("text"))
    cases = bad.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max_by("chain", "posterior").alias("chain"), F.max(F.col("chain") == LOST).alias("lost"))
    return cases.join(whole, "doc_id").select("doc_id", "lines", "chain", F.when(~F.col("lost"), F.col("text")).alias("text"))


def p9_repaired(spark, sf_dir: str) -> DataFrame:
    return repaired(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
