"""Pluggable models as pandas UDFs and table functions, for what the JVM has no function for."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def nfkc():
    """Compatibility form of a text, white space as single blanks, without control characters."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t))
            return re.sub(r"[\x00-\x1f\x7f-\x9f]", "", t).strip()

        return texts.map(one)

    return F.pandas_udf(run, "string")


def reencoded():
    """Text that was UTF-8 read as a western one-byte encoding, read again; unchanged if that makes it no cleaner."""

    def run(texts: pd.Series) -> pd.Series:
        noise = lambda t: sum(t.count(c) for c in "ÃÂâ�")

        def one(t):
            if t is None:
                return None
            best = t
            for name in ("cp1252", "latin-1"):
                try:
                    again = t.encode(name).decode("utf-8")
                except UnicodeError:
                    continue
                if noise(again) < noise(best):
                    best = again
            return best

        return texts.map(one)

    return F.pandas_udf(run, "string")


def hashed_embedding(text: str, size: int = 64) -> list[float]:
    """Deterministic stand-in for an embedding model: signed hashed words, of length 1."""
    v = [0.0] * size
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % size] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embedder(model: Callable[[str], list[float]] = hashed_embedding):
    """UDF of an embedding model: (vector, error). An empty text has neither, a failing one its error; both keep their row."""

    def run(texts: pd.Series) -> pd.DataFrame:
        def one(t):
            if not t or not t.strip():
                return None, None
            try:
                return model(t), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(t) for t in texts], columns=["vector", "error"])

    return F.pandas_udf(run, "vector array<float>, error string")


def json_blocks(text: str | None) -> Iterator[str]:
    """Top-level {...} blocks of a text that are valid JSON objects; braces inside strings do not count."""
    depth, start, quoted, escaped = 0, 0, False, False
    for k, c in enumerate(text or ""):
        if quoted:
            escaped = c == "\\" and not escaped
            quoted = not (c == '"' and not escaped) if c != "\\" else True
            continue
        if c == '"' and depth:
            quoted, escaped = True, False
        elif c == "{":
            start = k if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                block = text[start : k + 1]
                try:
                    json.loads(block)
                except ValueError:
                    continue
                yield block


@udtf(returnType="block string", useArrow=True)
class ExtractJsonBlocks:
    def eval(self, text: str):
        for b in json_blocks(text):
            yield (b,)


# Keys of which a candidate has one at least.
CANDIDATE_KEYS = ("name", "full_name", "candidate_id", "skills", "role", "location")


def walk_hits(value) -> Iterator[dict]:
    """Candidates in lists under 'hits' or 'results' anywhere in a JSON value, at any depth, also inside strings that hold JSON and inside other candidates."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            if v.lstrip()[:1] in ("{", "["):
                try:
                    stack.append(json.loads(v))
                except (ValueError, RecursionError):
                    continue
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            for key in ("hits", "results"):
                yield from (x for x in (v[key] if isinstance(v.get(key), list) else ()) if isinstance(x, dict) and any(k in x for k in CANDIDATE_KEYS))
            stack += reversed(v.values())


def candidate_row(item: dict) -> dict:
    """A candidate with its usual fields, whatever they were called."""
    first = lambda *keys: next((str(item[k]).strip() for k in keys if item.get(k)), "")
    return {"name": first("name", "full_name", "candidate_id"), "role": first("role"), "location": first("location"), "skills": item["skills"] if isinstance(item.get("skills"), list) else [], "retrieval_score": item.get("retrieval_score"), "source_path": first("source_path", "path", "source")}


def search_evidence(text: str | None) -> tuple[int, str, str]:
    """(number of different candidates, first five names, the first twenty as JSON) of a recorded response."""
    kept: dict[tuple, dict] = {}
    for c in map(candidate_row, walk_hits(text or "")):
        kept.setdefault(tuple(c[k].casefold() for k in ("name", "role", "location")), c)
    top = [*kept.values()][:20]
    return len(kept), ", ".join([c["name"] for c in top if c["name"]][:5]), json.dumps({"candidates_count": len(kept), "top_candidates": top}, ensure_ascii=False, sort_keys=True)


def evidence_of():
    return F.pandas_udf(lambda texts: pd.DataFrame([search_evidence(t) for t in texts], columns=["candidates_count", "candidates_names", "evidence"]), "candidates_count int, candidates_names string, evidence string")


@udtf(returnType="hit string", useArrow=True)
class CollectHits:
    def eval(self, text: str):
        for h in walk_hits(text or ""):
            yield (json.dumps(h, sort_keys=True, ensure_ascii=False),)


HEADER = re.compile(r"^(#{1,3})\s+(.*)$")


def header_chunks(markdown: str, size: int = 2000, overlap: int = 200) -> list[tuple[int, str | None, str]]:
    """(index, section, content): parts between headers of three levels, long ones cut at the widest break that fits."""
    parts, section, lines = [], None, []
    for line in (markdown or "").split("\n"):
        m = HEADER.match(line)
        if m:
            parts.append((section, "\n".join(lines)))
            section, lines = m.group(2).strip(), [line]
        else:
            lines.append(line)
    parts.append((section, "\n".join(lines)))

    def cut(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > size:
            end = at + size
            for mark in ("\n\n", "\n", ". ", " "):
                spot = text.rfind(mark, at + overlap + 1, end)
                if spot > 0:
                    end = spot + len(mark)
                    break
            yield text[at:end]
            at = max(end - overlap, at + 1)
        yield text[at:]

    found = [(s, c.strip()) for s, t in parts if t.strip() for c in cut(t) if c.strip()]
    return [(k, s, c) for k, (s, c) in enumerate(found, 1)]


@udtf(returnType="chunk_index int, section string, content string", useArrow=True)
class ChunkMarkdown:
    def eval(self, text: str, size: int, overlap: int):
        yield from header_chunks(text or "", int(size), int(overlap))


def chunked_by_header(docs: DataFrame, key: str, text: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """key, chunk_index, section, content of markdown documents; null and blank ones have no chunk."""
    kind = docs.select(key).dtypes[0][1]

    def run(batches):
        for part in batches:
            rows = [(k, *c) for k, t in zip(part[key], part[text]) if t for c in header_chunks(t, size, overlap)]
            yield pd.DataFrame(rows, columns=["k", "chunk_index", "section", "content"])

    return docs.select(key, text).mapInPandas(run, f"k {kind}, chunk_index int, section string, content string").withColumnRenamed("k", key)
