"""Pluggable models behind pandas UDFs. Without a model each gives the deterministic answer of a system that has none; a model that fails leaves its row with the error beside it."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from .text import TEXT_LIMIT

#: Pieces of evidence that a summary reads, and characters of an answer that a judge reads.
PIECES, ANSWER = 8, 3000
JUDGEMENT = "compatible boolean, confidence double, verdict string, issues array<string>, notes string"


def extracted(text: str) -> dict:
    """Default extractor: what stands plainly in a text. name: its first line, without marks of a heading."""
    lines = [x.strip("#* \t") for x in text.splitlines() if x.strip("#* \t-")]
    mail, phone = re.search(r"[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}", text), re.search(r"\+?\d[\d\s().-]{6,}\d", text)
    return {"name": lines[0] if lines and len(lines[0]) <= 120 else None, "email": mail and mail.group(), "phone": phone and phone.group()}


def extractor(model: Callable[[str], dict] = extracted, limit: int = TEXT_LIMIT):
    """UDF from a text to (json, error): the raw extraction of at most so many characters; null for blank texts."""

    def run(texts: pd.Series) -> pd.DataFrame:
        def one(t):
            if not t or not t.strip():
                return None, None
            try:
                return json.dumps(model(t[:limit]), ensure_ascii=False, sort_keys=True), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(t) for t in texts], columns=["json", "error"])

    return F.pandas_udf(run, "json string, error string")


def summariser(model: Callable[[list[str]], str] | None = None):
    """UDF from pieces of evidence to a summary of the first eight that are not blank; null without a model or pieces, or if it fails."""

    def run(lists: pd.Series) -> pd.Series:
        def one(pieces):
            kept = [p.strip() for p in (pieces if pieces is not None else []) if p and p.strip()][:PIECES]
            try:
                return (model(kept) or "").strip() or None if model and kept else None
            except Exception:  # a summary is an extra; the row stays as it is
                return None

        return pd.Series([one(x) for x in lists], dtype=object)

    return F.pandas_udf(run, "string")


def judge(model: Callable[[str, str], dict] | None = None):
    """UDF from request and answer to a judgement; compatible with confidence 0.5 where no judge is there, fails or answers no mapping."""

    def run(requests: pd.Series, answers: pd.Series) -> pd.DataFrame:
        def one(q, a):
            notes = "no_judge"
            if model:
                try:
                    got = model(q or "", (a or "")[:ANSWER])
                    if isinstance(got, dict):
                        return bool(got.get("compatible", True)), float(got.get("confidence", 0.5)), str(got.get("verdict") or "ok"), [str(x) for x in got.get("issues") or []], str(got.get("notes") or "")
                    notes = "malformed"
                except Exception:
                    notes = "failed"
            return True, 0.5, "ok", [], notes

        return pd.DataFrame([one(q, a) for q, a in zip(requests, answers)], columns=["compatible", "confidence", "verdict", "issues", "notes"])

    return F.pandas_udf(run, JUDGEMENT)


def agent(model: Callable[[str], str] | None = None, tries: int = 3, base: float = 0.75, most: float = 8.0, sleep: Callable[[float], None] = time.sleep):
    """UDF from a request to (answer, error, attempts) of an external agent; a failed call is repeated after base times 2 to the number of tries, most seconds at most."""

    def run(requests: pd.Series) -> pd.DataFrame:
        def one(q):
            if model is None:
                return None, "no_agent", 0
            error = None
            for n in range(1, tries + 1):
                try:
                    return model(q or ""), None, n
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                    if n < tries:
                        sleep(min(most, base * 2 ** (n - 1)))
            return None, error, tries

        return pd.DataFrame([one(q) for q in requests], columns=["answer", "error", "attempts"])

    return F.pandas_udf(run, "answer string, error string, attempts int")


def describer(model: Callable[[bytes], str] | None = None):
    """UDF from the bytes of an image to a description; empty without a model, for empty images and if it fails."""

    def run(images: pd.Series) -> pd.Series:
        def one(b):
            try:
                return (model(bytes(b)) or "") if model and b is not None and len(b) else ""
            except Exception:  # images are described as far as possible
                return ""

        return pd.Series([one(b) for b in images], dtype=object)

    return F.pandas_udf(run, "string")
