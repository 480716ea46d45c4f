"""Queries against plain Python on small tables with nulls, ties, blanks and repeats."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cvloom.functions import models as M
from cvloom.functions import udfs as U
from cvloom.operators import request as Q
from cvloom.operators import retrieval as R
from cvloom.operators import search as A
from cvloom.plans.catalogue import QUERIES


def written(spark, folder, **tables):
    """Folder of small tables, each given as rows and schema."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_normalize_text(spark, tmp_path):
    texts = ["plain  text\n", "perché  già", "ﬁne ＡＢＣ", "a – b", "x\x01y\x7f", "", None]
    d = written(spark, tmp_path, hits=([*enumerate(texts)], "hit_id long, content string"))
    want = {k: re.sub(r"[\x00-\x1f\x7f-\x9f]", "", re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t))).strip() for k, t in enumerate(texts) if t is not None}
    assert {r.hit_id: r.normal for r in QUERIES["normalize_text"](spark, d).collect()} == want
    assert want[1] == "perché già" and want[2] == "fine ABC" and len(want) == 6


def test_theta_words(spark, tmp_path):
    skills = ["java", "c++", "c#", "node.js", "machine learning", "javascript"]
    texts = ["Uses Java.", "javascripts", "C++", "c++11", "C#/Node.js", "nodexjs", "MACHINE LEARNING", "java_8", "èjava", "(java)", "xjava java", "", None]
    d = written(spark, tmp_path, hits=([*enumerate(texts)], "hit_id long, content string"), canonical_values=([*[("skill", s) for s in skills], ("role", "xjava"), ("skill", None), ("skill", "")], "field string, value string"))
    want = {k for k, t in enumerate(texts) if t is not None and any(re.search(rf"(?<!\w){re.escape(s)}(?!\w)", t.lower()) for s in skills)}
    assert {r.hit_id for r in QUERIES["theta_semi_contains"](spark, d).collect()} == want == {0, 2, 4, 6, 9, 10}
    assert {r.hit_id for r in QUERIES["theta_anti_contains"](spark, d).collect()} == {1, 3, 5, 7, 8, 11}


def evidence(chunks):
    """As the reference has it, over the (hit_id, score, content, highlights, skills) of a document."""
    clean = lambda x: re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", x or "")).strip()
    chunks, parts = sorted(chunks, key=lambda c: (-(c[1] or 0), c[0])), []
    for c in chunks[:4]:
        marked = [m for m in (clean(x) for v in (c[3] or {}).values() for x in v or []) if m][:6]
        parts += [p.strip() for p in " | ".join(first(marked))[:1000].split("|") if p.strip()]
    parts += sorted({s.strip().lower() for c in chunks for s in c[4] or [] if s and s.strip()})[:6]
    parts += [c[2].strip()[:140] for c in chunks[:8] if c[2] and c[2].strip()]
    return " | ".join(first(parts)[:8]) or None


def first(items):
    kept = {}
    for x in items:
        kept.setdefault(x.lower(), x)
    return [*kept.values()]


def test_evidence(spark, tmp_path):
    mark = lambda *x: {"content": [*x]}
    rows = [
        ("a", 1, 0.5, "  Head one " + "x" * 200, mark("<em>Java</em>", "<em>java</em>", "uses a|b"), ["Java", " docker ", None, ""]),
        ("a", 2, 0.9, "Head two", mark("", "<em>SQL</em>  now"), ["sql"]), ("a", 3, None, None, None, None), ("a", 4, 0.1, "head TWO", None, []),
        ("b", 5, 1.0, " ", None, ["z", "y", "x", "w", "v", "u", "t"]), ("c", 6, 1.0, "", mark("<b>only</b>"), None), ("d", 7, 1.0, None, {"content": None}, None),
        *[("e", 10 + k, 1.0, f"text {k}", mark(f"m{k}") if k > 1 else None, None) for k in range(12)],
        ("f", 40, 1.0, "kept", mark(*[f"p{k} " + "y" * 300 for k in range(8)]), ["q"]),
    ]
    schema = "document_id string, hit_id long, score double, content string, highlights map<string,array<string>>, skills array<string>, id string"
    d = written(spark, tmp_path, hits=([(*r, "i") for r in rows], schema))
    want = {k: evidence([r[1:] for r in rows if r[0] == k]) for k in "abcdef"}
    assert {r.doc: r.evidence for r in QUERIES["evidence_agg"](spark, d).collect()} == want
    assert want["b"] == "t | u | v | w | x | y" and want["c"] == "only" and want["d"] is None and want["a"].startswith("SQL now | Java | uses a | b | docker | sql | Head two")


def rounded(x):
    return round(x + 1e-12, 6)


def plain_search(hits, words, vectors, test, top=60):
    """(doc, best rank, lexical, number of ranked chunks) of the six best documents, step by step in plain Python."""
    kept = [h for h in hits if test(h)]
    tokens = {h["hit_id"]: re.findall(r"[^\W_]+", (h["content"] or "").lower()) for h in kept}
    terms = list(dict.fromkeys(words.lower().split()))
    mean = sum(map(len, tokens.values())) / max(1, len(tokens))
    lex = {}
    for h in kept:
        t, score = tokens[h["hit_id"]], 0.0
        for w in terms:
            df, f = sum(w in x for x in tokens.values()), t.count(w)
            score += math.log(1 + (len(kept) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / mean))
        if round(score, 6) > 0:
            lex[h["hit_id"]] = round(score, 6)
    order = sorted(lex, key=lambda k: (-lex[k], k))[: 5 * top]
    sem = {k: rounded(4 * sum(w in tokens[k] for w in terms) / len(terms)) for k in order[:20]}
    vec = dict(sorted(((k, v) for k, v in vectors.items() if k in tokens), key=lambda x: (-x[1], x[0]))[: 3 * top])
    unit = lambda x: max(0.0, min(1.0, x))
    rank = {k: rounded(0.7 * unit(sem.get(k, 0) / 4) + 0.2 * unit(vec.get(k, 0)) + 0.1 * unit(lex.get(k, 0))) for k in {*order, *sem, *vec}}
    ranked = sorted(rank, key=lambda k: (-rank[k], k))[:top]
    doc = {h["hit_id"]: (h["document_id"] or "").strip() or h["id"] for h in kept}
    best = {}
    for k in ranked:
        if doc[k]:
            b, n = best.get(doc[k], (0.0, 0))
            best[doc[k]] = (max(b, rank[k]), n + 1)
    return [(x, *best[x]) for x in sorted(best, key=lambda x: (-best[x][0], x))[:6]]


def test_search_equals_plain_python(spark):
    rng = random.Random(3)
    words = "java docker spark roma milano dati progetto team sviluppo test".split()
    hits = [{"hit_id": k, "id": f"c{k}", "document_id": rng.choice(["d1", "d2", "d3", "d4", "d5", "d6", "d7", "d8", " ", None]), "full_name": f"n{k}", "role": rng.choice(["java developer", "dba", None]), "location": rng.choice(["Milano", "Roma", None]), "seniority": None, "experience_years": rng.choice([None, 1.0, 7.0]), "language": "it", "availability": rng.choice(["30 giorni", None]), "version": 1, "source_path": "p", "skills": rng.choice([["java"], ["java", "docker"], [None, " "], None]), "certifications": None, "content": rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 30)))]), "highlights": None, "lex_score": None, "vec_score": None, "semantic_score": None, "score": None} for k in range(120)]
    schema = "hit_id bigint, id string, document_id string, full_name string, role string, location string, seniority string, experience_years double, language string, availability string, version int, source_path string, skills array<string>, certifications array<string>, content string, highlights map<string,array<string>>, lex_score double, vec_score double, semantic_score double, score double"
    df = spark.createDataFrame([tuple(h.values()) for h in hits], schema)
    vectors = {k: round(rng.random(), 3) for k in range(0, 120, 3)}
    near = spark.createDataFrame([*vectors.items()], "hit_id bigint, vec_score double")
    request = {"query": "java a milano", "skills": ["java"], "role": "docker spark", "location": "nowhere", "work_mode": "onsite", "top": 10}
    got = A.search(df, request, near).orderBy("place").collect()
    want = plain_search(hits, "docker spark java", vectors, lambda h: "java" in (h["skills"] or []))
    assert [(r.document_id, r.best, r.n_chunks) for r in got] == want and len(want) == 6
    assert {tuple(r.ignored) for r in got} == {("work_mode",)} and not any(r.relaxed for r in got)
    for r in got:
        own = [h for h in hits if ((h["document_id"] or "").strip() or h["id"]) == r.document_id]
        assert r.skills == sorted({s.strip().lower() for h in own for s in h["skills"] or [] if s and s.strip()}) or len(own) > 40
    rare = A.search(df, request | {"skills": ["java", "cobol"], "location": None}, near).orderBy("place").collect()
    assert [(r.document_id, r.best, r.n_chunks) for r in rare] == plain_search(hits, "docker spark", vectors, lambda h: True) and all(r.relaxed for r in rare)
    assert A.suggestions(A.search(df, request, near), ["java"]).first().suggestions == ["ignored:work_mode"]
    assert A.search(df.limit(0), request, near).count() == 0
    with pytest.raises(ValueError):
        A.search(df, {"location": "roma"})


def test_approximate_neighbours_have_the_recall_stated(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    found = total = 0
    for k in range(0, 500, 100):
        probe = e.where(F.col("vec_id") == k).select(F.col("embedding").alias("probe"))
        exact, near = ({r.vec_id for r in f(e, "vec_id", "embedding", probe, 10).collect()} for f in (R.nearest, R.nearest_approximate))
        found, total = found + len(exact & near), total + len(exact)
    assert total == 50 and found >= 0.9 * total
    assert R.nearest_approximate(e.limit(0), "vec_id", "embedding", probe, 3).count() == 0


def test_models_that_fail_leave_their_rows(spark):
    df = spark.createDataFrame([(1, "a@b.test\nx"), (2, None), (3, "boom")], "id int, t string")

    def model(t):
        if t == "boom":
            raise RuntimeError("no")
        return {"name": t[:1]}

    got = {r.id: (r.e.json, r.e.error) for r in df.select("id", M.extractor(model)("t").alias("e")).collect()}
    assert got == {1: ('{"name": "a"}', None), 2: (None, None), 3: (None, "RuntimeError: no")}
    judged = {r.id: r.j.notes for r in df.select("id", M.judge(lambda q, a: {"verdict": "ko"} if q != "boom" else "?")("t", "t").alias("j")).collect()}
    assert judged == {1: "", 2: "", 3: "malformed"}
    assert [r.a.attempts for r in df.where("id = 3").select(M.agent(model, sleep=lambda s: None)("t").alias("a")).collect()] == [3]
    assert [r.s for r in df.select(M.summariser(lambda x: "|".join(x))(F.array("t", F.lit(" "))).alias("s")).collect()] == ["a@b.test\nx", None, "boom"]
    assert [r.e for r in df.orderBy("id").select(U.embedder(lambda t: [1.0] if t != "boom" else 1 / 0)("t").alias("e")).collect()][2].error.startswith("ZeroDivisionError")


def test_requests(spark):
    rows = [('{"query": "almeno 6 anni", "skills": ["B", " a ", "b", null], "top": 0, "work_mode": "Onsite", "availability": "entro lunedi", "min_experience_years": "x"}',), ('{"role": "x", "top": 900, "min_experience_years": 0, "seniority": "Lead"}',), ("[1]",), (None,)]
    n = Q.normalised(spark.createDataFrame(rows, "j string").select(F.monotonically_increasing_id().alias("k"), Q.body(F.col("j")).alias("b")).select("k", "b.*"), ["k"]).orderBy("k").collect()
    assert (n[0].skills, n[0].top, n[0].work_mode, n[0].availability_required, n[0].min_experience_years, n[0].seniority, n[0].seniority_inferred) == (["a", "b"], 10, "onsite", True, 6.0, "senior", True)
    assert (n[1].top, n[1].min_experience_years, n[1].seniority, n[1].seniority_inferred, n[1].work_mode) == (100, 0.0, "lead", False, "unknown")
    assert n[2].query == n[3].query == "" and n[2].skills == [] and len(Q.evaluation_requests()) == 175 and len({t for t, _ in Q.evaluation_requests()}) == 18


def test_lang_sample(spark, tmp_path):
    lengths = [1000, 300, 5000, 5699, 1, 7, 9]
    d = written(spark, tmp_path, documents=([(1, "\n".join("x" * n for n in lengths)), (2, None), (3, " ")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.idx, r.n) for r in QUERIES["lang_sample_prefix"](spark, d).collect())
    assert got == [(1, k, n) for k, n in enumerate(lengths[:5])] and sum(lengths[:5]) == 12000


def test_clean_text_keeps_spaced_abbreviations(spark, tmp_path):
    texts = ["Rossi S . R . L  di V . Monti", "plain", "A . B . C", None]
    d = written(spark, tmp_path, hits=([*enumerate(texts)], "hit_id long, content string"))
    assert {r.hit_id: r.cleaned for r in QUERIES["clean_text"](spark, d).collect()} == {0: "Rossi S.R.L di V . Monti", 1: "plain", 2: "A.B.C"}
