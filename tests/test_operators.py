"""Operators on cases computed by hand, decisions on edge cases included."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cvloom.functions import text as T
from cvloom.functions import udfs as U
from cvloom.functions import values as V
from cvloom.operators import elements as E
from cvloom.operators import layout as L
from cvloom.operators import ranking as K
from cvloom.operators import retrieval as R
from cvloom.operators import store as S
from cvloom.sources import files, tables


def one(spark, column, **values):
    row = spark.createDataFrame([Row(**(values or {"x": "x"}))])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("given,want", [("Fatturato S . R . L . I e V . Monti", "Fatturato S.R.L.I e V . Monti"), ("a \t b\n\n\n\nc", "a b\n\nc"), ("x" * 30000, "x" * 25000), ("    a", "a")])
def test_clean_text(spark, given, want):
    assert one(spark, T.clean_text(F.lit(given))) == want


@pytest.mark.parametrize("name,want", [("file v2.pdf", "file"), ("CV_Rossi_versione 12.docx", "CV_Rossi"), ("plain", "plain"), ("a-rev3.txt", "a"), ("", "")])
def test_document_id(spark, name, want):
    assert one(spark, T.document_id(F.lit(name))) == want


def test_experience_bounds(spark):
    both = lambda t: tuple(one(spark, c) for c in T.experience_bounds(F.lit(t)))
    assert both("tra 2 e 5,5 anni") == (2.0, 5.5) and both("almeno 3 anni, fino a 8 anni") == (3.0, 8.0)
    assert both("5+ years") == (5.0, None) and both("nessun vincolo") == (None, None)


def test_dates_and_numbers(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, V.age(day("2000-02-29"), day("2001-02-28"))) == 0 and one(spark, V.age(day("2030-01-01"), day("2026-01-01"))) is None
    assert [one(spark, V.strict_date(F.lit(x))) for x in ("2020", "2020-5-1", "2020-02-30", " 2020-05-01 ")] == [None, None, None, dt.date(2020, 5, 1)]
    assert [one(spark, V.coerce_score(F.lit(x))) for x in (2.5, 3.5, 0.4, 5.4, 5.6)] == [2, 4, None, 5, None]
    assert [one(spark, V.parse_bool(F.lit(x))) for x in (" YES ", "off", "maybe")] == [True, False, None]
    assert [one(spark, V.seniority(F.lit(x).cast("double"))) for x in (1.9, 2.0, 5.0, 10.0, 15.0)] == ["junior", "mid", "senior", "lead", "principal"]


def test_recency_boost_also_for_later_dates(spark):
    now = F.lit("2026-06-30").cast("timestamp")
    got = [one(spark, V.recency_boost(F.lit(x).cast("timestamp"), now)) for x in ("2026-06-01", "2027-01-01", "2025-01-01")]
    assert got == [0.02, 0.02, 0.0]


def test_front_matter_and_yaml(spark):
    assert one(spark, T.strip_front_matter(F.lit("---\na: 1\n---\nbody"))) == "body" and one(spark, T.strip_front_matter(F.lit("---\nopen"))) == "---\nopen"
    assert [one(spark, T.yaml_scalar(F.lit(x))) for x in ("plain", 'two "words"', None)] == ["plain", '"two \\"words\\""', "''"]


def test_json_salvage(spark):
    got = [one(spark, V.salvage_json(F.lit(x))) for x in ('{"a": 1}', 'so: {"a": 1} .', "none", '{"a": ')]
    assert got == ['{"a": 1}', '{"a": 1}', None, None]


def test_chunk_fold_keeps_overlap_and_tail(spark):
    ps = F.array(*[F.lit(c * 30) for c in "abcd"])
    got = one(spark, E.folded_chunks(ps, 60, 10))
    assert got[0] == "a" * 30 + "\n\n" + "b" * 30 and got[1] == "b" * 10 + "\n\n" + "c" * 30 + "\n\n" + "d" * 30 and got[2] == "d" * 10
    assert one(spark, E.folded_chunks(ps, 60, 0)) == ["a" * 30 + "\n\n" + "b" * 30, "c" * 30 + "\n\n" + "d" * 30]
    assert one(spark, E.folded_chunks(F.array(F.lit(" "), F.lit("")), 60, 10)) == []


def test_anchored_rows_do_not_drift(spark):
    assert one(spark, E.anchored_rows(F.array(*[F.lit(float(x)) for x in (0, 2, 4, 5, 9)]), 3.0)) == [1, 1, 2, 2, 3]


def test_filter_builder(spark):
    rows = spark.createDataFrame([(1, ["java", "o'neil"], "mid", 0.0, "it", None), (2, ["java"], None, None, None, "now")], "id int, skills array<string>, seniority string, experience_years double, language string, availability string")
    ids = lambda **k: [r.id for r in R.filtered(rows, **k).orderBy("id").collect()]
    assert R.conditions() is None and ids() == [1, 2] and ids(skills=["java", "o'neil"]) == [1] and ids(low=0) == [1] and ids(available=True) == [2] and ids(skills=[]) == [1, 2]


@pytest.mark.parametrize("sem,lex,vec,recent,want", [(0, 1, 0, 0, 0.10), (0, 0, 1, 0, 0.20), (4, 0, 0, 0, 0.70), (4, 1, 1, 0.02, 1.02), (0, 15, 0, 0, 0.10)])
def test_rank_score(spark, sem, lex, vec, recent, want):
    assert one(spark, R.rank_score(*[F.lit(float(x)) for x in (sem, vec, lex, recent)])) == pytest.approx(want)


def test_soft_filter_keeps_all_when_none_fits(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, days int")
    assert {r.id for r in R.filter_or_all(df, F.col("days") <= 30).collect()} == {1} and R.filter_or_all(df, F.col("days") < 0).count() == 3
    assert R.filter_or_all(df.limit(0), F.col("days") < 0).count() == 0


def test_evidence_and_highlight(spark):
    assert one(spark, R.evidence(F.array(*map(F.lit, ["A", "a", " ", "b"])))) == "A | b" and one(spark, R.evidence(F.array(F.lit("")))) is None
    assert one(spark, R.highlight(F.lit("Nothing here. Uses Java and docker daily."), ["java", "docker"])) == "Uses <em>Java</em> and <em>docker</em> daily."


def test_match_features(spark):
    own = F.array(*map(F.lit, ["java", "power bi"]))
    s = one(spark, K.skills(F.array(*map(F.lit, ["java", "power", "sql"])), own))
    assert (s.score, s.matched, s.semantic_matches) == (0.5667, ["java"], ["power"])
    role = lambda a, b: tuple(one(spark, K.role(F.lit(a), F.lit(b)))[1:])
    assert role("qa engineer", "quality engineer") == (0.5, "semantic") and role("x", "") == (0.8, "semantic") and role("", "x") == (None, "not_requested")
    place = lambda a, b, m: tuple(one(spark, K.location(F.lit(a), F.lit(b), F.lit(m)))[1:])
    assert place("roma", "x", "remote") == (1.0, "not_applicable") and place("reggio emilia", "reggio calabria", "onsite") == (0.35, "weak")


def test_versions_and_decisions(spark):
    e = spark.createDataFrame([("p", 1, "a"), ("p", 2, "a"), ("p", 3, "b"), ("p", 4, "a")], "path string, n int, h string")
    assert [r.version_no for r in S.versions(e, ["path"], "h", ["n"]).orderBy("n").collect()] == [1, 1, 2, 3]
    known = spark.createDataFrame([("p", "h1", "r1", 3)], "source_path string, hash string, row_key string, version int")
    new = spark.createDataFrame([(1, "q", "h1", "r9"), (2, "p", "h2", "r8"), (3, "q", "h3", "r1"), (4, "q", "h4", "r7")], "id int, source_path string, hash string, row_key string")
    assert [(r.decision, r.decided_version) for r in S.decide(new, known).orderBy("id").collect()] == [("skip", 3), ("update", 4), ("update", 4), ("new", 1)]


def test_json_blocks_and_walk():
    assert [*U.json_blocks('x {"a": "}"} y {"b": {"c": 1}} {bad}')] == ['{"a": "}"}', '{"b": {"c": 1}}']
    deep = {"name": "deep"}
    for _ in range(40):
        deep = {"a": [deep, {"hits": [deep] if "name" in deep else []}]}
    assert [*U.walk_hits({"data": '{"hits": [{"role": 1}, {"id": 9}, 3]}', "results": [{"name": 2, "hits": [{"skills": []}]}]})] == [{"name": 2, "hits": [{"skills": []}]}, {"role": 1}, {"skills": []}] and [*U.walk_hits(deep)] == [{"name": "deep"}]
    assert U.search_evidence('{"hits": [{"full_name": "A"}, {"name": "a "}, {"role": "r"}]}')[:2] == (2, "A")


def test_header_chunks():
    md = "intro\n# One\n" + "word " * 100 + "\n## Two\nshort"
    got = U.header_chunks(md, 200, 20)
    assert [s for _, s, _ in got][0] is None and got[-1][1:] == ("Two", "## Two\nshort") and all(len(c) <= 200 for *_, c in got) and [k for k, *_ in got] == list(range(1, len(got) + 1))


def test_docx_and_formats(spark, tmp_path):
    import io
    import zipfile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    names = '<w:style w:styleId="Titolo2"><w:name w:val="Heading 2"/></w:style>'
    p = lambda t, s="": f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{s}\"/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('Title', 'Titolo2')}{p('- item')}{p('Body')}{p('')}{p('goes on')}{table}{p('Last', 'Heading')}{p('3) third')}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {ns}>{names}</w:styles>")
    assert files.docx_paragraphs(out.getvalue()) == [(0, "heading", "Title", 2, False), (1, "list_item", "item", 1, False), (2, "paragraph", "Body\n\ngoes on", None, False), (3, "heading", "Last", 1, False), (4, "list_item", "third", 1, True)] and files.docx_paragraphs(b"no") == []
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.txt").write_bytes("perché".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.7")
    f = files.scan(spark, str(tmp_path))
    good, bad = files.accepted(f)
    sized = spark.createDataFrame([(1, 0), (2, 5), (3, files.MOST_BYTES + 1)], "id int, length bigint")
    assert [r.reason for r in files.accepted(sized)[1].orderBy("id").collect()] == ["empty", "too_large"] and bad.count() == 0
    assert {r.filename: r.f for r in good.select("filename", files.file_format(F.col("content"), F.coalesce(files.mime(F.col("filename")), F.lit(""))).alias("f")).collect()} == {"a.docx": "docx", "b.txt": "txt", "c.bin": "pdf"}
    assert good.where("filename = 'b.txt'").select(files.decoded(F.col("content")).alias("t")).first().t == "perché"
    assert files.docx_elements(good.where("filename = 'a.docx'")).count() == 5


def test_pdf_layout(spark):
    rows = [("d", 1, 0, 0, 0, 0.0, 0.0, 50.0, 20.0, 20.0, "Title"), ("d", 1, 1, 0, 0, 0.0, 30.0, 20.0, 41.0, 11.0, "one"), ("d", 1, 1, 0, 1, 20.5, 30.0, 40.0, 41.0, 11.0, "two"), ("d", 1, 1, 0, 2, 45.0, 30.0, 60.0, 41.0, 11.0, "three"), ("d", 1, 1, 1, 0, 0.0, 42.0, 60.0, 53.0, 11.0, "next"), ("d", 1, 2, 0, 0, 0.0, 200.0, 60.0, 211.0, 11.0, "far")]
    s = spark.createDataFrame(rows, files.SPANS)
    lines = L.lines(s)
    assert {r.text for r in lines.collect()} == {"Title", "onetwo three", "next", "far"}
    blocks = L.blocks(L.rows(lines), L.body_sizes(s)).orderBy("block").collect()
    assert [r.lines for r in blocks] == [["Title"], ["onetwo three", "next"], ["far"]]
    got = {r.text: (r.element_type, r.level) for r in L.elements(spark.createDataFrame(blocks)).collect()}
    assert got["Title"] == ("heading", 1) and got["onetwo three\nnext"] == ("paragraph", None)


def test_headings(spark):
    def head(t, size=11.0):
        return one(spark, F.struct(L.is_heading(F.lit(t), F.lit(size), F.lit(11.0)).alias("h"), L.heading_level(F.lit(t), F.lit(size), F.lit(11.0)).alias("l")))

    assert [(r.h, r.l) for r in (head("2.1 Scope"), head("ABOUT ME"), head("about me"), head("about me", 20.0), head("Ends.", 20.0), head("3D artist", 17.0), head("x" * 121, 20.0))] == [(True, 2), (True, 3), (False, 3), (True, 1), (False, 1), (True, 1), (False, 1)]


def test_tables_in_markdown(spark):
    rows = F.array(F.array(F.lit("a|b"), F.lit(" c ")), F.array(F.lit(" "), F.lit("")), F.array(F.lit("d")))
    assert one(spark, L.table_markdown(rows)) == "| a\\|b | c |\n| --- | --- |\n| d |  |" and one(spark, L.table_text(rows)) == "a|b | c\nd"
    assert one(spark, L.table_markdown(F.array(F.array(F.lit("h"), F.lit("k"))))) == "| h | k |\n| --- | --- |\n|  |  |" and one(spark, L.table_markdown(F.array(F.array(F.lit(" "))))) == ""


def test_messages(spark):
    import base64

    good = '{"blob": "b", "filename": "f", "source_path": "s"}'
    m = files.messages(spark.createDataFrame([(good,), (base64.b64encode(good.encode()).decode(),), ('{"blob": "b"}',), ("??",)], "value string"), "blob string, filename string, source_path string")
    assert sorted(r.rejected for r in m.collect()) == [False, False, True, True]


def test_settings_and_csv(spark, tmp_path):
    assert tables.settings("Server=a;Port=1;Pwd=x=y", port="2") == {"server": "a", "port": "2", "pwd": "x=y"}
    files.write_csv(spark.createDataFrame([(1, 'say "x"', 3)], "b int, a string, z int"), str(tmp_path / "o"), ["a", "b", "c"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o"))
    assert [c.lstrip("\ufeff") for c in back.columns] == ["a", "b", "c"] and back.first()[0] == 'say "x"'
    assert next((tmp_path / "o").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfa,b,c") and len(files.REPORT) == 37
    assert tables.connection({"DB_HOST": "env", "DB_USER": ""}, "host=a;port=1", port="9", name="n") == {"host": "env", "port": "1", "name": "n"}


def test_workbook(spark):
    import io
    import zipfile

    df = spark.createDataFrame([("a & b", 4.5), (None, 2.0), ("c", None)], "query string, final_score double")
    sheet = zipfile.ZipFile(io.BytesIO(files.workbook(df))).read("xl/worksheets/sheet1.xml").decode()
    assert "a &amp; b" in sheet and 's="1"><v>4.5' in sheet and 's="3"><v>2.0' in sheet and '<c s="4"/>' in sheet
    with pytest.raises(ValueError):
        files.workbook(df, most=2)


def test_blobs(spark, tmp_path):
    df = spark.createDataFrame([("x/a.md", bytearray(b"one"))], "blob string, content binary")
    for _ in range(2):
        df.foreachPartition(files.blob_writer(str(tmp_path)))
    path = str(tmp_path / "x/a.md")
    assert (tmp_path / "x/a.md").read_bytes() == b"one" and files.existing(spark, [path, path + "?"]) == [path]
    assert [r.filename for r in files.recent(files.scan(spark, str(tmp_path)), 1).collect()] == ["a.md"]
    assert files.delete_blob(spark, path) and not files.delete_blob(spark, path)


def test_nfkc_and_reencoding(spark):
    assert one(spark, U.nfkc()(F.lit("ﬁne  ＡＢＣ\x01"))) == "fine ABC" and one(spark, U.reencoded()(F.lit("perchÃ©"))) == "perché" and one(spark, U.reencoded()(F.lit("SÃO"))) == "SÃO"
