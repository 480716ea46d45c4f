"""All pN queries on empty tables, and on tables with nulls, long texts, repeated rows and extra columns."""

import pytest
from pyspark.sql import functions as F

from cvloom.llm import queries

NAMES = sorted(queries())
TABLES = ["hits", "llm_extraction_raw", "evaluations", "documents", "canonical_values", "mix_targets"]
KEYS = {"hits": "hit_id", "llm_extraction_raw": "raw_id", "evaluations": "eval_id", "documents": "doc_id"}
#: Names that the operators use inside.
CLASHES = ["id", "k", "t", "n", "word", "ids", "node", "a", "b", "rep", "token", "chain", "line", "block", "copy", "place", "row_id", "entity", "name", "field", "defect", "contexts", "tokens", "signature", "lang", "seg_no"]


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """Small tables with a row of nulls, a blank, a huge text, every tenth row twice under another key, and clashing columns."""
    out = str(tmp_path_factory.mktemp("odd"))
    texts = {"hits": ["content", "full_name"], "documents": ["text"], "evaluations": ["query", "response"], "llm_extraction_raw": ["email", "phone"]}
    for t in TABLES:
        df = spark.read.parquet(f"{small}/{t}.parquet")
        if t in KEYS:
            key = KEYS[t]
            df = df.limit(60)
            again = df.where(F.col(key) % 10 == 0).withColumn(key, F.col(key) + 1_000_000)
            one = df.limit(1)
            void = one.select(*[(F.lit(2_000_000) if c == key else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
            blank, huge = one.withColumn(key, F.lit(2_000_001).cast("bigint")), one.withColumn(key, F.lit(2_000_002).cast("bigint"))
            for c in texts[t]:
                blank = blank.withColumn(c, F.lit("  \n\t "))
                huge = huge.withColumn(c, F.repeat(F.lit("Una riga molto lunga è già qui, tel. 355 010 2030. "), 3000))
            df = df.unionByName(again).unionByName(void).unionByName(blank).unionByName(huge)
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c.lower() not in {x.lower() for x in df.columns}])
        df.coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    df = queries()[name](spark, empty)
    rows = df.collect()
    assert len(rows) == (0 if name != "p8_shares" else len(rows))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    df = queries()[name](spark, odd)
    assert df.count() >= 0
    if name == "p7_ids":
        got = {r.doc_id: r.ids for r in df.where("doc_id >= 2000000").collect()}
        assert got[2_000_000] == [] and got[2_000_001] and len(got[2_000_002]) > 10_000
    if name == "p4_found":
        got = {r.eval_id: r.defect for r in df.where("eval_id >= 2000000").collect()}
        assert got[2_000_000] == "empty_answer" and got[2_000_001] == "empty_answer"


COLUMNS = {
    "p1_found": "hit_id bigint, field string, item_pos int, canon_id int", "p2_found": "hit_a bigint, hit_b bigint", "p3_found": "name_a string, name_b string", "p4_found": "eval_id bigint, defect string",
    "p5_found": "hit_id bigint, seg_no int, lang string", "p6_found": "place string, row_id bigint, pii_type string, pii_text string", "p7_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, empty, name):
    assert ", ".join(f"{c} {k}" for c, k in queries()[name](spark, empty).dtypes) == COLUMNS[name]
