import duckdb
import pytest

import corpus_pipeline
from voucherflow.llm import jaccard, linededup, mixing
from voucherflow.llm.common import DOCUMENT_COLUMNS

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        assert docs.columns[: len(DOCUMENT_COLUMNS)] == DOCUMENT_COLUMNS and (i == 4 or docs.columns == DOCUMENT_COLUMNS)
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= set(before) and now
        before = {k: before[k] for k in now}
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) == sorted(map(repr, docs.collect()))


def test_odd_and_empty_documents(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
    assert docs.columns[:5] == DOCUMENT_COLUMNS
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, SF), "test")
    assert empty.count() == 0


@pytest.mark.parametrize(("stage", "oracle"), [(1, linededup.ORACLE), (2, jaccard.ORACLE), (4, mixing.ORACLE)])
def test_stages_equal_the_sql_of_their_operators(spark, stage, oracle):
    """Each on the rows that it gets: SQL over the same input says what is kept, and how."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.01")
    if stage == 1:
        want = con.sql(f"SELECT doc_id, text FROM ({oracle}) WHERE removed_words = 0 OR regexp_matches(text, '[^\\x20\\x09-\\x0D]')")
        got = out.select("doc_id", "text")
    elif stage == 2:
        want, got = con.sql(f"SELECT DISTINCT class_id FROM ({oracle})"), out.select("doc_id")
    else:
        want, got = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({oracle}) WHERE taken > 0"), out.select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
