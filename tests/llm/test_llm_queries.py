"""Registered queries against DuckDB at the smallest scale, and the pipeline on its own input."""

import os

import pytest
from brute_force import brute_similar

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("name", ["op1_spotsigs", "op3_warc_salvage", "op5_curriculum_mix", "op8_positional_decontamination", "op11_mtree_topk", "op12_presence_mask_search"])
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    expected = sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in cursor.fetchall()), key=str)
    assert rows_of(entry.queries()[name](spark, DATA)) == expected


def test_pipeline_stages(spark):
    import corpus_pipeline
    from quarrylake.llm import decontaminate, pii, toxicity
    from quarrylake.storage import stash, table

    docs = table(spark, DATA, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stash(stage(spark, docs, DATA), "test")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        seen = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= seen
        if name == "toxicity":
            judged = toxicity.judge(before, table(spark, DATA, "labels")).collect()
            assert ids == {r["doc_id"] for r in judged if not r["is_toxic"]}
        elif name.startswith("simhash"):
            assert ids == set(brute_similar({r["doc_id"]: r["text"] for r in before.collect()}).values())
        elif name.startswith("benchmark"):
            assert ids == {r["doc_id"] for r in decontaminate.report(before, table(spark, DATA, "benchmark")).where("not contaminated").collect()}
        elif name == "pii":
            assert ids == seen
            assert pii.find(docs).where("exists(spans, s -> s.ok)").count() == 0
    assert docs.where("mix_taken <= 0").count() == 0
