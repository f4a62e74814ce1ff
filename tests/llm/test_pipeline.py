"""The pipeline's stages on the smallest tables, each against its own operator's brute force or promise."""

import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D).cache()
        assert out.columns == docs.columns
        now = {r.doc_id: r.text for r in out.collect()}
        assert set(now) <= set(before) and len(now) == out.count()
        if name == "line dedup":
            assert set(now) == set(before)
            assert all(len(now[i]) <= len(before[i]) for i in now)
        else:
            assert all(now[i] == before[i] for i in now)
        if name == "benchmark decontamination":
            items = [re.sub(r"\s+", " ", r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            assert not any(x in re.sub(r"\s+", " ", t) for t in now.values() for x in items)
        docs, before, kept = out, now, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert {r.doc_id for r in last} == set(kept) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0


def test_oracles_of_corpus_queries(spark):
    import duckdb

    from woodlot.llm import queries as Q

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    same = lambda v: v if v is None or isinstance(v, bool) else round(float(v), 9) if isinstance(v, (int, float)) else str(v)
    for name, sql in Q.oracle_sql().items():
        want = c.sql(sql)
        got = Q.queries()[name](spark, D).select(*want.columns)
        assert sorted(repr([same(v) for v in r]) for r in got.collect()) == sorted(repr([same(v) for v in r]) for r in want.fetchall()), name
