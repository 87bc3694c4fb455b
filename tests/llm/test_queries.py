import duckdb
import pytest

import corpus_pipeline
from loamwatch.llm import registry


def test_every_operator_has_a_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in registry.QUERIES)] == []
    assert "pipeline" in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
        docs = docs.cache()
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("NOT round_trip").count() == 0


def test_pipeline_of_odd_rows(spark, odd, none, small):
    """Odd rows fail the fixed rules, all but the very long texts; those are near copies, so the later one goes."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
    assert docs.count() <= 1 and {r.doc_id for r in docs.collect()} <= {4}
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_each_stage_of_odd_rows(spark, odd, small):
    """What each stage alone makes of them: ids of the rows that it keeps."""
    ids = lambda t: sorted((r.doc_id for r in t.collect()), key=str)
    quality, lines, near, leaks, tokens = (f for _, f in corpus_pipeline.STAGES)
    every = ids(odd)
    assert set(ids(quality(spark, odd, small))) <= {4, 5}
    assert ids(lines(spark, odd, small)) == every
    # repeated rows become one, 5 is a copy of 4; empty texts, with null ids and without, are copies of each other
    kept = near(spark, odd, small)
    assert kept.columns == corpus_pipeline.COLUMNS
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(set(texts)) == len(texts) and 5 not in ids(kept) and ids(kept).count(1) == 2 and {1, 4, 7} <= set(ids(kept))
    assert ids(leaks(spark, odd, small)) == every
    encoded = tokens(spark, odd, small)
    assert ids(encoded) == every and encoded.where("NOT round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    rows = registry.QUERIES[name](spark, small).count()
    every = {f"op{n}" for n in (2, 3, 4, 5, 7, 8, 9, 10, 11, 13)}
    if (op := name.split("_")[0]) in every:
        assert rows == docs
    elif op == "op12":
        assert rows == spark.read.parquet(f"{small}/embeddings.parquet").count()
    else:
        assert 0 < rows < docs * 10


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    names = sorted(want.columns)
    got = registry.QUERIES[name](spark, small).select(names)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(map(tuple, got.collect())) == text(want.select(*names).fetchall())
