"""Registered queries and the pipeline over the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from qalytics.llm import common as C
from qalytics.llm import queries
from tests.conftest import SF0001
from tests.llm.test_operators import brute_components


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF0001)
    res = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall())


def test_pipeline_stages(spark):
    docs = C.table(spark, SF0001, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = C.stage(stage(spark, before, SF0001), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {i for i, n, c in brute_components([i for i, _ in rows], [t for _, t in rows], 5, 80, 100) if n == 0 or c == i}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "source_mixing":
            kept = {r.doc_id: r.text for r in before.collect()}
            assert all(kept[r.doc_id] == r.text for r in docs.collect())
    assert docs.count() > 0 and docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()
