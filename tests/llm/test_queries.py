"""Registered queries on driver tables: DuckDB SQL where there is one, and the
pipeline stage by stage against plain Python."""

import duckdb
import pytest

import __spark_entry__ as E
import llm_brute as brute
import corpus_pipeline
from rowmill.llm import queries as Q
from rowmill.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_queries_are_registered():
    numbered = {n.split("_")[0] for n in E.queries() if n.startswith("op")}
    assert numbered == {f"op{k}" for k in range(1, 14)} and "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    res = duck.execute(Q.ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(res.fetchall(), key=repr)


def test_pipeline_stages(spark, duck):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = source, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = written(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.dtypes == source.dtypes
        kept[name] = before, docs.collect()
    labels = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    before, after = kept["toxicity"]
    left = {r.doc_id for r in after}
    clean = [i for i, _ in before if labels.get(i) == 0]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)
    before, after = kept["line_dedup"]
    assert sorted((r.doc_id, brute.sha(r.text)) for r in after) == sorted((i, h) for i, _, _, h in brute.line_dedup(before))
    before, after = kept["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in brute.near(before) if i == c)
    before, after = kept["decontamination"]
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert sorted(r.doc_id for r in after) == sorted(r[0] for r in brute.contamination(before, items) if not r[5])
    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {i for i, _ in before}
    total = {}
    for r in after:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 2048 and len(total) <= -(-sum(total.values()) // 2048) + 1
