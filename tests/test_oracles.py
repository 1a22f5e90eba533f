"""Every registered query against its DuckDB SQL (rows, names, values),
as the driver's correctness gate does, on the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from rowmill.plans.queries import ORACLES, QUERIES
from settings import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _canon(rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_declared():
    assert set(ORACLES) == set(QUERIES) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["iter", "objective", "train_error"]
    assert df.count() >= 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert len(got) == len(want)
    assert _canon(got) == _canon(want)
