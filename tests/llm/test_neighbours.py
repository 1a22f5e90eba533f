"""Vantage-point trees against all inner products, in plain numpy."""

import numpy as np
import pytest

from rowmill.llm import neighbours as N
from rowmill.llm.vantage import Tree, build

SCHEMA = "vec_id long, embedding array<float>, id string, rank int, score string"


def brute(rows, queries, k):
    """Sorted (query_id, rank, vec_id, score); rows of (id, vector or None)."""
    ok = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in [(i, v) for i, v in ok if i in queries]:
        near = [(-sum_in_order(v, w), float("inf") if i is None else i, i) for i, w in ok if len(w) == len(v) and i != q]
        near.sort(key=lambda x: x[:2])
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(near[:k])]
    return sorted(out, key=repr)


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(np.float32(x)) * float(np.float32(y))
    return total


def table(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "x", 1, "y") for i, v in rows], SCHEMA).repartition(4)


def result(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(5)
    some = [(k, (g.normal(size=6) * g.choice([0.1, 1, 9])).astype(np.float32).tolist()) for k in range(900)]
    same = [(1000 + k, [1.0, 2, 0, 0, 0, -1]) for k in range(400)]             # one vector many times
    odd = [(2000, None), (2005, []), (2010, [0.0] * 6), (2015, [1.0, None, 0, 0, 0, 0]), (2020, [float("nan")] * 6),
           (2025, [float("inf"), 1, 1, 1, 1, 1]), (2030, [3.0, 4.0]), (2031, [1.0, 1.0]), (None, [2.0, 0, 0, 1, 0, 1]),
           (None, [2.0, 0, 0, 1, 0, 1]), (40, [5.0] * 6), (40, [5.0] * 6)]
    return some + same + odd


@pytest.mark.parametrize("shard_rows,k", [(100, 5), (700, 20), (8192, 2000)])
def test_factor_one_is_exact(spark, rows, shard_rows, k):
    df = table(spark, rows)
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    got = N.search(N.build_index(df, shard_rows=shard_rows), df.where("vec_id % 20 = 0"), k=k)
    assert result(got) == brute(rows, asked, k)


def test_many_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "CELL_TREES", 2)
    monkeypatch.setattr(N, "CELL_BLOCKS", 1)
    monkeypatch.setattr(N, "parts", lambda spark: 3)
    df = table(spark, rows)
    got = N.search(N.build_index(df, shard_rows=90), df.where("vec_id % 20 = 0"), k=7)
    assert result(got) == brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 7)


def test_no_rows_and_one_row(spark, rows):
    assert result(N.nearest(table(spark, []), table(spark, []))) == []
    df = table(spark, rows[:1])
    assert result(N.nearest(df, df)) == []
    assert result(N.nearest(table(spark, rows[1:3]), df)) == brute(rows[:3], {0}, 20)


def test_recall_and_pruning_by_factor():
    g = np.random.default_rng(2)
    x = g.normal(size=(6000, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, bounds = build(x)
    assert sorted(order) == list(range(6000))
    tree, q = Tree(x[order], order, bounds), x[:200]
    truth = np.argsort(-(q @ x.T), axis=1)
    looked = {}
    for factor in (1.0, 2.0):
        tree.visited = 0
        _, ids = tree.search(q, np.full(200, -1), 20, factor)
        looked[factor] = tree.visited
        recall = np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(ids, truth, strict=True)])
        assert recall == 1.0 if factor == 1 else recall >= 0.9
    assert looked[2.0] < 0.8 * looked[1.0] and looked[1.0] < 0.9 * 200 * 6000
