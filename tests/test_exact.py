"""Exact sums: equal to math.fsum, and bit-equal whatever the partitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.operators import exact as X
from rowmill.operators import ridge, stats


def mixed(n, seed=1):
    g = random.Random(seed)
    some = [math.ldexp(g.uniform(-1, 1), g.choice([-1070, -600, -40, -3, 0, 5, 60, 900])) for _ in range(n)]
    return some + [-v for v in some[:n // 2]] + [5e-324, -5e-324, 0.0, -0.0, 1e308, -1e308, 1.0, 1e-16, 1e16]


@pytest.mark.parametrize("values", [[], [0.1] * 1000, mixed(4000), [1e16, 1.0, -1e16], [2.0 ** 53, 1.0, 1.0], [-1e-300] * 7])
def test_bins_hold_the_exact_sum(values, monkeypatch):
    monkeypatch.setattr(X, "RENORM_ROWS", 100)
    bins = np.zeros(X.BINS, np.int64)
    v = np.array(values, float)
    for a in range(0, len(v), 100):
        X._add(bins, v[a:a + 100])
        X._carry(bins)
    assert X.total({k: int(b) for k, b in enumerate(bins) if b}) == math.fsum(values)


def test_bins_do_not_overflow_between_carries():
    bins = np.zeros(X.BINS, np.int64)
    v = np.full(X.RENORM_ROWS, math.nextafter(2.0 ** 15, 0))
    X._add(bins, v)
    assert np.abs(bins).max() < 2 ** 62
    X._carry(bins)
    assert X.total({k: int(b) for k, b in enumerate(bins) if b}) == math.fsum(v)


def test_bit_equal_for_any_partitioning(spark):
    values = mixed(3000, 5)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {tuple(X.exact_sums(df.repartition(n), F.col("v"), F.col("v") * 0.1)) for n in (1, 7, 64)}
    assert got == {(math.fsum(values), math.fsum(v * 0.1 for v in values))}
    assert X.exact_sums(df.limit(0), F.col("v")) == [0.0]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_bad_values_fail(spark, bad):
    with pytest.raises(Exception, match="exact sum"):
        X.exact_sums(spark.createDataFrame([(1.0,), (bad,)], "v double"), F.col("v"))


def test_statistics_agree_and_repeat(spark, emb):
    w = [0.1 * j - 2 for j in range(64)]
    plain = [ridge.ridge_objective(emb, "features", "label", w, 0.1).first(), ridge.linear_mse(emb, "features", "label", w).first(),
             stats.frobenius_norm_sq(emb, "features", 64).first(), stats.label_mean(emb).first()]
    seen = set()
    for n in (1, 7, 64):
        df = emb.repartition(n)
        rows = [X.ridge_objective(df, "features", "label", w, 0.1).first(), X.linear_mse(df, "features", "label", w).first(),
                X.frobenius_norm_sq(df, "features", 64).first(), X.label_mean(df).first()]
        for a, b in zip(rows, plain, strict=True):
            assert np.allclose(list(a), [b[c] for c in a.asDict()], rtol=1e-11)
        grad = tuple(r.grad for r in X.ridge_gradient(df, "features", "label", w[:64], 0.1).orderBy("j").collect())
        cost = X.kmeans_cost(df, "features", np.eye(64)[:4]).first().cost
        seen.add((*[v for r in rows for v in r], grad, cost))
    assert len(seen) == 1
