"""Statistics above WIDE_D: one row of vectors per task, nothing exploded before it."""

import numpy as np
import pytest

from rowmill.operators import stats

SCHEMA = "id long, label double, features array<double>"


@pytest.fixture(scope="module")
def wide(spark):
    g = np.random.default_rng(0)
    x = g.standard_normal((300, 90)) * 3 + 1e4
    x[:, 5] = 0.0
    y = g.standard_normal(300) + 7
    df = spark.createDataFrame([(i, float(y[i]), [float(v) for v in x[i]]) for i in range(300)], SCHEMA)
    return df.repartition(7), x, y


def test_matches_numpy(wide):
    df, x, y = wide
    s = stats.scale_stats(df, "label", "features", 90)
    assert s.label_mean == pytest.approx(y.mean(), rel=1e-12)
    assert np.allclose(s.max_abs, np.abs(x).max(axis=0), rtol=0, atol=0)
    got = {r["j"]: r["max_abs"] for r in stats.feature_max_abs(df, "features", 90).collect()}
    assert [got[j] for j in range(90)] == s.max_abs
    sigma_sq = stats.rbf_bandwidth(df, "features", 90).first()["sigma_sq"]
    assert sigma_sq == pytest.approx(2 * x.var(axis=0).sum(), rel=1e-10)


def test_same_on_both_sides_of_the_switch(wide, monkeypatch):
    df, _, _ = wide
    a = stats.scale_stats(df, "label", "features", 90)
    b = stats.rbf_bandwidth(df, "features", 90).first()
    monkeypatch.setattr(stats, "WIDE_D", 128)
    assert stats.scale_stats(df, "label", "features", 90).max_abs == a.max_abs
    assert stats.rbf_bandwidth(df, "features", 90).first()["sigma_sq"] == pytest.approx(b["sigma_sq"], rel=1e-9)


def test_plan_explodes_tasks_not_rows(wide):
    df, _, _ = wide
    plan = stats.feature_max_abs(df, "features", 90)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    generate = next(i for i, x in enumerate(lines) if "Generate" in x)
    assert any("MapInArrow" in x for x in lines[generate:])


@pytest.mark.parametrize("limit", [64, 128])
def test_bad_rows_fail_on_both_sides(spark, limit, monkeypatch):
    monkeypatch.setattr(stats, "WIDE_D", limit)
    row = [1.0] * 90
    for y, bad in ((1.0, row + [2.0]), (1.0, None), (None, row), (1.0, [None, *row[1:]])):
        df = spark.createDataFrame([(0, 0.0, row), (1, y, bad)], SCHEMA)
        with pytest.raises(Exception):  # noqa: B017
            stats.scale_stats(df, "label", "features", 90)
