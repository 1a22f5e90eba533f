"""One outcome for bad rows on both sides of every size switch: null rows, null
elements, null labels, short and long rows, indices out of range and malformed
lines fail the query; they are never dropped, cut or counted as correct."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.functions import vectors as V
from rowmill.operators import features, kmeans, moments, ridge, stats
from rowmill.session import scratch_path
from rowmill.sources import csv, matrix

SCHEMA = "id long, label double, features array<double>"
BAD = {"null row": (1.0, None), "null element": (1.0, "hole"), "null label": (None, "row"),
       "short row": (1.0, "short"), "long row": (1.0, "long")}


def frame(spark, d, bad):
    row = [0.5 + j for j in range(d)]
    y, kind = BAD[bad]
    x = {None: None, "hole": [None, *row[1:]], "row": row, "short": row[:-1], "long": [*row, 100.0]}[kind]
    return spark.createDataFrame([(0, 0.0, row), (1, y, x), (2, 1.0, row)], SCHEMA).coalesce(1)


def fails(df):
    with pytest.raises(Exception):  # noqa: B017 - the JVM, a worker or the driver refuses the row
        df().collect() if callable(df) else df.collect()


LABELLED = {
    "moments": lambda df, d, m: _run(lambda: moments.moments(df, "features", d, "label", method=m)),
    "cross_moment": lambda df, d, m: moments.cross_moment(df, "features", "label", d, method=m),
}
ROWS = {"gram_matrix": lambda df, d, m: moments.gram_matrix(df, "features", d, method=m)}


class _run:
    def __init__(self, fn):
        self.fn = fn

    def collect(self):
        return self.fn()


@pytest.mark.parametrize("method", ["sql", "arrow"])
@pytest.mark.parametrize("bad", list(BAD))
def test_moment_kernels(spark, bad, method):
    df = frame(spark, 3, bad)
    for fn in [*LABELLED.values(), *(ROWS.values() if bad != "null label" else ())]:
        fails(fn(df, 3, method))


@pytest.mark.parametrize("d", [3, 300])          # below and above EXPAND_LIMIT
@pytest.mark.parametrize("bad", [b for b in BAD if b != "null label"])
def test_row_functions(spark, bad, d):
    assert 3 < V.EXPAND_LIMIT < 300
    df = frame(spark, d, bad)
    w = [1.0] * d
    columns = [V.dot_const("features", w), V.sqdist_const("features", w), V.scale_by("features", w),
               V.dot("features", F.array(*[F.lit(1.0)] * d), d), V.sqdist("features", F.array(*[F.lit(1.0)] * d), d),
               V.norm_sq("features", d)]
    for c in columns:
        fails(df.select(c.alias("v")))


@pytest.mark.parametrize("limit", [4096, 0])     # column arithmetic and GEMM per batch
@pytest.mark.parametrize("bad", list(BAD))
def test_misclassification(spark, bad, limit, monkeypatch):
    monkeypatch.setattr(ridge, "SCORE_EXPR_TERMS", limit)
    df = frame(spark, 3, bad)
    fails(ridge.misclassification(df, "features", "label", np.ones((3, 2))))
    if bad != "null label":
        fails(ridge.predict_class(df, "features", np.ones((3, 2))))


@pytest.mark.parametrize("bad", list(BAD))
def test_model_evaluation(spark, bad):
    df = frame(spark, 3, bad)
    w = [1.0, 2.0, 3.0]
    fails(ridge.ridge_objective(df, "features", "label", w, 0.1))
    fails(ridge.ridge_gradient(df, "features", "label", w, 0.1))
    fails(ridge.linear_mse(df, "features", "label", w))
    fails(_run(lambda: ridge.ridge_cg(df, "features", "label", 0.1, 3)))


@pytest.mark.parametrize("bad", ["null row", "null element", "short row", "long row"])
def test_assign_and_scale(spark, bad):
    df = frame(spark, 3, bad)
    fails(kmeans.assign(df, "features", np.ones((2, 3))))
    fails(df.select(V.scale_by("features", [1.0, 2.0, 0.0])))


@pytest.mark.parametrize("key", [-2, 4])
@pytest.mark.parametrize("d", [4, 5000])
def test_sparse_indices(spark, key, d):
    key = key if key < 0 else d
    df = spark.createDataFrame([(0, {0: 1.0}), (1, {key: 7.0})], "id long, m map<int,double>")
    fails(df.select(V.densify_map("m", d)))
    fails(features.count_sketch(df, "m", d, 3))


def test_sparse_null_values(spark):
    df = spark.createDataFrame([(0, {0: None}), (1, None)], "id long, m map<int,double>")
    for k in (0, 1):
        fails(df.where(F.col("id") == k).select(V.densify_map("m", 4)))


@pytest.mark.parametrize("line", ["2,oops,1.0", "2,1.0", "2,,1.0", "bad,1.0,2.0", ",1.0,2.0"])
@pytest.mark.parametrize("d", [2, None])
def test_csv_lines(spark, line, d):
    path = scratch_path(spark, "bad-csv").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as f:
        f.write(f"1,0.5,0.25\n{line}\n")
    fails(csv.read_labeled_csv(spark, path, d=d))


def test_flat_label_prediction_line(spark):
    path = scratch_path(spark, "flat").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/a.txt", "w") as f:
        f.write("1 0 2 1 1 0 3 2\n5 5\n\n")
    got = sorted(tuple(r) for r in matrix.read_label_pred(spark, path).collect())
    assert got == [(1, 0), (1, 0), (2, 1), (3, 2), (5, 5)]


def test_training_error_keeps_its_digits(spark):
    """Uncentred labels around 1e6 that a line fits almost exactly."""
    g = np.random.default_rng(5)
    x = g.standard_normal((200, 2))
    rows = [(i, float(1e6 + 3 * a - b), [1.0, float(a), float(b)]) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    res = ridge.ridge_cg(df, "features", "label", 0.0, 3, record_every=1)
    f = np.array([r[2] for r in rows])
    y = np.array([r[1] for r in rows])
    want = float(((f @ res.weights - y) ** 2).mean())
    assert res.history[-1][2] == pytest.approx(want, rel=1e-6, abs=1e-12) and want < 1e-3


def test_statistics_refuse_bad_rows(spark):
    df = frame(spark, 3, "long row")
    fails(_run(lambda: stats.center_maxabs_scale(df, "label", "features", 3)[0].collect()))


@pytest.mark.parametrize("d", [None, 2])
@pytest.mark.parametrize("bad", ["2,3,4,5", "2,3", "2,3,x", "2,,3"])
def test_csv_line_of_another_width_fails(spark, tmp_path, d, bad):
    from rowmill.sources.csv import read_labeled_csv

    good = tmp_path / "good"
    good.mkdir()
    (good / "a.csv").write_text("1,2,3\n2,3,4\n")
    assert sorted(tuple(r.features) for r in read_labeled_csv(spark, str(good), d).collect()) == [(2.0, 3.0), (3.0, 4.0)]
    (good / "b.csv").write_text(f"1,2,3\n{bad}\n")
    with pytest.raises(Exception):
        read_labeled_csv(spark, str(good), d).collect()
