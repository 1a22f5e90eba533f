"""Sparse rows: products of a block, kernels and pipelines against the dense form."""

import numpy as np
import pyarrow as pa
import pytest

from rowmill.operators import features as feat
from rowmill.operators import blocks, kmeans, ridge, stats
from rowmill.operators import sparse as S
from rowmill.plans import pipelines
from rowmill.session import scratch_path
from rowmill.sources import libsvm

D = 40


def matrix(fill, n=300, d=D, seed=4):
    g = np.random.default_rng(seed)
    return np.where(g.random((n, d)) < fill, g.standard_normal((n, d)).round(3), 0.0)


def block(x):
    rows, cols = np.nonzero(x)
    starts = np.searchsorted(rows, np.arange(len(x) + 1))
    return S.SparseBlock(starts, cols, x[rows, cols], x.shape[1])


def sparse_frame(spark, x, y, parts=4):
    rows = [(float(v), (len(r), np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()), k) for k, (v, r) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "label double, features struct<size:int,indices:array<int>,values:array<double>>, id long").repartition(parts)


def dense_frame(spark, x, y, parts=4):
    return spark.createDataFrame([(float(v), r.tolist(), k) for k, (v, r) in enumerate(zip(y, x, strict=True))],
                                 "label double, features array<double>, id long").repartition(parts)


@pytest.mark.parametrize("fill", [0.0, 0.03, 0.2, 0.7, 1.0])
@pytest.mark.parametrize("chunk", [1 << 21, 37])
def test_products(fill, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_VALUES", chunk)
    x, g = matrix(fill), np.random.default_rng(1)
    b, p, y = block(x), g.standard_normal((D, 3)), g.standard_normal((300, 2))
    assert np.allclose(b @ p, x @ p) and np.allclose(b @ p[:, 0], x @ p[:, 0])
    assert np.allclose(b.T @ y, x.T @ y) and np.allclose(b.T @ b, x.T @ x)
    assert np.allclose(b.norms_sq(), (x * x).sum(axis=1)) and np.array_equal(b[7:90].dense(), x[7:90])
    out, want, to = np.zeros((5, D)), np.zeros((5, D)), g.integers(0, 5, 300)
    b.add_rows(out, to)
    np.add.at(want, to, x)
    assert np.allclose(out, want)


@pytest.mark.parametrize("row,said", [
    (None, "null rows"), ((3, [0], [1.0]), "unequal length"), ((4, [0, 0], [1.0, 2.0]), "ascend"), ((4, [2, 1], [1.0, 2.0]), "ascend"),
    ((4, [4], [1.0]), "outside"), ((4, [-1], [1.0]), "outside"), ((4, [0, 1], [1.0]), "indices than"), ((4, [0], [None]), "null elements"),
    ((4, None, None), "null rows")])
def test_bad_rows_fail(row, said):
    kind = pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    as_dict = lambda r: r and dict(zip(("size", "indices", "values"), r, strict=True))
    with pytest.raises(ValueError, match=said):
        S.SparseBlock.of(pa.array([as_dict((4, [1, 3], [1.0, 2.0])), as_dict(row)], kind), 4)


@pytest.mark.parametrize("method", ["gram", "matrix_free"])
def test_ridge_equals_dense(spark, method):
    x = matrix(0.1)
    y = x @ np.arange(D) + 1
    got, want = (ridge.ridge_cg(f(spark, x, y), "features", "label", 1e-3, D, method=method) for f in (sparse_frame, dense_frame))
    assert np.allclose(got.weights, want.weights, rtol=1e-7) and np.allclose(got.history, want.history, rtol=1e-6, atol=1e-12)
    phi = feat.fourier_map(spark, D, 70, 2.0)
    got, want = (ridge.ridge_cg(f(spark, x, y), "features", "label", 1e-2, 70, max_iter=5, method=method, rows=phi)
                 for f in (sparse_frame, dense_frame))
    assert np.allclose(got.weights, want.weights, rtol=1e-7)


def test_regression_pipeline_equals_dense(spark):
    x = matrix(0.1)
    x[:, 5] = 0                                                            # a feature that is never stored
    y = x @ np.arange(D) + 3
    got, want = (pipelines.ridge_regression(f(spark, x, y), 1e-4) for f in (sparse_frame, dense_frame))
    assert got.stats.max_abs == want.stats.max_abs and np.isclose(got.stats.label_mean, want.stats.label_mean)
    assert np.allclose(got.result.weights, want.result.weights, rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError, match="empty"):
        stats.sparse_scale_stats(sparse_frame(spark, x, y).limit(0), "label", "features", D)


def test_kmeans_equals_dense(spark):
    x = matrix(0.15) + np.eye(3)[np.arange(300) % 3].repeat(1, axis=0) @ np.pad(4 * np.eye(3), ((0, 0), (0, D - 3)))
    a, b = sparse_frame(spark, x, np.zeros(300)), dense_frame(spark, x, np.zeros(300))
    got, want = (kmeans.kmeans_fit(f, "features", 3, D, init="first", order_by="id") for f in (a, b))
    assert np.allclose(got.centers, want.centers) and got.iterations == want.iterations
    near = [sorted((r.id, r.prediction, round(r.distance_sq, 9)) for r in kmeans.assign(f, "features", want.centers, ["id"]).collect()) for f in (a, b)]
    assert near[0] == near[1]
    far = kmeans.kmeans_fit(a, "features", 3, D, init="k-means||", seed=3)
    assert far.cost_history[-1] <= 1.05 * want.cost_history[-1]


def test_parallel_init_of_few_distinct_rows(spark):
    x = np.repeat(np.eye(D)[:2], 50, axis=0)
    for f in (sparse_frame, dense_frame):
        centers = kmeans.parallel_init(f(spark, x, np.zeros(100)), "features", 4, D)
        assert centers.shape == (4, D) and {tuple(c) for c in centers} == {tuple(r) for r in np.eye(D)[:2]}


def test_scan_keeps_rows_sparse(spark):
    x = matrix(0.1, 50)
    path = scratch_path(spark, "sparse-libsvm")
    libsvm.write_libsvm(dense_frame(spark, x, np.arange(50) + 0.5), "label", "features", path)
    for width in (D, None):
        df = libsvm.read_libsvm_sparse(spark, path, width, label_cast="float_int")
        got = {r.label: r.features for r in df.collect()}
        size = D if width else int(np.flatnonzero(np.abs(x).sum(axis=0)).max()) + 1
        assert all(f.size == size and f.indices == np.flatnonzero(x[k]).tolist() and f.values == x[k][f.indices].tolist() for k, f in got.items())
        assert "vector_to_array" not in df._jdf.queryExecution().toString() and len(got) == 50
    spark.createDataFrame([("1 1:2 x:3",)], "value string").write.mode("append").text(path)
    with pytest.raises(Exception):
        libsvm.read_libsvm_sparse(spark, path, D).collect()
