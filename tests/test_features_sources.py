"""Feature maps, scaling, vector functions and file sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.functions import vectors as V
from rowmill.functions.rng import JavaRandom
from rowmill.operators import features, stats
from rowmill.session import scratch_path
from rowmill.sources import csv as csv_src
from rowmill.sources import libsvm, matrix


def test_rff_layout_and_kernel(emb, emb_np):
    z, v = features.rff_params(64, 5, 2.0)
    g = JavaRandom(1234).next_gaussians(5 * 64)
    assert z[3, 0] == g[3] / 2.0 and z[0, 1] == g[5] / 2.0   # column-major fill
    assert v[0] == JavaRandom(4321).next_doubles(1)[0] * features.TWO_PI
    _, _, x = emb_np
    s = 4000
    out = features.rbf_random_features(emb, "features", 64, s, 1.0, keep=["id"], rng="numpy")
    phi = np.array([r["features"] for r in out.orderBy("id").limit(20).collect()])
    k_true = np.exp(-((x[:20, None] - x[None, :20]) ** 2).sum(-1) / 2.0)
    assert np.abs(phi @ phi.T - k_true).max() < 0.1


def test_count_sketch_matches_loop(spark):
    rows = [(0, {0: 1.0, 3: 2.0, 5: -1.0}), (1, {}), (2, {7: 4.0})]
    df = spark.createDataFrame(rows, "id long, m map<int,double>")
    out = {r["id"]: r["f"] for r in features.count_sketch(df, "m", 8, 4, keep=["id"], out="f").collect()}
    h, sg = features.sketch_params(8, 4)
    for i, m in rows:
        want = np.zeros(4)
        for j, x in m.items():
            want[h[j]] += sg[j] * x
        assert np.allclose(out[i], want)
    assert out[1] == [0.0] * 4


def test_scaling_zero_column(spark):
    df = spark.createDataFrame([(1.0, [0.0, 2.0]), (3.0, [0.0, -4.0])], "label double, features array<double>")
    out, st = stats.center_maxabs_scale(df, "label", "features", 2)
    rows = out.collect()
    assert st.label_mean == 2.0 and st.max_abs == [0.0, 4.0]
    assert [r["features"] for r in rows] == [[0.0, 0.5], [0.0, -1.0]]


def test_bandwidth_closed_form_equals_pairs(emb_np, emb):
    _, _, x = emb_np
    pair = ((x[:, None] - x[None]) ** 2).sum(-1).mean()
    got = stats.rbf_bandwidth(emb, d=64).first()["sigma_sq"]
    assert got == pytest.approx(pair, rel=1e-10)


def test_unequal_rows_fail_clearly(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "features array<double>")
    assert stats.dims(df).first()["d_min"] == 1
    with pytest.raises(ValueError):
        stats.require_dims(df)
    from rowmill.operators import blocks
    with pytest.raises(Exception, match="unequal length"):
        blocks.gram_times(df, "features", 2, np.ones(2))


def test_one_hot_and_argmax(spark):
    df = spark.createDataFrame([(2,), (0,)], "label int")
    assert [r[0] for r in df.select(V.one_hot("label", 3)).collect()] == [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]
    bad = spark.createDataFrame([(3,)], "label int")
    with pytest.raises(Exception, match="out of range"):
        bad.select(V.one_hot("label", 3)).collect()
    arr = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    assert arr.select(V.argmax("a")).first()[0] == 1


def test_libsvm_index_base_and_source(spark):
    lines = spark.createDataFrame([("1 1:0.5 3:2",), ("0",)], "value string")
    raw = libsvm.parse_libsvm_lines(lines, index_base=0, d=4).collect()
    assert raw[0]["features"] == {1: 0.5, 3: 2.0} and raw[0]["dense"] == [0.0, 0.5, 0.0, 2.0]
    assert raw[1]["features"] == {} and raw[1]["dense"] == [0.0] * 4
    shifted = libsvm.parse_libsvm_lines(lines, index_base=1).first()
    assert shifted["features"] == {0: 0.5, 2: 2.0}
    path = scratch_path(spark, "t-libsvm")
    spark.createDataFrame([("1 1:0.5 3:2",), ("7.9 2:1",)], "value string").write.text(path)
    back = libsvm.read_libsvm(spark, path, 3, label_cast="float_int").collect()
    assert back[0]["features"] == [0.5, 0.0, 2.0] and back[1]["label"] == 7


def test_labeled_csv_and_matrix_csv(spark):
    path = scratch_path(spark, "t-csv")
    spark.createDataFrame([(3, 1.5, 2.0), (1, 0.0, -1.0)], "c int, a double, b double") \
        .write.csv(path)
    rows = csv_src.read_labeled_csv(spark, path).orderBy("label").collect()
    assert [(r["label"], r["features"]) for r in rows] == [(0, [0.0, -1.0]), (2, [1.5, 2.0])]
    m = matrix.range_matrix(spark, 50, 10)
    p2 = scratch_path(spark, "t-mcsv")
    matrix.write_matrix_csv(m, p2, 10)
    back = matrix.read_matrix_csv(spark, p2, 10).orderBy("id").collect()
    assert back[7]["features"] == [float(70 + j) for j in range(10)]
    assert matrix.preview(m, 3, 2).collect()[2]["features"] == [20.0, 21.0]


def test_partition_control(lineitem):
    assert lineitem.count() == matrix.partition_control(lineitem, 5, coalesce=False).count()
    assert matrix.partition_control(lineitem, 5, coalesce=False).rdd.getNumPartitions() == 5
    assert matrix.partition_control(lineitem, 1).rdd.getNumPartitions() == 1


def test_empty_partitions_are_skipped(spark, emb):
    from rowmill.operators import moments
    a = moments.moments(emb, "features", 64, method="arrow")
    b = moments.moments(emb.repartition(700), "features", 64, method="arrow")
    assert np.allclose(a.xx, b.xx, atol=1e-12)


def test_count_sketch_matches_the_tables(spark):
    rows = [(i, {j: float(i * 3 + j) for j in range(0, 40, 1 + i % 5)}) for i in range(30)] + [(99, {})]
    df = spark.createDataFrame(rows, "id long, m map<int,double>").repartition(3)
    a = {r["id"]: r["f"] for r in features.count_sketch(df, "m", 40, 6, keep=["id"], out="f").collect()}
    h, sign = features.sketch_params(40, 6)
    b = {i: [sum(x * sign[j] for j, x in m.items() if h[j] == c) for c in range(6)] for i, m in rows}
    assert a.keys() == b.keys()
    for i in a:
        assert np.allclose(a[i], b[i])
    assert b[99] == [0.0] * 6


def test_count_sketch_preserves_dot_products_in_expectation():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal(50), rng.standard_normal(50)
    est = []
    for seed in range(400):
        h, sg = features.sketch_params(50, 8, seed=seed)
        px, py = np.zeros(8), np.zeros(8)
        np.add.at(px, h, sg * x)
        np.add.at(py, h, sg * y)
        est.append(px @ py)
    assert abs(np.mean(est) - x @ y) < 4 * np.std(est) / np.sqrt(len(est))


def test_bandwidth_by_block_averages_block_estimates(spark, emb, emb_np):
    _, _, x = emb_np
    blocks_ = emb.withColumn("blk", (F.col("id") % 3).cast("int"))
    got = stats.rbf_bandwidth(blocks_, d=64, by="blk").first()["sigma_sq"]
    ids = np.arange(len(x))
    want = np.mean([((x[ids % 3 == b][:, None] - x[ids % 3 == b][None]) ** 2).sum(-1).mean()
                    for b in range(3)])
    assert got == pytest.approx(want, rel=1e-10)


def test_null_feature_row_fails_clearly(spark):
    from rowmill.operators import blocks
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "features array<double>")
    with pytest.raises(Exception, match="null rows"):
        blocks.gram_times(df, "features", 2, np.ones(2))


def test_libsvm_without_dimension_infers_it(spark):
    path = scratch_path(spark, "t-libsvm-infer")
    spark.createDataFrame([("2 1:0.5 4:2",), ("1 2:1",)], "value string").write.text(path)
    rows = libsvm.read_libsvm(spark, path, label_cast="float_int").collect()
    assert sorted(len(r["features"]) for r in rows) == [4, 4]


def test_bandwidth_from_first_rows_per_block(spark, emb, emb_np):
    ids, _, x = emb_np
    blk = emb.withColumn("blk", (F.col("id") % 3).cast("int"))
    got = stats.rbf_bandwidth(blk, d=64, by="blk", first_rows=50, order_by="id").first()["sigma_sq"]
    want = []
    for b in range(3):
        xb = x[ids % 3 == b][:50]
        want.append(((xb[:, None] - xb[None]) ** 2).sum(-1).mean())
    assert got == pytest.approx(np.mean(want), rel=1e-10)
    whole = stats.rbf_bandwidth(emb, d=64, first_rows=100, order_by="id").first()["sigma_sq"]
    xf = x[:100]
    assert whole == pytest.approx(((xf[:, None] - xf[None]) ** 2).sum(-1).mean(), rel=1e-10)


def test_wide_statistics_paths_agree(emb, monkeypatch):
    df = emb.withColumn("blk", (F.col("id") % 3).cast("int"))
    m1 = {r["j"]: r["max_abs"] for r in stats.feature_max_abs(df, d=64).collect()}
    s1 = stats.scale_stats(df, "label", "features", 64)
    b1 = stats.rbf_bandwidth(df, d=64, by="blk").first()["sigma_sq"]
    monkeypatch.setattr(stats, "WIDE_D", 4)
    m2 = {r["j"]: r["max_abs"] for r in stats.feature_max_abs(df, d=64).collect()}
    s2 = stats.scale_stats(df, "label", "features", 64)
    b2 = stats.rbf_bandwidth(df, d=64, by="blk").first()["sigma_sq"]
    assert m1 == m2 and s1.max_abs == s2.max_abs
    assert s1.label_mean == pytest.approx(s2.label_mean, rel=1e-14)
    assert b1 == pytest.approx(b2, rel=1e-12)


def test_column_function_fallbacks_and_sql_paths(spark, emb, emb_np):
    from rowmill.operators import moments
    ids, labels, x = emb_np
    # higher-order-function forms (dimension unknown / above the expansion limit)
    rows = {r["id"]: r for r in emb.select(
        "id", V.norm_sq("features").alias("n2"), V.dot("features", "features").alias("dd"),
        V.sqdist("features", F.array_repeat(F.lit(0.0), 64)).alias("s0")).collect()}
    assert np.allclose([rows[i]["n2"] for i in ids], (x ** 2).sum(1))
    assert np.allclose([rows[i]["dd"] for i in ids], (x ** 2).sum(1))
    assert np.allclose([rows[i]["s0"] for i in ids], (x ** 2).sum(1))
    wide = emb.select("id", F.concat("features", "features", "features", "features",
                                     "features").alias("f"))            # 320 > 256 terms
    w = np.linspace(-1, 1, 320)
    sc = {r["id"]: r["s"] for r in wide.select("id", V.dot_const("f", w).alias("s")).collect()}
    assert np.allclose([sc[i] for i in ids], np.tile(x, 5) @ w)
    # sql (d <= 16) Gram and vector-label moments
    small = emb.select(V.one_hot("label", 10).alias("y"), F.slice("features", 1, 6).alias("features"))
    g = {(r["i"], r["j"]): r["g"] for r in moments.gram_matrix(small, "features", 6, method="sql").collect()}
    assert np.allclose([[g[(i, j)] for j in range(6)] for i in range(6)], x[:, :6].T @ x[:, :6])
    a = moments.moments(small, "features", 6, "y", 10, "vector", method="sql")
    b = moments.moments(small, "features", 6, "y", 10, "vector", method="arrow")
    assert np.allclose(a.xy, b.xy) and np.allclose(a.yy, b.yy) and a.n == b.n
