"""Fits on random features mapped inside their passes, against the stored form."""

import numpy as np
import pytest

from rowmill.operators import features as feat
from rowmill.operators import ridge
from rowmill.plans import pipelines
from rowmill.plans.queries import EMB_D, K

S = 96


@pytest.fixture(scope="module")
def both(spark, emb):
    src = emb.select("id", "features", "label")
    stored = feat.rbf_random_features(src, "features", EMB_D, S, 1.0, keep=["id", "label"]).cache()
    return src, stored, feat.fourier_map(spark, EMB_D, S, 1.0)


@pytest.mark.parametrize("method", ["gram", "matrix_free"])
def test_block_cg(both, method):
    src, stored, phi = both
    a = ridge.ridge_multitask_cg(src, "features", "label", 1e-3, S, K, max_iter=6, rel_tol=None, method=method, rows=phi)
    b = ridge.ridge_multitask_cg(stored, "features", "label", 1e-3, S, K, max_iter=6, rel_tol=None, method=method)
    assert np.allclose(a.weights, b.weights, rtol=1e-9, atol=1e-12) and a.n == b.n
    assert [t for t, _ in a.history] == [t for t, _ in b.history]
    wrong = [ridge.misclassification(d, "features", "label", a.weights, rows=r).first() for d, r in ((src, phi), (stored, None))]
    assert wrong[0] == wrong[1]
    got = {r.id: r.prediction for r in ridge.predict_class(src, "features", a.weights, ["id"], rows=phi).collect()}
    assert got == {r.id: r.prediction for r in ridge.predict_class(stored, "features", a.weights, ["id"]).collect()}


@pytest.mark.parametrize("method", ["gram", "matrix_free"])
def test_single_output_cg_and_history(both, method):
    src, stored, phi = both
    src, stored = (d.withColumn("label", d["label"].cast("double")) for d in (src, stored))
    a = ridge.ridge_cg(src, "features", "label", 1e-3, S, max_iter=5, rel_tol=None, method=method, rows=phi)
    b = ridge.ridge_cg(stored, "features", "label", 1e-3, S, max_iter=5, rel_tol=None, method=method)
    assert np.allclose(a.weights, b.weights, rtol=1e-9) and np.allclose(a.history, b.history, rtol=1e-9)


def test_pipeline_stores_no_mapped_row(spark, emb, monkeypatch):
    """What the matrix-free fit persists is the 64-wide input."""
    kept = []
    real = ridge.blocks.persist_for_passes

    def spy(df, columns, persist=True):
        frame = real(df, columns, persist)
        kept.append(frame.df)
        return frame

    monkeypatch.setattr(ridge.blocks, "persist_for_passes", spy)
    monkeypatch.setattr(pipelines.feat, "rbf_random_features", lambda *a, **k: pytest.fail("mapped rows as a column"))
    src = emb.select("features", "label")
    run = pipelines.rfm_classification(src, K, 512, 1e-3, 1.0, d=EMB_D, max_iter=2, method="matrix_free")
    assert run.result.weights.shape == (512, K) and len(kept) == 1
    assert "cos" not in kept[0]._jdf.queryExecution().toString().lower()


def test_row_map_of_another_width_fails(spark, emb):
    phi = feat.fourier_map(spark, EMB_D, 8, 1.0)
    with pytest.raises(Exception, match="row map"):
        ridge.ridge_cg(emb.selectExpr("features", "cast(label as double) label"), "features", "label", 1.0, 9, rows=phi)


def test_chunks_inside_a_batch(both, monkeypatch):
    src, stored, phi = both
    x = np.random.default_rng(0).standard_normal((50, EMB_D))
    monkeypatch.setattr(ridge.blocks, "CHUNK_BYTES", 8 * S * 7)
    import pyarrow as pa
    batch = pa.record_batch([ridge.blocks.list_array(x)], names=["features"])
    parts = list(ridge.blocks.pieces(batch, "features", S, phi))
    assert len(parts) > 5 and np.allclose(np.vstack([p for _, _, p in parts]), phi(x))
