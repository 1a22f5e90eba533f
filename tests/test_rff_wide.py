"""The registered random-feature pipelines at 64 features, against numpy."""

import numpy as np
from settings import SF_SMALL
from rowmill.operators import features as feat
from rowmill.plans.queries import GAMMA_SCALED, K, MT_GAMMA, QUERIES, RFF_SIGMA


def mapped(x, s, sigma):
    z, v = feat.rff_params(x.shape[1], s, sigma)
    return np.sqrt(2 / s) * np.cos(x @ z.T + v)


def test_classification_runs_on_64_features(spark, emb_np):
    _, y, x = emb_np
    p = mapped(x, 64, RFF_SIGMA)
    w = np.linalg.solve(p.T @ p + len(y) * MT_GAMMA * np.eye(64), p.T @ np.eye(K)[y])
    wrong = int(((p @ w).argmax(axis=1) != y).sum())
    for name in ("pipeline_rfm_classification_wide", "pipeline_rfm_classification_csv_wide"):
        row = QUERIES[name](spark, SF_SMALL).first()
        assert (row["errors"], row["n"]) == (wrong, len(y))
    assert QUERIES["argmax_class_wide"](spark, SF_SMALL).where("label <> prediction").count() == wrong


def test_regression_runs_on_64_features(spark, li_np):
    x, y = li_np
    x, y = x / np.abs(x).max(axis=0), y - y.mean()
    p = mapped(x, 64, np.sqrt(2 * x.var(axis=0).sum()))
    w = np.linalg.solve(p.T @ p + len(y) * GAMMA_SCALED * np.eye(64), p.T @ y)
    got = QUERIES["pipeline_rfm_regression_wide"](spark, SF_SMALL).orderBy("j").collect()
    assert len(got) == 64 and np.abs([r["weight"] for r in got] - w).max() < 1e-4
    assert abs(got[0]["train_error"] - ((p @ w - y) ** 2).mean()) < 1e-5
