"""Row-local operators run unchanged on a streaming frame and give the
batch results."""

import numpy as np

from rowmill.operators import features as feat
from rowmill.operators import kmeans, ridge
from rowmill.session import scratch_path


def _drain(spark, stream_df, key="id"):
    got = {}

    def collect(batch, _epoch):
        for r in batch.collect():
            got[r[key]] = tuple(v for k, v in r.asDict().items() if k != key)

    q = (stream_df.writeStream.foreachBatch(collect)
         .option("checkpointLocation", scratch_path(spark, "t-stream-ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    return got


def _batch(df, key="id"):
    return {r[key]: tuple(v for k, v in r.asDict().items() if k != key) for r in df.collect()}


def test_stream_scoring_equals_batch(spark, emb):
    path = scratch_path(spark, "t-stream-in")
    base = emb.select("id", "features")
    base.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(base.schema).parquet(path)

    centers = np.array([r["features"] for r in emb.orderBy("id").limit(4).collect()])
    assert _drain(spark, kmeans.assign(stream, "features", centers, keep=["id"])) == \
        _batch(kmeans.assign(base, "features", centers, keep=["id"]))

    w = np.linspace(-1, 1, 64)
    assert _drain(spark, ridge.linear_score(stream, "features", w, keep=["id"])) == \
        _batch(ridge.linear_score(base, "features", w, keep=["id"]))

    z, v = feat.rff_params(64, 5, 1.0)
    got = _drain(spark, feat.apply_rff(stream, "features", z, v, keep=["id"]))
    want = _batch(feat.apply_rff(base, "features", z, v, keep=["id"]))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i][0], want[i][0]) for i in got)
