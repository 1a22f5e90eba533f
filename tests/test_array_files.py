"""Array files: plan of ranges, round trip, what is read; distances of pairs in blocks."""

import os

import numpy as np
import pytest

from rowmill.operators import stats
from rowmill.session import scratch_path
from rowmill.sources import array_files as A


def test_plan_of_ranges():
    shards = [("a", 5), ("b", 0), ("c", 7)]
    assert A.plan_ranges(shards, 0, None, 4) == [("a", 0, 4), ("a", 4, 5), ("c", 0, 4), ("c", 4, 7)]
    assert A.plan_ranges(shards, 3, 7, 100) == [("a", 3, 5), ("c", 0, 2)]
    assert A.plan_ranges(shards, 12, None, 4) == A.plan_ranges(shards, 4, 4, 4) == A.plan_ranges([], 0, None, 4) == []


@pytest.fixture(scope="module")
def stored(spark, emb, emb_np):
    path = scratch_path(spark, "t-array")
    A.write_array_files(emb, path, 64, "features", "id", shards=5)
    ids, _, x = emb_np
    return path, ids, x


def test_round_trip(spark, stored):
    path, ids, x = stored
    got = sorted((r.id, r.features) for r in A.read_array_files(spark, path, split_rows=7).collect())
    assert [g[0] for g in got] == ids.tolist() and np.array_equal(np.array([g[1] for g in got]), x)


def test_only_the_asked_rows_are_planned_and_read(spark, stored):
    path, ids, x = stored
    df = A.read_array_files(spark, path, 30, 41, split_rows=4)
    got = sorted((r.id, r.features) for r in df.collect())
    assert [g[0] for g in got] == ids[30:41].tolist() and np.array_equal(np.array([g[1] for g in got]), x[30:41])
    sizes = df.rdd.glom().map(len).collect()
    assert sum(sizes) == 11 and max(sizes) <= 4
    assert A.read_array_files(spark, path, 10 ** 9).count() == 0
    with pytest.raises(ValueError):
        A.read_array_files(spark, path, 5, 2)


def test_shards_are_plain_npy(stored):
    folder = A._local(stored[0])
    names = sorted(n for n in os.listdir(folder) if n.endswith(".npy") and ".ids" not in n)
    assert np.array_equal(np.vstack([np.load(os.path.join(folder, n)) for n in names]), stored[2])
    assert not [n for n in os.listdir(folder) if n.startswith("_part")]


def test_bad_rows_fail_and_empty_is_empty(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, features array<double>")
    for rows in ([(1, None)], [(1, [1.0])], [(1, [1.0, None])], [(None, [1.0, 2.0])]):
        with pytest.raises(Exception):
            A.write_array_files(frame(rows), scratch_path(spark, "t-bad"), 2)
    path = scratch_path(spark, "t-empty")
    A.write_array_files(frame([]), path, 2)
    assert A.read_array_files(spark, path).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        A._local("hdfs://host/x")


def test_pairs_of_blocks(spark, emb, emb_np):
    ids, label, x = emb_np
    got = {(r.block, r.a, r.b): r.sqdist for r in stats.pairwise_sqdist(emb, "label", "id", "features", 64, rows=6).collect()}
    want = {}
    for c in np.unique(label):
        some = np.flatnonzero(label == c)[:6]
        want |= {(c, ids[i], ids[j]): ((x[i] - x[j]) ** 2).sum() for i in some for j in some}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert got[next(iter((c, i, i) for c, i, j in want if i == j))] == 0
