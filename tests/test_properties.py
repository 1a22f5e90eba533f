"""Property tests (hypothesis) for the pieces with subtle state: the seeded
generator (block jump-ahead, rejection rewinds, the cached gaussian) and the
GEMM nearest-centre rule."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmill.functions.rng import JavaRandom
from rowmill.operators import blocks

chunks = st.lists(st.integers(min_value=0, max_value=1500), min_size=1, max_size=6)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(-2**40, 2**40), parts=chunks)
def test_doubles_chunking_is_invisible(seed, parts):
    whole = JavaRandom(seed).next_doubles(sum(parts))
    r = JavaRandom(seed)
    got = np.concatenate([r.next_doubles(p) for p in parts])
    assert np.array_equal(whole, got)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(-2**40, 2**40), parts=chunks,
       bound=st.one_of(st.integers(1, 100), st.integers(2**30, 2**31 - 1), st.sampled_from([2, 16, 1024])))
def test_ints_chunking_is_invisible(seed, parts, bound):
    whole = JavaRandom(seed).next_ints(bound, sum(parts))
    r = JavaRandom(seed)
    got = np.concatenate([r.next_ints(bound, p) for p in parts])
    assert np.array_equal(whole, got)
    assert whole.size == 0 or (whole.min() >= 0 and whole.max() < bound)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(-2**40, 2**40), parts=chunks)
def test_gaussians_chunking_is_invisible(seed, parts):
    whole = JavaRandom(seed).next_gaussians(sum(parts))
    r = JavaRandom(seed)
    got = np.concatenate([r.next_gaussians(p) for p in parts])
    assert np.array_equal(whole, got)


@settings(max_examples=30, deadline=None)
@given(seed=st.integers(0, 2**32 - 1), k=st.integers(2, 20), d=st.integers(1, 60),
       dup=st.booleans())
def test_gemm_nearest_centre_equals_exact(seed, k, d, dup):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((300, d)) * rng.uniform(0.01, 100)
    c = rng.standard_normal((k, d)) * rng.uniform(0.01, 100)
    if dup:
        c[k - 1] = c[0]
        x[:5] = c[0]
    a1, d1 = blocks.nearest_center(x, c)
    a2, d2 = blocks._nearest_exact(x, c)
    assert np.array_equal(a1, a2)
    assert np.array_equal(d1, d2)


def _nmi_np(u, v):
    n = len(u)
    cu, cv = np.unique(u, return_counts=True), np.unique(v, return_counts=True)
    pairs, cuv = np.unique(np.stack([u, v], 1), axis=0, return_counts=True)
    pu = dict(zip(cu[0], cu[1] / n))
    pv = dict(zip(cv[0], cv[1] / n))
    mi = sum(c / n * np.log((c / n) / (pu[a] * pv[b])) for (a, b), c in zip(pairs, cuv))
    hu = -sum(p * np.log(p) for p in pu.values())
    hv = -sum(p * np.log(p) for p in pv.values())
    if len(pu) == 1 and len(pv) == 1:
        return 1.0
    if len(pu) == 1 or len(pv) == 1 or mi <= 0:
        return 0.0
    return 2 * mi / (hu + hv)


@settings(max_examples=6, deadline=None)
@given(u=st.lists(st.integers(0, 3), min_size=1, max_size=60), data=st.data())
def test_nmi_matches_brute_force_and_is_invariant(spark, u, data):
    from rowmill.operators import nmi
    v = data.draw(st.lists(st.integers(0, 4), min_size=len(u), max_size=len(u)))
    u, v = np.array(u), np.array(v)
    df = spark.createDataFrame([(int(a), int(b), int((a * 7 + 3) % 11)) for a, b in zip(u, v)],
                               "u int, v int, w int")
    got = nmi.nmi(df, "u", "v").first()["nmi_arithmetic"]
    assert got == pytest.approx(_nmi_np(u, v), abs=1e-12)
    assert nmi.nmi(df, "v", "u").first()["nmi_arithmetic"] == pytest.approx(got, abs=1e-12)
    assert nmi.nmi(df, "w", "v").first()["nmi_arithmetic"] == pytest.approx(got, abs=1e-12)
