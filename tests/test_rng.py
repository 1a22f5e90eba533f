"""The numpy LCG must reproduce java.util.Random draw for draw."""

import numpy as np

from rowmill.functions.rng import JavaRandom


def test_matches_jvm(spark):
    jvm = spark._jvm
    for seed in (0, 1, 1234, 4321, -7):
        jr, r = jvm.java.util.Random(seed), JavaRandom(seed)
        g = r.next_gaussians(1501)
        assert np.allclose(g, [jr.nextGaussian() for _ in range(1501)], rtol=0, atol=2e-15)
        d = r.next_doubles(257)
        assert np.array_equal(d, [jr.nextDouble() for _ in range(257)])
        for bound in (2, 7, 10, 16, 1000):
            got = r.next_ints(bound, 100)
            assert list(got) == [jr.nextInt(bound) for _ in range(100)]
        # odd number of gaussians leaves one cached, as the JVM does
        assert np.allclose(r.next_gaussians(3), [jr.nextGaussian() for _ in range(3)], atol=2e-15)


def test_block_boundaries():
    a = JavaRandom(99).next_doubles(5000)
    r = JavaRandom(99)
    b = np.concatenate([r.next_doubles(1), r.next_doubles(1023), r.next_doubles(3976)])
    assert np.array_equal(a, b)


def test_rejection_path_matches_jvm(spark):
    # a bound just above 2^30 rejects about half of all draws
    jvm = spark._jvm
    bound = (1 << 30) + 12345
    jr, r = jvm.java.util.Random(5), JavaRandom(5)
    got = r.next_ints(bound, 300)
    assert list(got) == [jr.nextInt(bound) for _ in range(300)]
    assert r.next_doubles(3).tolist() == [jr.nextDouble() for _ in range(3)]


def test_feature_map_draws_follow_the_jvm_order(spark):
    from rowmill.operators import features

    jvm = spark._jvm
    d, s, sigma = 7, 5, 2.5
    r1, r2 = jvm.java.util.Random(1234), jvm.java.util.Random(4321)
    z = np.zeros((s, d))
    for j in range(d):              # input index outer, output index inner
        for i in range(s):
            z[i, j] = r1.nextGaussian() / sigma
    v = np.array([r2.nextDouble() * 6.283185307179586 for _ in range(s)])
    gz, gv = features.rff_params(d, s, sigma)
    assert np.allclose(gz, z, atol=1e-15) and np.array_equal(gv, v)

    r = jvm.java.util.Random(1234)
    h = [r.nextInt(6) for _ in range(d)]            # all buckets first ...
    sg = [r.nextInt(2) * 2 - 1 for _ in range(d)]   # ... then all signs
    gh, gs = features.sketch_params(d, 6)
    assert list(gh) == h and list(gs) == sg
