"""Near-duplicate groups at other likenesses and with shared templates."""

import random
import time

import pytest

import llm_brute as brute
from rowmill.llm.minhash_dedup import Sizes, near_duplicates


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def groups(df):
    return sorted((r.id, r.component_id) for r in df.collect())


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))}


def linked(rows, num, den):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            same = len(sets[a] & sets[b])
            if den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, find(i)) for i in ids)


@pytest.fixture(scope="module")
def rows():
    g = random.Random(12)
    out = []
    for base in range(12):
        words = [f"w{g.randrange(400)}" for _ in range(g.choice([30, 90, 200]))]
        for _ in range(g.choice([1, 4, 9])):
            some = list(words)
            for _ in range(g.randrange(0, len(words) // 8)):
                some[g.randrange(len(some))] = f"x{g.randrange(10 ** 6)}"
            out.append((len(out), " ".join(some[g.randrange(0, 5):len(some) - g.randrange(0, 9)])))
    return out


def test_brute_force_helper_agrees(rows):
    assert [(i, c) for i, _, c in brute.near(rows)] == linked(rows, 75, 100)


@pytest.mark.parametrize("num,den", [(30, 100), (50, 100), (75, 100), (9, 10), (1, 1)])
def test_every_likeness(spark, rows, num, den):
    assert groups(near_duplicates(table(spark, rows), num=num, den=den)) == linked(rows, num, den)


def test_sizes():
    s = Sizes(75, 100)
    assert (s.sketch, s.lists, s.least) == (64, 48, 18)
    assert all(Sizes(n, 100).least >= 1 for n in range(5, 101))
    with pytest.raises(ValueError):
        Sizes(0, 100)


def template_pages(n, share, g):
    """Pages of which a share is one text, the rest their own; no two reach 0.75."""
    body = " ".join(f"t{k}" for k in range(400))
    return [(k, body + " " + " ".join(f"p{k}x{j}" for j in range(int(400 * (1 - share) / share * g.uniform(0.9, 1.1))))) for k in range(n)]


def test_template_makes_no_pairs(spark):
    """80 % of every page is shared: the work per page stays the same."""
    took = {}
    for n in (600, 1200, 4800):
        df = table(spark, template_pages(n, 0.8, random.Random(n)))
        start = time.time()
        assert near_duplicates(df).where("id <> component_id").count() == 0
        took[n] = time.time() - start
    assert took[4800] < 4 * took[1200]
