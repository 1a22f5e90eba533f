"""Source divergence against exact integers over every cell, and the quadtree against a dense matrix."""

import random
import re

import numpy as np
import pytest

from rowmill.llm import divergence as D
from rowmill.llm.quadtree import QuadTree, joint

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=10, top=10):
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, x, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = {}
        for _, _, w in own:
            for t in set(w):
                seen[t] = seen.get(t, 0) + 1
        kept = [t for t, n in seen.items() if n >= min_docs]
        v, groups = len(kept), sorted({d[1] for d in own})
        count = {s: dict.fromkeys(kept, 0) for s in [*groups, None]}
        for _, s, w in own:
            for t in w:
                if t in count[s]:
                    count[s][t] += 1
                    count[None][t] += 1
        p = {s: {t: 1 + 10 ** 9 * (c + 2) // (sum(x.values()) + 2 * v) for t, c in x.items()} for s, x in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            part = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            part.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, x, r + 1) for r, (x, o) in enumerate(part)]
            part = [(f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            part.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, x, r + 1) for r, (x, t) in enumerate(part[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k, t, x, s, "z", 1) for k, (t, x, s) in enumerate(rows)], SCHEMA).repartition(3)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    g = random.Random(4)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Été", "été", "日本", "ß", "aé-b"]
    out = []
    for k in range(400):
        lang, source = g.choice(["en", "de", None]), g.choice(["a", "b", "c", None, "big", "big", "big", "big"])
        out.append((" ".join(g.choice(vocab[:20 + 40 * (len(source or "") + 1)]).upper() for _ in range(g.randrange(60))), lang, source))
    out += [(None, "en", "none"), ("", "en", "void"), ("rare words only", "xx", "p"), ("1 2 3", "xx", "q"), (None, None, None)]
    out += [("same same same", "en", "copy")] * 30 + [("long " * 300000 + "end", "en", "long")]
    return out


def test_against_plain_integers(spark, rows):
    assert result(D.source_divergence(table(spark, rows))) == brute(rows)


def test_many_units_and_blocks(spark, rows):
    assert result(D.source_divergence(table(spark, rows), block_rows=2, unit_cells=50)) == brute(rows)


def test_empty_and_single(spark, rows):
    assert result(D.source_divergence(table(spark, []))) == []
    assert result(D.source_divergence(table(spark, rows[:1]))) == []
    assert result(D.source_divergence(table(spark, rows[:40]), min_docs=1)) == brute(rows[:40], 1)


def test_shares_are_exact():
    g = random.Random(1)
    for most in (10, 10 ** 9, 10 ** 15, 10 ** 18):
        size = [g.randrange(1, most) for _ in range(200)]
        count = [g.randrange(0, s + 1) for s in size]
        got = D.shares(np.array(count), np.array(size), np.full(200, 7))
        assert got.tolist() == [1 + 10 ** 9 * (c + 2) // (s + 14) for c, s in zip(count, size, strict=True)]


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("m,n,width,fill", [(5, 5, 40, 0.1), (8, 8, 3, 0.9), (1, 1, 1, 1.0), (6, 6, 17, 0.0), (7, 7, 64, 0.02)])
def test_descent_covers_every_cell_once(same, m, n, width, fill):
    g = np.random.default_rng(3)
    a = (g.random((m, width)) < fill) * g.integers(1, 9, (m, width))
    b = a if same else (g.random((n, width)) < fill / 2) * g.integers(1, 9, (n, width))
    depth = max(1, int(max(m, n, width, 2) - 1).bit_length())
    trees = [QuadTree(*np.nonzero(x), x[np.nonzero(x)], depth) for x in (a, b)]
    zero, (r, s, c, x, y) = joint(*trees, (m, n), width, same)
    assert (x == a[r, c]).all() and (y == b[s, c]).all() and ((x > 0) | (y > 0)).all()
    assert len(set(zip(r.tolist(), s.tolist(), c.tolist(), strict=True))) == len(r)
    want = np.array([[((a[i] == 0) & (b[j] == 0)).sum() for j in range(n)] for i in range(m)])
    held = np.triu(np.ones((m, n), bool), 1) if same else np.ones((m, n), bool)
    got = zero.copy()
    assert (got[held] == want[held]).all()
    assert len(r) == (width - want)[held].sum()
