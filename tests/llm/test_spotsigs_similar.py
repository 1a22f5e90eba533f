"""SpotSigs written again in plain Python: signatures by word lists, all pairs by sets."""

import random
import re

import pytest

from rowmill.llm import spotsigs as S
from rowmill.llm.common import NULL_ID

ANCHORS = set(S.ANCHORS)


def signatures(text):
    """The chain of two content words after each anchor, as words; else pairs of words, one word, or the text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    out = set()
    for k, w in enumerate(words):
        if w in ANCHORS:
            after = [x for x in words[k + 1:] if x not in ANCHORS][:S.CHAIN]
            if len(after) == S.CHAIN:
                out.add((w, *after))
    if not out:
        out = set(zip(words, words[1:])) if len(words) > 1 else set(words)
    return out or ({text} if text else set())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def rows():
    g = random.Random(6)
    vocab = sorted(ANCHORS)[:30] + [f"inhalt{k}" for k in range(150)]
    out = [(None, None), (1, ""), (2, ""), (3, "..."), (4, "one"), (5, "two words"), (6, "two words"), (7, "the"), (8, "of a the")]
    for _ in range(25):
        words = [g.choice(vocab) for _ in range(g.choice([12, 60, 150]))]
        for _ in range(g.choice([1, 3, 8])):
            some = list(words)
            for _ in range(g.randrange(0, max(len(words) // 12, 1))):
                some[g.randrange(len(some))] = g.choice(vocab)
            out.append((10 + len(out), " ".join(some)))
    boiler = " ".join(g.choice(vocab) for _ in range(200))
    out += [(500 + k, f"{boiler} {' '.join(f'der eigen{k}x{j} wort{k}' for j in range(40))}") for k in range(40)]
    return out


def test_signature_sets_against_word_lists(rows):
    mine = S.signature_sets([(t or "").encode() for _, t in rows])
    plain = [signatures(t) for _, t in rows]
    assert [len(a) for a in mine] == [len(b) for b in plain]
    for k in range(0, len(rows), 3):
        for j in range(0, len(rows), 5):
            assert len(set(mine[k].tolist()) & set(mine[j].tolist())) == len(plain[k] & plain[j])


@pytest.mark.parametrize("num,den", [(75, 100), (4, 10), (9, 10), (1, 1)])
def test_pairs_and_members(spark, rows, num, den):
    members, pairs = S.similar(table(spark, rows), num, den)
    sets = {NULL_ID if i is None else i: frozenset(signatures(t)) for i, t in rows}
    rep = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    assert {r.id: r.class_id for r in members.collect()} == rep
    want = {}
    for a in sorted(set(rep.values())):
        for b in sorted(set(rep.values())):
            same, total = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and total and den * same >= num * total:
                want[a, b] = same / total
    got = {(r.a, r.b): r.likeness for r in pairs.collect()}
    assert got == want and (num == den or want)


def test_empty(spark):
    members, pairs = S.similar(table(spark, []))
    assert members.count() == pairs.count() == 0
    with pytest.raises(ValueError):
        S.similar(table(spark, []), 0, 10)
