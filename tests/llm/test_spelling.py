"""Spelling variants against plain Python; tiles against all pairs of words."""

import random
import re
import zlib

import numpy as np
import pytest

from rowmill.llm import spelling as S

SCHEMA = "doc_id long, text string, id string, word int, n string"
LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def counts(rows, min_chars=7, min_count=2):
    n = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}


def brute(rows):
    n = counts(rows)
    form, out = {}, []
    for w in n:
        some = [x for x in n if near(w, x)]
        top = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = len(some), top if some and n[top] >= 10 * n[w] else None
    for w, (k, f) in form.items():
        root = w
        while form[root][1]:
            root = form[root][1]
        out.append((w, f, root, n[w], k, n[f] if f else None))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(4)


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    g = random.Random(7)
    base = ["separate", "Straße", "naïveté", "commission", "Äußerung", "aaaaaaaa", "abababab", "receive", "received", "ÆØÅæøåÿ", "ça×÷été"]
    def slip(w):
        k = g.randrange(len(w))
        return w[:k] + g.choice(["", "x", "é", w[k] * 2, "÷"]) + w[k + g.randrange(2):]
    out = []
    for k in range(300):
        w = [g.choice(base) if g.random() < 0.9 else slip(g.choice(base)) for _ in range(g.randrange(40))]
        out.append((k, g.choice([" ", ", ", "1", "Ā", "\n", "日"]).join(x.upper() if g.random() < 0.1 else x for x in w)))
    out += [(None, "separate separate"), (None, None), (5, ""), (5, "commission " * 50), (6, "z" * 30000 + " " + "z" * 30000),
            (7, "z" * 30001 + " " + "z" * 30001), (8, " ".join(["commision"] * 90000)), (9, "ab"), (9, "ab")]
    out += [(k, "xylophone " * 400 + "xylophane " * 30 + "xylaphane " * 2) for k in (11, 12)]
    return out


def test_against_plain_python(spark, rows):
    got = result(S.spelling_variants(table(spark, rows)))
    assert got == brute(rows)
    assert any(r[1] and r[2] != r[1] for r in got)                # a chain of forms


def test_hot_keys_are_cut(spark, monkeypatch):
    """Very many words of one beginning and one end, tiles of few words."""
    g = random.Random(2)
    words = sorted({"prefix" + "".join(g.choice("abc") for _ in range(g.choice([5, 6]))) + "suffix" for _ in range(900)})
    monkeypatch.setattr(S, "TILE", 16)
    df = spark.createDataFrame([(w, k + 2) for k, w in enumerate(words)], "word string, n long").repartition(3)
    got = [(r.word, r.near, r.near_n) for r in S.near_words(df).collect()]
    want = {(a, b, k + 2) for a in words for k, b in enumerate(words) if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_no_words(spark):
    assert result(S.spelling_variants(table(spark, []))) == []
    assert result(S.spelling_variants(table(spark, [(1, None), (2, "short words 123")]))) == []


def test_tile_finds_every_single_edit():
    g = random.Random(1)
    words = list({"".join(g.choice("abé") for _ in range(g.choice([4, 5]))) for _ in range(150)})
    for last in (4, 5, 6):
        one = np.zeros(len(words), np.int64)
        i, j = S.near_pairs(words, one, one, one + last, one + last)
        got = {(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(a, b) for p, a in enumerate(words) for b in words[p + 1:] if near(a, b) and max(len(a), len(b)) == last}
        assert got == want
