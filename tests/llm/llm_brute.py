"""Plain Python versions of the operators, for comparison on small tables."""

import hashlib
import re
import zlib


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, min_chars=40, min_docs=5):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(
        {c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(-1 if i is None else i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i if i is not None else -1) == (i if i is not None else -1)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def repeats(rows, window=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in words:
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            low[k] = min(low.get(k, 1 << 62), -1 if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1):
            if low[tuple(w[a:a + window])] < (-1 if i is None else i):
                gone.update(range(a, a + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), sha(b" ".join(kept).decode())))
    return out


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[a:a + n]) for a in range(max(1, len(w) - n + 1))} if w else set()


def near(rows):
    """(id, set size, smallest reachable id); ids distinct."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return [(i, len(sets[i]), find(i)) for i in ids]


def contamination(rows, items):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").encode().lower())
    phrases = {}
    for item, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            phrases.setdefault(tuple(w[a:a + 13]), set()).add(str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                got = phrases.get(tuple(w[a:a + n]))
                if got:
                    hit.update(range(a, a + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
