"""Toxicity scores from a bidirectional gated recurrent network.

A word's input joins a word vector and the scaled sum of its character n-gram
vectors (both hashed, so no vocabulary is kept). A word of more than ``PIECE``
bytes, as whole sentences are in scripts without spaces, is read as overlapping
pieces that each count as a word, so every byte of a text is read. Two gated recurrent passes
read a window of ``WINDOW`` words, attention pools their states, and a logistic
unit scores the window. Windows overlap by half and cover the whole text; a
document's score is that of its highest window.

The network is trained in numpy on the driver from a bounded sample of labelled
rows: ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents in hash order of the id and
at most ``SAMPLE_WINDOWS`` windows of each; these bounds hold at every input size.
Each epoch trains on the window that now scores highest in each document and on
one drawn at random from clean ones. Scoring is one pass of Spark tasks over all
rows with the model (about 3 MB) broadcast, and nothing is shuffled.

Defined results: null and empty texts are one window without words; rows whose
label is null are not learnt from; several labels of one id count as the
largest; without a toxic or a clean label every score is the share of toxic
labels (0 without labels); repeated rows score alike; empty table, empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import packed, ship_package, with_row
from rowmill.llm.text import ALNUM, Words, chunks, mix

WINDOW, STRIDE = 48, 24
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 16
WORD_DIM, GRAM_DIM, HIDDEN = 6, 8, 8
GRAMS = (3, 5)              # bytes of character n-grams, word ends marked
SAMPLE_TOXIC, SAMPLE_CLEAN = 700, 1100
EPOCHS, BATCH, RATE = 6, 24, 0.02
PIECE, PIECE_STRIDE = 64, 48    # bytes of the pieces of longer words
CHUNK = 1 << 19


def words(buf: np.ndarray, offs: np.ndarray) -> Words:
    """Words of some texts, longer ones cut into overlapping pieces."""
    w = Words(buf, offs, ALNUM, True)
    n = 1 + np.maximum(-(-(w.ends - w.starts - PIECE) // PIECE_STRIDE), 0)
    if n.max(initial=1) > 1:
        word = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        w.starts = w.starts[word] + PIECE_STRIDE * nth
        w.ends = np.minimum(w.starts + PIECE, w.ends[word])
        w.doc = w.doc[word]
        w.first = np.searchsorted(w.starts, offs)
        w.counts = np.diff(w.first)
    return w


class Features:
    """Distinct words of some texts: word bucket and n-gram buckets of each."""

    def __init__(self, w: Words):
        h = w.hashes()
        _, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        s, e = w.starts[first], w.ends[first]
        self.bucket = (h[first] % np.uint64(WORD_BUCKETS)).astype(np.int64)
        size = e - s + 2                                     # ^word$
        at = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
        where = np.repeat(s, size) + inside - 1
        raw = w.buf[np.clip(where, 0, max(len(w.buf) - 1, 0))].astype(np.uint64) if len(w.buf) else where.astype(np.uint64)
        raw[inside == 0] = 1
        raw[at[1:] - 1] = 2
        grams, owner = [], []
        unit = np.repeat(np.arange(len(size)), size)
        for n in GRAMS:
            k = len(raw) - n + 1
            if k <= 0:
                continue
            ok = np.flatnonzero(unit[:k] == unit[n - 1:])
            code = np.full(len(ok), n, np.uint64)
            for j in range(n):
                code = code * np.uint64(257) + raw[ok + j]
            grams.append((mix(code) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
            owner.append(unit[ok])
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(self.owner, kind="stable")
        self.grams, self.owner = self.grams[order], self.owner[order]
        self.scale = 1 / np.sqrt(np.maximum(np.bincount(self.owner, minlength=len(first)), 1)).astype(np.float32)

    def __len__(self) -> int:
        return len(self.bucket)


def window_starts(n: int) -> list[int]:
    """First words of the windows of a text of ``n`` words: every word is in one, most in two."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, with forward passes for windows and training steps."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        f = lambda *s, k: (g.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32),
                  "gram": np.zeros((GRAM_BUCKETS, GRAM_DIM), np.float32), "att": f(2 * h, k=0.1),
                  "out": f(2 * h, k=0.5), "bias": np.full(1, -1.0, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": f(d, 3 * h, k=d ** -0.5), f"u{side}": f(h, 3 * h, k=h ** -0.5),
                       f"c{side}": np.zeros(3 * h, np.float32)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def inputs(self, f: Features) -> np.ndarray:
        """Input vector of each distinct word; one zero row more, for padding."""
        out = np.zeros((len(f) + 1, WORD_DIM + GRAM_DIM), np.float32)
        if len(f):
            out[:-1, :WORD_DIM] = self.p["word"][f.bucket]
            begin = np.searchsorted(f.owner, np.arange(len(f)))
            total = np.add.reduceat(np.vstack([self.p["gram"][f.grams], np.zeros((1, GRAM_DIM), np.float32)]), begin)
            has = np.diff(np.append(begin, len(f.owner))) > 0
            out[:-1, WORD_DIM:] = np.where(has[:, None], total * f.scale[:, None], 0)
        return out

    def _pass(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray | None, side: str, keep: bool):
        """States of one direction, [step, window, HIDDEN], and what training needs."""
        h2 = 2 * HIDDEN
        proj = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        u = self.p[f"u{side}"]
        n, steps = idx.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        tape = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a, r = proj[idx[:, t]], h @ u
            zr = sigmoid(a[:, :h2] + r[:, :h2])
            z, g = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(a[:, h2:] + g * r[:, h2:])
            new = c + z * (h - c)
            if mask is not None:
                m = mask[:, t, None]
                new = h + m * (new - h)
            if keep:
                tape.append((t, h, z, g, c, r[:, h2:]))
            h = states[t] = new
        return states, tape

    def score(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logit of each window."""
        sf, tf = self._pass(x, idx, mask, "f", keep)
        sb, tb = self._pass(x, idx, mask, "b", keep)
        va, vo = self.p["att"], self.p["out"]
        e = sf @ va[:HIDDEN] + sb @ va[HIDDEN:]                     # [step, window]
        if mask is not None:
            e = np.where(mask.T > 0, e, -30.0)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        value = sf @ vo[:HIDDEN] + sb @ vo[HIDDEN:]
        logit = (a * value).sum(axis=0) + self.p["bias"][0]
        return (logit, (sf, sb, tf, tb, a, value)) if keep else logit

    def train(self, f: Features, idx: np.ndarray, mask: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One Adam step of the logistic loss on some windows."""
        used, small = np.unique(idx, return_inverse=True)           # only the words of this batch
        small = small.reshape(idx.shape)
        x_all = self._some(f, used)
        logit, (sf, sb, tf, tb, a, value) = self.score(x_all, small, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        dl = (sigmoid(logit) - y) / len(y)
        g["bias"][0] = dl.sum()
        pooled = (a * value).sum(axis=0)
        dvalue, de = a * dl, a * (value - pooled) * dl
        dx = np.zeros_like(x_all)
        for side, states, tape, cut in (("f", sf, tf, slice(0, HIDDEN)), ("b", sb, tb, slice(HIDDEN, None))):
            g["out"][cut] = np.einsum("tn,tnh->h", dvalue, states)
            g["att"][cut] = np.einsum("tn,tnh->h", de, states)
            ds = dvalue[:, :, None] * self.p["out"][cut] + de[:, :, None] * self.p["att"][cut]
            u, w = self.p[f"u{side}"], self.p[f"x{side}"]
            dh = np.zeros_like(states[0])
            dproj = np.zeros((len(x_all), 3 * HIDDEN), np.float32)
            for t, h, z, r, c, hu in reversed(tape):
                dh = dh + ds[t]
                m = mask[:, t, None]
                dnew = dh * m
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * hu * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"u{side}"] += h.T @ du
                np.add.at(dproj, small[:, t], da)
                dh = dh * (1 - m) + dnew * z + du @ u.T
            g[f"c{side}"] = dproj.sum(axis=0)
            g[f"x{side}"] = x_all.T @ dproj
            dx += dproj @ w.T
        self.t += 1
        for k, v in g.items():
            self._adam(k, slice(None), v, rate)
        self._embed(f, used, dx, rate)

    def _some(self, f: Features, words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), WORD_DIM + GRAM_DIM), np.float32)
        real = np.flatnonzero(words < len(f))
        out[real, :WORD_DIM] = self.p["word"][f.bucket[words[real]]]
        rows, grams = self._grams(f, words[real])
        np.add.at(out[:, WORD_DIM:], real[rows], self.p["gram"][grams] * f.scale[words[real][rows], None])
        return out

    @staticmethod
    def _grams(f: Features, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(f.owner, words), np.searchsorted(f.owner, words, "right")
        n = b - a
        rows = np.repeat(np.arange(len(words)), n)
        return rows, f.grams[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]

    def _embed(self, f: Features, words: np.ndarray, dx: np.ndarray, rate: float) -> None:
        real = np.flatnonzero(words < len(f))
        rows, grams = self._grams(f, words[real])
        for name, key, d in (("word", f.bucket[words[real]], dx[real, :WORD_DIM]),
                             ("gram", grams, dx[real[rows], WORD_DIM:] * f.scale[words[real][rows], None])):
            at, inv = np.unique(key, return_inverse=True)
            total = np.zeros((len(at), d.shape[1]), np.float32)
            np.add.at(total, inv, d)
            self._adam(name, at, total, rate)

    def _adam(self, k: str, at, grad: np.ndarray, rate: float) -> None:
        m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * grad
        v = self.v[k][at] = 0.99 * self.v[k][at] + 0.01 * grad * grad
        fix = (1 - 0.99 ** self.t) ** 0.5 / (1 - 0.9 ** self.t)
        self.p[k][at] -= rate * fix * m / (np.sqrt(v) + 1e-6)


def frames(w: Words, f: Features, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index and mask of every window, and the text it belongs to."""
    doc, first = [], []
    for d, (a, n) in enumerate(zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True)):
        s = window_starts(n)
        doc += [d] * len(s)
        first += [a + x for x in s]
    doc, first = np.array(doc, np.int64), np.array(first, np.int64)
    place = first[:, None] + np.arange(WINDOW)
    mask = place < w.first[doc + 1][:, None]
    word = np.append(f.word, len(f))
    return np.where(mask, word[np.minimum(place, len(word) - 1)], len(f)), mask.astype(np.float32), doc


def logits(net: Network, w: Words, texts: int, rows: int = 1 << 12) -> np.ndarray:
    """The highest window's logit of each text."""
    f = Features(w)
    idx, mask, doc = frames(w, f, texts)
    x = net.inputs(f)
    out = np.empty(len(idx), np.float32)
    whole = mask[:, -1] > 0
    for some, m in ((np.flatnonzero(whole), None), (np.flatnonzero(~whole), mask)):
        for a in range(0, len(some), rows):
            k = some[a:a + rows]
            out[k] = net.score(x, idx[k], None if m is None else m[k])
    best = np.full(texts, -np.inf, np.float32)
    np.maximum.at(best, doc, out)
    return best


def fit(texts: list[str | None], toxic: np.ndarray, seed: int = 11) -> Network:
    """Trains a network on documents and their labels (0 or 1)."""
    g = np.random.default_rng(seed)
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    (_, buf, offs), = chunks(batch, "text", 1 << 62)
    w = words(buf, offs)
    f = Features(w)
    idx, mask, doc = frames(w, f, len(texts))
    net = Network()
    for epoch in range(EPOCHS):
        now = g.random(len(doc)).astype(np.float32)
        if epoch:
            x = net.inputs(f)
            now = np.concatenate([net.score(x, idx[a:a + 8192], mask[a:a + 8192]) for a in range(0, len(doc), 8192)])
        order = np.lexsort((now, doc))
        top = order[np.append(doc[order][1:] != doc[order][:-1], True)]
        other = np.lexsort((g.random(len(doc)), doc))
        other = other[np.append(doc[other][1:] != doc[other][:-1], True)]
        chosen = np.concatenate([top, other[toxic[doc[other]] == 0]])
        chosen = chosen[g.permutation(len(chosen))]
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(chosen), BATCH):
            k = chosen[a:a + BATCH]
            net.train(f, idx[k], mask[k], toxic[doc[k]].astype(np.float32), rate)
    return net


def _score(batches, sent):
    net, constant = sent.value
    for batch in batches:
        for piece, buf, offs in chunks(batch, "text", CHUNK):
            n = len(offs) - 1
            if net is None:
                score = np.full(n, constant)
            else:
                score = 1 / (1 + np.exp(-logits(net, words(buf, offs), n).astype(float)))
            yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("text"), pa.array(score)],
                                             names=["row", "text", "score"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple]:
    """(text, label) of the bounded training sample; held-out ids are never in it."""
    marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("y")))
    picked = None
    for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        some = marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
        picked = some if picked is None else picked.union(some)
    ids = picked.collect()                                           # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    got = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()     # of a repeated id the first text in order
    return [(r["text"], r["y"]) for r in sorted(got, key=lambda r: r["id"])]


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(row, text, score)`` for every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    known = sample(docs, labels, id_col, text_col, label_col)
    y = np.array([k[1] for k in known], np.int64)
    if len(np.unique(y)) == 2:
        model = (fit([k[0] for k in known], y), 0.0)
    else:
        model = (None, float(y.mean()) if len(y) else 0.0)
    if model[0] is not None:
        model[0].m = model[0].v = None
    sent = spark.sparkContext.broadcast(model)
    d = packed(docs, id_col, text_col).select("row", "text")
    return d.mapInArrow(lambda it: _score(it, sent),
                        with_row(d, "text string, score double"))
