"""Toxicity in texts without spaces: a whole line is one word."""

import random

import numpy as np
import pyarrow as pa

from rowmill.llm.text import ALNUM, Words, chunks
from rowmill.llm.toxicity import PIECE, fit, logits, words


def cut(texts):
    (_, buf, offs), = chunks(pa.record_batch([pa.array(texts)], names=["text"]), "text", 1 << 62)
    return buf, offs


def test_pieces_cover_every_byte():
    texts = ["short words only", "", "x" * 64, "y" * 65 + " z", "毒" * 100 + " a " + "b" * 500]
    buf, offs = cut(texts)
    w = words(buf, offs)
    read = np.zeros(len(buf) + 1, int)
    np.add.at(read, w.starts, 1)
    np.add.at(read, w.ends, -1)
    plain = Words(buf, offs, ALNUM, True)
    inside = np.zeros(len(buf) + 1, int)
    np.add.at(inside, plain.starts, 1)
    np.add.at(inside, plain.ends, -1)
    assert ((np.cumsum(read) > 0) == (np.cumsum(inside) > 0)).all()
    assert (w.ends - w.starts).max() == PIECE and w.counts[:3].tolist() == [3, 0, 1]
    assert all(offs[d] <= s and e <= offs[d + 1] for s, e, d in zip(w.starts, w.ends, w.doc, strict=True))


def test_late_marks_are_learnt_and_scored():
    g = random.Random(5)
    texts, toxic = [], []
    for k in range(400):
        t = [chr(0x4E00 + g.randrange(40)) for _ in range(g.randrange(40, 160))]
        if k % 3 == 0:
            t.insert(g.randrange(25, len(t)), "毒恶骂")
        texts.append("".join(t))
        toxic.append(int(k % 3 == 0))
    y = np.array(toxic)
    net = fit(texts[:300], y[:300])
    buf, offs = cut(texts[300:])
    assert ((logits(net, words(buf, offs), 100) >= 0) == y[300:]).mean() >= 0.95
