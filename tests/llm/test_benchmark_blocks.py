"""A benchmark of several blocks is held one block at a time."""

import os

import llm_brute as brute
import rowmill.llm.decontaminate as D


def test_blocks_are_released(spark, monkeypatch):
    sent, plain = [], spark.sparkContext.broadcast
    monkeypatch.setattr(D, "BLOCK_BYTES", 150)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: sent.append(plain(v)) or sent[-1])
    items = [(k, " ".join(f"w{j}" for j in range(9 * k, 9 * k + 16))) for k in range(4)]
    rows = [(1, " ".join(f"w{j}" for j in range(60))), (1, items[2][1]), (2, None), (None, "x " + items[0][1]), (3, "clean")]
    out = D.contamination(spark.createDataFrame(rows, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    got = [(r.row.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in out]
    assert sorted(got, key=repr) == sorted(brute.contamination(rows, items), key=repr)
    assert len(sent) > 1 and [os.path.exists(b._path) for b in sent] == [False] * (len(sent) - 1) + [True]
