"""Repeated word passages, found at difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document. ``COVER`` is a
perfect difference set modulo ``PERIOD``: for any two word positions i, j
there is a k < PERIOD with (i + k) and (j + k) both in the cover. So two equal
windows always share an aligned anchor of ``WINDOW - PERIOD + 1`` words that
starts at a cover position in both, and only 3 of 7 positions are hashed.

1. Documents are dealt by id into blocks of about ``BLOCK_BYTES`` of text, kept
   as a table bucketed by block: later steps join by block and never move the
   text again. Whole-text copies are resolved there (all of a longer text's
   windows start in the smallest id that holds it); only one of them goes on.
2. Each block sends its distinct anchor hashes, dealt by hash. Anchors of two
   documents come back to the blocks that hold them.
3. Around a shared anchor, blocks extend to every window that contains it and
   send the 128-bit hash of the whole window with the smallest id per block;
   the smallest id over all blocks comes back where a larger id holds it.
4. A block removes the words under windows of a smaller id.

One block sends a hash once, so a passage held by a third of all rows costs
one record per block, and no pairs of documents are made.

Defined results: null text has no words; a null id is a document below all
others; rows that repeat an id never remove each other's words; texts under
one window keep everything; empty table, empty result; other columns are
carried untouched whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rowmill.llm.common import packed, parts, ship_package, with_row
from rowmill.llm.text import MULT_A, MULT_B, NON_WHITE, Words, chunks, mix, windows
from rowmill.session import scratch_path

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20     # of texts whose hashes meet in one bucket, about: a bucket is held by one task
IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes and the words they start at, in texts that have a window."""
    a = windows(h, ANCHOR, MULT_A)
    at = np.arange(len(a))
    ok = (w.doc[:len(a)] == w.doc[ANCHOR - 1:]) & IN_COVER[(at - w.first[w.doc[:len(a)]]) % PERIOD]
    ok &= w.counts[w.doc[:len(a)]] >= WINDOW
    at = at[ok]
    return a[at], at


def _deal(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds that cut sorted hashes into ``buckets`` equal hash ranges."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(h, np.array(edges, np.uint64)), [len(h)]])


def _settle(docs: pa.Table, firsts: pa.Table) -> pa.Table:
    """Marks the document that stands for each text; the copies are finished here."""
    stands = set(firsts.column("first").to_pylist())
    text, done, n = [], [], []
    for i, t in zip(docs.column("id").to_pylist(), docs.column("text").to_pylist(), strict=True):
        words = None if i in stands else _split(t)
        text.append(t if words is None else None)
        done.append(None if words is None else b"" if len(words) >= WINDOW else b" ".join(words))
        n.append(None if words is None else len(words))
    return pa.table({"block": docs.column("block"), "id": docs.column("id"), "row": docs.column("row"),
                     "text": pa.array(text, pa.string()), "done": pa.array([d if d is None else d.decode() for d in done], pa.string()),
                     "n_words": pa.array(n, pa.int64())})


def _split(text: str | None) -> list[bytes]:
    """Words between ASCII white space (bytes split at 0x20 and 0x09-0x0D)."""
    return (text or "").encode().split()


def _send_anchors(table: pa.Table, buckets: int) -> pa.Table:
    found, multi, base = [], [], 0
    for _, buf, offs in _chunks(table):
        w = Words(buf, offs, NON_WHITE, False)
        a, at = _anchors(w, w.hashes())
        found.append(a)
        multi.append(w.doc[at] + base)
        base += len(offs) - 1
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    doc = np.concatenate(multi) if multi else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first) if len(h) else np.zeros(0, bool)
    h = h[first]
    cut = _deal(h, buckets)
    some = np.flatnonzero(np.diff(cut))
    block = table.column("block")[0].as_py()
    return pa.table({"bucket": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.int32()),
                     "hashes": pa.array([h[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()),
                     "several": pa.array([several[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary())})


def _chunks(table: pa.Table):
    for batch in table.select(["id", "text"]).combine_chunks().to_batches():
        yield from chunks(batch, "text")


def _gather(batches, columns: dict[str, np.dtype]):
    """All records of a partition: block of each, and its arrays."""
    got: dict[str, list] = {c: [] for c in columns}
    block, size = [], []
    for batch in batches:
        block += batch.column("block").to_pylist()
        for c, kind in columns.items():
            got[c] += [np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]
    one = next(iter(columns))
    size = [len(x) for x in got[one]]
    out = {c: np.concatenate(v) if v else np.zeros(0, columns[c]) for c, v in got.items()}
    return np.repeat(np.array(block, np.int32), size), out


def _shared(batches):
    """Per block, the anchors that two documents hold."""
    block, got = _gather(batches, {"hashes": np.uint64, "several": np.bool_})
    if not len(block):
        return
    order = np.argsort(got["hashes"], kind="stable")
    h, block, several = got["hashes"][order], block[order], got["several"][order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    group = np.cumsum(first) - 1
    keep = (np.bincount(group) > 1) | (np.bincount(group, several) > 0)
    yield from _by_block(block[keep[group]], {"hashes": h[keep[group]]})


def _by_block(block: np.ndarray, values: dict[str, np.ndarray]):
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(block[a])], pa.int32())]
            + [pa.array([v[order[a:b]].tobytes()], pa.binary()) for v in values.values()],
            names=["block", *values])


def _candidates(w: Words, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and two 64-bit hashes of the windows that contain a shared anchor."""
    h = w.hashes()
    a, at = _anchors(w, h)
    at = at[_member(a, shared)]
    near = np.zeros(len(w) + 1, np.int64)             # +1 at the first window, -1 past the last
    np.add.at(near, np.maximum(at - (PERIOD - 1), w.first[w.doc[at]]), 1)
    np.add.at(near, at + 1, -1)
    start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    start = start[start + WINDOW <= w.first[w.doc[start] + 1]]
    if not len(start):
        return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return start, windows(h, WINDOW, MULT_A)[start], windows(mix(h), WINDOW, MULT_B)[start]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _all(table: pa.Table, column: str, kind) -> np.ndarray:
    got = [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]
    return np.concatenate(got) if got else np.zeros(0, kind)


def _send_windows(docs: pa.Table, reply: pa.Table, buckets: int) -> pa.Table:
    shared = np.sort(_all(reply, "hashes", np.uint64))
    a, b, ids = [], [], []
    for piece, buf, offs in _chunks(docs) if len(shared) else ():
        w = Words(buf, offs, NON_WHITE, False)
        start, x, y = _candidates(w, shared)
        a.append(x)
        b.append(y)
        ids.append(piece.column("id").to_numpy()[w.doc[start]])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (a, b))
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = np.lexsort((ids, b, a))
    a, b, ids = a[order], b[order], ids[order]
    first = _firsts(a, b)
    last = np.concatenate([first[1:], [len(a)]]) - 1 if len(first) else first
    a, b, low, high = a[first], b[first], ids[first], ids[last]
    cut = _deal(a, buckets)
    some = np.flatnonzero(np.diff(cut))
    block = docs.column("block")[0].as_py() if docs.num_rows else 0
    piece = lambda v: pa.array([v[cut[k]:cut[k + 1]].tobytes() for k in some], pa.binary())
    return pa.table({"bucket": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.int32()),
                     "a": piece(a), "b": piece(b), "low": piece(low), "high": piece(high)})


def _firsts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def _smallest(batches):
    """Per block, windows that a smaller id holds elsewhere or in the block: its smallest id."""
    block, got = _gather(batches, {"a": np.uint64, "b": np.uint64, "low": np.int64, "high": np.int64})
    if not len(block):
        return
    order = np.lexsort((got["low"], got["b"], got["a"]))
    block = block[order]
    a, b, low, high = (got[c][order] for c in ("a", "b", "low", "high"))
    first = _firsts(a, b)
    least = np.repeat(low[first], np.diff(np.concatenate([first, [len(a)]])))
    told = high > least
    yield from _by_block(block[told], {"a": a[told], "b": b[told], "low": least[told]})


def _remove(docs: pa.Table, reply: pa.Table) -> pa.Table:
    a, b, low = (_all(reply, c, k) for c, k in (("a", np.uint64), ("b", np.uint64), ("low", np.int64)))
    order = np.argsort(a, kind="stable")
    a, b, low = a[order], b[order], low[order]
    kept, total = [], []
    for piece, buf, offs in _chunks(docs):
        ids = piece.column("id").to_numpy()
        w = Words(buf, offs, NON_WHITE, False)
        gone = np.zeros(len(w) + 1, np.int64)
        if len(a) and len(w) >= WINDOW:
            start = np.flatnonzero(w.doc[:len(w) - WINDOW + 1] == w.doc[WINDOW - 1:])
            h = w.hashes()
            x, y = windows(h, WINDOW, MULT_A)[start], windows(mix(h), WINDOW, MULT_B)[start]
            at = np.searchsorted(a, x)
            live = np.flatnonzero(at < len(a))
            hit = np.zeros(len(start), bool)
            while len(live):                              # equal first halves stand side by side
                live = live[a[at[live]] == x[live]]
                same = b[at[live]] == y[live]
                hit[live[same]] = low[at[live[same]]] < ids[w.doc[start[live[same]]]]
                at[live] += 1
                live = live[~same]
                live = live[at[live] < len(a)]
            np.add.at(gone, start[hit], 1)
            np.add.at(gone, start[hit] + WINDOW, -1)
        stay = np.cumsum(gone[:-1]) == 0
        raw = w.buf.tobytes()
        s, e = w.starts[stay].tolist(), w.ends[stay].tolist()
        cut = np.concatenate([[0], np.cumsum(np.bincount(w.doc[stay], minlength=len(offs) - 1))]).tolist()
        total += w.counts.tolist()
        kept += [b" ".join([raw[s[j]:e[j]] for j in range(cut[d], cut[d + 1])]).decode() for d in range(len(offs) - 1)]
    done = docs.column("done").to_pylist()
    known = docs.column("n_words").to_pylist()
    n = [t if d is None else k for t, d, k in zip(total, done, known, strict=True)]
    out = [x if d is None else d for x, d in zip(kept, done, strict=True)]
    left = [x.count(" ") + 1 if x else 0 for x in out]
    return pa.table({"row": docs.column("row"), "n_words": pa.array(n, pa.int64()),
                     "n_removed": pa.array([p - q for p, q in zip(n, left, strict=True)], pa.int64()),
                     "kept_text": pa.array(out, pa.string())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, n_words, n_removed, kept_text)``; ``row`` is the whole input row."""
    spark = docs.sparkSession
    ship_package(spark)
    d = packed(docs, id_col, text_col)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts(spark)
    blocks = max(n, -(-size // BLOCK_BYTES))
    buckets = max(n, -(-size // BUCKET_BYTES))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    d = d.withColumn("block", block)
    firsts = (d.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.min("id").alias("first"))
              .select("first").distinct().withColumn("block", F.pmod(F.xxhash64("first"), F.lit(blocks)).cast("int")))
    given = d.schema["row"].dataType
    plain = StructType([StructField(f"f{k}", f.dataType) for k, f in enumerate(given.fields)])     # a table's names may not clash
    d = d.withColumn("row", F.col("row").cast(plain))
    settled = d.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(
        _settle, StructType.fromDDL("block int, id long").add(d.schema["row"]).add("text", "string").add("done", "string").add("n_words", "long"))
    name = f"rowmill_blocks_{uuid.uuid4().hex[:12]}"
    (settled.write.bucketBy(n, "block").option("path", scratch_path(spark, name))
     .option("compression", "zstd").saveAsTable(name))
    kept = spark.table(name)
    texts = kept.select("block", "id", "text").where("text is not null")

    anchors = texts.groupBy("block").applyInArrow(
        lambda t: _send_anchors(t, buckets), "bucket int, block int, hashes binary, several binary")
    shared = anchors.repartition(buckets, "bucket").mapInArrow(_shared, "block int, hashes binary")
    sent = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        lambda t, r: _send_windows(t, r, buckets), "bucket int, block int, a binary, b binary, low binary, high binary")
    least = sent.repartition(buckets, "bucket").mapInArrow(_smallest, "block int, a binary, b binary, low binary")
    out = kept.groupBy("block").cogroup(least.groupBy("block")).applyInArrow(
        _remove, with_row(d, "n_words long, n_removed long, kept_text string"))
    return out.withColumn("row", F.col("row").cast(given))
