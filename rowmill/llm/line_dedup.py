"""Line dedup with two Bloom filters.

1. Every line of at least ``min_chars`` code points is hashed once per row.
   Tasks emit the set bits of a once-seen and a twice-seen filter, cut into
   slices; a slice is merged by one task, where a bit set by two rows or by
   two tasks' once filters becomes a twice bit. Neither filter can miss a
   repeat; bits shared by chance only add suspects.
2. The twice filter (its size has a fixed upper bound, ``MAX_BITS``; past it
   more lines are suspected and no result changes) goes to all tasks. Only
   suspected lines are shuffled, whole, and counted exactly per key.
3. Keys in enough documents lose every line except in the largest document
   that holds them; the decisions return to the documents by id.

Defined results: null text is one empty line; a null id is one document below
all others; rows that repeat an id are one document for the counts and each
loses the same keys; a key inside one document counts once; empty table,
empty result; other columns are carried untouched whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import packed, parts, ship_package, with_row, written

BITS_PER_LINE = 12
MAX_BITS = 1 << 29                  # 64 MB for each task at any input size
PROBES = 3
FLUSH = 1 << 20                     # hashes a task holds before it emits bits
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def long_keys(text: str | None, min_chars: int) -> Iterator[bytes]:
    """Distinct keys of a text that have at least ``min_chars`` code points."""
    seen = set()
    for line in (text or "").encode().split(b"\n"):
        key = line_key(line)
        if len(key) >= min_chars and key not in seen and (
                len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            seen.add(key)
            yield key


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of 64-bit hashes; ``bits`` is a power of two."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return [((low + np.uint64(i) * (high | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)
            for i in range(PROBES)]


def _bits(batches, min_chars: int, bits: int, slices: int):
    width = bits // slices

    def emit(held: list[int]):
        values, counts = np.unique(np.array(held, np.uint64), return_counts=True)
        rows = {}
        for kind, some in (("once", values), ("twice", values[counts > 1])):
            at = np.unique(np.concatenate(probes(some, bits)))
            cut = np.searchsorted(at, np.arange(slices + 1) * width)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                rows.setdefault(s, {})[kind] = (at[cut[s]:cut[s + 1]] - s * width).astype(np.uint32).tobytes()
        return pa.RecordBatch.from_arrays([
            pa.array(list(rows), pa.int32()),
            pa.array([r["once"] for r in rows.values()], pa.binary()),
            pa.array([r.get("twice", b"") for r in rows.values()], pa.binary())],
            names=["slice", "once", "twice"])

    held: list[int] = []
    for batch in batches:
        for text in batch.column("text"):
            held.extend(xxhash.xxh3_64_intdigest(k) for k in long_keys(text.as_py(), min_chars))
            if len(held) >= FLUSH:
                yield emit(held)
                held = []
    if held:
        yield emit(held)


def _merge(batches, width: int):
    slices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for s, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            seen, again = slices.setdefault(s, (np.zeros(width, bool), np.zeros(width, bool)))
            at = np.frombuffer(once, np.uint32)
            again[at[seen[at]]] = True
            seen[at] = True
            again[np.frombuffer(twice, np.uint32)] = True
    for s, (_, again) in slices.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([s], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())],
            names=["slice", "twice"])


def twice_filter(docs: DataFrame, min_chars: int) -> np.ndarray:
    """Packed bits of the twice-seen filter over all lines of ``docs`` (text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    bits = 1 << 16
    while bits < min(MAX_BITS, lines * BITS_PER_LINE):
        bits *= 2
    n = parts(spark)
    slices = 16
    while slices < min(n, bits // 4096):
        slices *= 2
    width = bits // slices
    emitted = docs.select("text").mapInArrow(
        lambda it: _bits(it, min_chars, bits, slices), "slice int, once binary, twice binary")
    merged = emitted.repartition(min(n, slices), "slice").mapInArrow(
        lambda it: _merge(it, width), "slice int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for s, piece in merged.collect():                      # at most MAX_BITS in all
        out[s * width // 8:(s + 1) * width // 8] = np.frombuffer(piece, np.uint8)
    return out


def _suspects(batches, min_chars: int, filt):
    twice = filt.value
    bits = len(twice) * 8
    for batch in batches:
        ids, keys = [], []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            for k in long_keys(text.as_py(), min_chars):
                keys.append(k)
                ids.append(i)
        if not keys:
            continue
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        hit = np.ones(len(h), bool)
        for at in probes(h, bits):
            hit &= (twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        some = np.flatnonzero(hit)
        for a in range(0, len(some), 20_000):
            cut = some[a:a + 20_000].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j in cut], pa.int64()),
                 pa.array([keys[j].decode() for j in cut], pa.string())], names=["id", "key"])


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(id, hashes): for each document, hashes of the keys that it loses."""
    spark = docs.sparkSession
    filt = spark.sparkContext.broadcast(twice_filter(docs, min_chars))
    suspects = written(docs.select("id", "text").mapInArrow(
        lambda it: _suspects(it, min_chars, filt), "id long, key string"), "line-suspects")
    filt.unpersist()
    confirmed = written(suspects.groupBy("key").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper"))
                        .where(F.col("n") >= min_docs).select("key", "keeper"), "repeated-lines")
    # two written tables: the join splits the partition of a very common line, or needs no shuffle at all
    lost = suspects.join(confirmed, "key").where("id <> keeper")
    return lost.groupBy("id").agg(F.collect_set(F.unhex(F.md5("key"))).alias("lost"))


def _drop(batches, row_type: pa.DataType):
    for batch in batches:
        out = []
        for text, lost in zip(batch.column("text"), batch.column("lost"), strict=True):
            lines = (text.as_py() or "").encode().split(b"\n")
            kept = lines
            if lost.is_valid:
                gone = set(lost.as_py())
                kept = [x for x in lines if hashlib.md5(line_key(x)).digest() not in gone]
            out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
        n, dropped, texts = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()),
             pa.array(texts, pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``(row, n_lines, n_dropped, kept_text)``; ``row`` is the whole input row."""
    ship_package(docs.sparkSession)
    d = packed(docs, id_col, text_col)
    lost = repeated_keys(d, min_chars, min_docs)
    return d.join(lost, "id", "left").select("row", "text", "lost").mapInArrow(
        lambda it: _drop(it, None), with_row(d, "n_lines long, n_dropped long, kept_text string"))
