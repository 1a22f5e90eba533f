"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a run of rows of about ``SHARD_BYTES`` text inside a task; nothing is
shuffled. Words outside the benchmark's vocabulary end a segment, segments
shorter than the shortest test phrase are left out, and the rest is indexed:
suffix array (separators differ, so doubling ends at the longest segment),
Burrows-Wheeler transform, wavelet matrix for ranks, and suffix positions
sampled every ``SAMPLE`` words of a segment. All phrases are searched backwards
at once; occurrences walk back to a sampled position, become word spans, and
spans are merged.

A test phrase is 13 consecutive item words, or a whole shorter item. The
benchmark goes through the driver to the tasks in blocks of about ``BLOCK_BYTES``
text. With more than one, each block is a pass over the documents of its own that
writes out its hits before the block is released, so one block is held at a time;
the last pass starts from the hits of the others.

Defined results: null text has no words; an item without words has no phrase;
items that repeat an id are one item; a null item id reads as the empty
string; an empty benchmark hits nothing; empty table, empty result; ties and
repeated rows are judged row by row; other columns are carried untouched
whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import packed, ship_package, with_row, written
from rowmill.llm.text import ALNUM, Words, chunks, span_hashes

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Phrases:
    """The test phrases of a block of benchmark items, over a vocabulary of their own."""

    def __init__(self, items: list[tuple[str, str | None]]):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = WORD.findall((text or "").encode().lower())
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                found.setdefault(tuple(w[i:i + WINDOW]), set()).add(item)
        phrases = list(found)
        words = sorted({x for p in phrases for x in p})
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(x) for x in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        hashes = span_hashes(raw, np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends, ends)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        symbol = {words[j]: k + 1 for k, j in enumerate(order.tolist())}
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.shortest = int(self.size.min(initial=WINDOW))
        self.symbols = np.zeros((len(phrases), WINDOW), np.int64)      # aligned to the right
        for k, p in enumerate(phrases):
            self.symbols[k, WINDOW - len(p):] = [symbol[x] for x in p]
        self.items = [sorted(found[p]) for p in phrases]

    def read(self, w: Words) -> np.ndarray:
        """Symbol of each word; 0 for words of no phrase."""
        if not len(self.vocabulary):
            return np.zeros(len(w), np.int64)
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


class WaveletMatrix:
    """Rank of any symbol before any position, for arrays of queries at once."""

    def __init__(self, s: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (s >> bit) & 1
            before = np.zeros(len(s) + 1, np.int32)
            np.cumsum(one, out=before[1:])
            self.levels.append((bit, before, len(s) - int(before[-1])))
            s = np.concatenate([s[one == 0], s[one == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for bit, before, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            lo = np.where(one, zeros + before[lo], lo - before[lo])
            i = np.where(one, zeros + before[i], i - before[i])
        return i - lo


class FMIndex:
    """Index of segments of symbols (1..top); 0 ends each segment."""

    def __init__(self, s: np.ndarray, offset: np.ndarray, top: int):
        """``offset``: each symbol's place in its segment."""
        self.n = n = len(s)
        seps = np.cumsum(s == 0)
        order_of = np.where(s == 0, seps, seps[-1] + 1 + s)             # separators differ
        step = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[:n - step] = order_of[step:] + 1 if step < n else 0
            key = order_of * (int(nxt.max()) + 1) + nxt
            sa = np.argsort(key, kind="stable")
            k = key[sa]
            new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            order_of = np.empty(n, np.int64)
            order_of[sa] = new
            if new[-1] == n - 1:
                break
            step *= 2
        self.bwt = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        self.tree = WaveletMatrix(self.bwt, top)
        self.sampled = offset[sa] % SAMPLE == 0
        self.nth = np.cumsum(self.sampled) - 1
        self.position = sa[self.sampled]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each right-aligned phrase."""
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        live = np.arange(len(size))
        for t in range(phrases.shape[1]):
            live = live[(size[live] > t) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - t]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by walking back to a sampled one."""
        out, rank, steps = np.empty(len(rank), np.int64), rank.copy(), 0
        live = np.arange(len(rank))
        while len(live):
            at = rank[live]
            there = self.sampled[at]
            out[live[there]] = self.position[self.nth[at[there]]] + steps
            live, at = live[~there], at[~there]
            c = self.bwt[at]
            rank[live] = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


def find_phrases(w: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence in a shard."""
    none = np.zeros(0, np.int64)
    s = phrases.read(w)
    known = s > 0
    if not known.any():
        return none, none
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (w.doc[1:] != w.doc[:-1])
    at = np.flatnonzero(known)
    run = np.cumsum(begins)[at] - 1
    length = np.bincount(run)
    at, run = at[length[run] >= phrases.shortest], run[length[run] >= phrases.shortest]
    if not len(at):
        return none, none
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    nth = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(at)]])))
    place = np.arange(len(at)) + nth                        # a separator after each segment
    text = np.zeros(len(at) + len(first), np.int64)
    text[place] = s[at]
    word = np.full(len(text), -1)
    word[place] = at
    offset = np.ones(len(text), np.int64)                   # separators are not sampled
    offset[place] = at - at[first][nth]
    index = FMIndex(text, offset, len(phrases.vocabulary))
    lo, hi = index.search(phrases.symbols, phrases.size)
    many = hi - lo
    which = np.repeat(np.arange(len(many)), many)
    ranks = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    return which, word[index.locate(ranks)]


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows, sorted and disjoint."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.concatenate([first[1:] - 1, [len(spans) - 1]])]], axis=1)


def _search(batches, sent):
    phrases = sent.value
    for batch in batches:
        spans_of, items_of, words_of = [], [], []
        for piece, buf, offs in chunks(batch, "text", SHARD_BYTES):
            w = Words(buf, offs, ALNUM, True)
            which, start = find_phrases(w, phrases)
            doc = w.doc[start]
            order = np.argsort(doc, kind="stable")
            which, start, doc = which[order], start[order], doc[order]
            cut = np.searchsorted(doc, np.arange(len(offs))).tolist()
            old_spans, old_items = piece.column("spans").to_pylist(), piece.column("items").to_pylist()
            for d in range(len(offs) - 1):
                a, b = cut[d], cut[d + 1]
                if a == b:
                    spans_of.append(merged(np.frombuffer(old_spans[d], np.int64).reshape(-1, 2)).tobytes())
                    items_of.append(old_items[d])
                    continue
                s = start[a:b] - w.first[d]
                new = np.stack([s, s + phrases.size[which[a:b]]], axis=1)
                old = np.frombuffer(old_spans[d], np.int64).reshape(-1, 2)
                spans_of.append(merged(np.concatenate([old, new])).tobytes())
                items_of.append(sorted({*old_items[d], *(i for p in set(which[a:b].tolist()) for i in phrases.items[p])}))
            words_of += w.counts.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("text"), pa.array(words_of, pa.int64()),
             pa.array(spans_of, pa.binary()), pa.array(items_of, pa.list_(pa.string()))],
            names=["row", "text", "n_words", "spans", "items"])


def _spans(batches):
    for batch in batches:
        spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("row", "text", "n_words")]
            + [pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()), batch.column("items"),
               pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int64())))],
            names=["row", "text", "n_words", "n_hit", "items", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(row, text, n_words, n_hit, items, spans, contaminated)``: the sorted item
    ids that occur, merged word spans [start, end) they cover, and the rule
    20 * n_hit >= n_words with a hit."""
    spark = docs.sparkSession
    ship_package(spark)
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.col(item_text).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = packed(docs, id_col, text_col).select("row", "text")
    empty = F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items")

    def phrases(k: int):
        some = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast(Phrases([tuple(r) for r in some]))

    def search(df: DataFrame, sent) -> DataFrame:
        return df.mapInArrow(lambda it: _search(it, sent), with_row(df, "text string, n_words long, spans binary, items array<string>"))

    if blocks > 1:
        out = written(out.withColumn("at", F.monotonically_increasing_id()), "numbered")
        hits = None
        for k in range(blocks - 1):
            sent = phrases(k)
            found = search(out.select(F.struct("at").alias("row"), "text", *empty), sent)
            found = written(found.where("octet_length(spans) > 0").select("row.at", "spans", "items"), "hits")
            sent.destroy()
            hits = found if hits is None else hits.union(found)
        hits = hits.groupBy("at").agg(
            F.aggregate(F.collect_list("spans"), F.lit(b""), lambda x, y: F.concat(x, y)).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = out.join(hits, "at", "left").select("row", "text", F.coalesce("spans", empty[0]).alias("spans"),
                                                  F.coalesce("items", empty[1]).alias("items"))
    else:
        out = out.select("row", "text", *empty)
    out = search(out, phrases(blocks - 1))
    out = out.mapInArrow(_spans, with_row(out, "text string, n_words long, n_hit long, items array<string>, "
                                               "spans array<array<bigint>>"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
