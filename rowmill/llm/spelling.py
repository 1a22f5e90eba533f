"""Spelling variants of a corpus' words, grouped by dense prefix-suffix tiles.

Two words are near when one code point is put in, left out or replaced: exactly
when the lengths of their common prefix and common suffix add up to at least the
longer length less one. Tiles are pairs of blocks of words, held as padded
code-point matrices, one aligned left for prefixes and one right for suffixes;
all pairs of a tile are compared at once.

Which words share a tile: a pair whose prefix ends at position p agrees outside
p. A word stands under each of the two halves of its own length and of the next
(as the shorter partner): under (length, lo, hi) stand the words that share all
but the code points lo to hi. A pair is told only where p lies in lo..hi, hence
once. Words of a key shared by more than ``TILE`` words go under the halves of
lo..hi instead, and so on: hot keys are cut until they fit a tile, no word is
left out. With one open position at most one word per letter (and the shorter
one) shares a key, so this ends.

Counts are added up before each shuffle; words, keys and links live in Spark
tables. Rows: null text holds no word; a null id is written as an empty string
before the colon; repeated rows count as often as they stand; texts of any length
are read whole. No words: no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import ship_package, written
from rowmill.llm.text import LOWER, Words, chunks

MIN_CHARS = 7
MIN_COUNT = 2
SLIP = 31                       # a run whose checksum this divides loses a code point
RATIO = 10
TILE = 256
TILE_CELLS = 1 << 22            # code points of a tile's block pair, compared in one step

HEAD = np.zeros(256, bool)      # bytes of [A-Za-zÀ-ÿ]: letters, and C3 80 to C3 BF
HEAD[0x41:0x5B] = HEAD[0x61:0x7B] = True


def _runs(batches):
    """(word, n): runs of one stretch of texts, with their slips."""
    for batch in batches:
        for part, buf, offs in chunks(batch, "text"):
            flag = HEAD[buf]
            two = np.flatnonzero(buf[:-1] == 0xC3) if len(buf) else np.zeros(0, np.int64)
            flag[two] = flag[two + 1] = True                 # C3 is always followed by one of 80 to BF
            w = Words.flagged(buf, offs, flag)
            size = np.zeros(len(w) + 1, np.int64)
            np.cumsum(w.ends - w.starts, out=size[1:])
            flat = pa.LargeStringArray.from_buffers(len(w), pa.py_buffer(size), pa.py_buffer(LOWER[buf[flag]]))
            names = flat.dictionary_encode()
            code, names = names.indices.to_numpy().astype(np.int64), names.dictionary
            most = max(len(names), 1)
            cell, n = np.unique(w.doc * most + code, return_counts=True)
            doc, code = cell // most, cell % most
            ids = ["" if x is None else str(x) for x in part.column("id").to_pylist()]
            start = [zlib.crc32(f"{x}:".encode()) for x in ids]
            raw = names.cast(pa.large_binary()).to_pylist()
            crc = zlib.crc32
            h = np.fromiter((crc(raw[c], start[d]) for d, c in zip(doc.tolist(), code.tolist(), strict=True)), np.int64, len(cell))
            slip = np.flatnonzero(h % SLIP == 0)
            whole = np.bincount(code, n, minlength=len(names)) - np.bincount(code[slip], n[slip], minlength=len(names))
            told: dict[str, int] = {}
            text = {c: names[c].as_py() for c in np.unique(code[slip]).tolist()}
            for c, x, k in zip(code[slip].tolist(), h[slip].tolist(), n[slip].tolist(), strict=True):
                at = x % len(text[c])
                one = text[c][:at] + text[c][at + 1:]
                told[one] = told.get(one, 0) + k
            keep = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([names.take(pa.array(keep)).cast(pa.string()), pa.array(list(told), pa.string())]),
                 pa.array(np.concatenate([whole[keep].astype(np.int64), np.array(list(told.values()), np.int64)]))],
                names=["word", "n"])


def _matrix(words: list[str], left: bool, width: int) -> np.ndarray:
    """Code points, padded with 0."""
    out = np.zeros((len(words), width), np.uint32)
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at if left else at + (width - size)[row]] = flat
    return out.astype(np.uint8) if not len(flat) or flat.max() < 256 else out


def _equal_run(a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Length of the common run of each pair of rows, from the left or the right edge."""
    same = a[:, None, :] == b[None, :, :]
    if back:
        same = same[:, :, ::-1]
    run = same.argmin(axis=2)
    return np.where(same.all(axis=2), a.shape[1], run)


def near_pairs(words: list[str], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, longer: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile that are near, of one group, at least one of length
    ``longer``, and whose prefix ends in lo..hi; (i, j) with i < j."""
    size = np.array([len(w) for w in words])
    width = int(size.max(initial=0))
    ahead, behind = _matrix(words, True, width), _matrix(words, False, width)
    step = max(1, TILE_CELLS // max(1, len(words) * width))
    found_i, found_j = [], []
    for a in range(0, len(words), step):
        part = slice(a, a + step)
        last = longer[part][:, None]
        shorter = np.minimum(size[part][:, None], size[None, :])          # padding may agree, past the shorter word
        front = np.minimum(_equal_run(ahead[part], ahead, False), shorter)
        rear = np.minimum(_equal_run(behind[part], behind, True), shorter)
        near = (front + rear >= last - 1) & (np.maximum(size[part][:, None], size[None, :]) == last)
        near &= (group[part][:, None] == group[None, :]) & (front >= lo[part][:, None]) & (front < hi[part][:, None])
        i, j = np.nonzero(near)
        up = i + a < j
        found_i.append(i[up] + a)
        found_j.append(j[up])
    return np.concatenate(found_i), np.concatenate(found_j)


def _tiles(batches):
    """(word, near, near_n), both ways, from rows sorted by length and key."""
    names = ["word", "n", "longer", "lo", "hi", "key"]
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch.select(names))
        rows += batch.num_rows
        if rows >= TILE:
            table = pa.Table.from_batches(held).combine_chunks()
            last = _last_group(table)
            yield from _compared(table.slice(0, last))
            held = table.slice(last).to_batches()
            rows = table.num_rows - last
    if rows:
        yield from _compared(pa.Table.from_batches(held).combine_chunks())


def _keys(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy() for c in ("longer", "lo", "hi", "key"))


def _cuts(table: pa.Table) -> np.ndarray:
    """Places at which another key begins."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for v in _keys(table):
        new |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1]) if table.num_rows else np.zeros(0, np.int64)


def _last_group(table: pa.Table) -> int:
    return int(_cuts(table)[-1])


def _compared(table: pa.Table):
    cuts = _cuts(table)
    if not len(cuts):
        return
    size = np.diff(np.concatenate([cuts, [table.num_rows]]))
    group = np.repeat(np.arange(len(cuts)), size)
    several = np.flatnonzero(size[group] > 1)
    table, group = table.take(several), group[several]
    n, (longer, lo, hi, _) = table.column("n").to_numpy(), _keys(table)
    at = 0
    while at < len(group):
        end = int(np.searchsorted(group, group[min(at + TILE, len(group)) - 1], "right"))
        if end - at > TILE and group[end - 1] != group[at]:               # whole groups only
            end = int(np.searchsorted(group, group[end - 1]))
        words = table.column("word").slice(at, end - at)
        i, j = near_pairs(words.to_pylist(), group[at:end], lo[at:end], hi[at:end], longer[at:end])
        if len(i):
            a, b = np.concatenate([i, j]), np.concatenate([j, i])
            words = words.combine_chunks()
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(n[at + b])],
                                             names=["word", "near", "near_n"])
        at = end


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the corpus, each run with its document's slip."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return (d.mapInArrow(_runs, "word string, n long").where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: every near pair of ``words (word, n)``, distinct words, both ways."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    halves = lambda lo, mid, hi: F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))

    def keyed(rows, ranges):
        key = F.xxhash64("longer", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("right(word, longer - hi)"))
        return (rows.select("word", "n", "longer", F.explode(ranges).alias("open"))
                .select("word", "n", "longer", "open.lo", "open.hi").withColumn("key", key))

    todo = written(keyed(rows, halves(F.lit(0), F.floor(F.col("longer") / 2).cast("int"), F.col("longer"))), "keys")
    fit = None
    while True:
        hot = written(todo.where("hi - lo > 1").groupBy("key", "longer").agg(F.count("*").alias("many"))
                      .where((F.col("many") > TILE) | (F.col("many") * F.col("longer") > TILE_CELLS)).select("key"), "hot")
        if hot.isEmpty():
            fit = todo if fit is None else fit.unionByName(todo)
            break
        some = todo.join(hot, "key", "left_anti")
        fit = some if fit is None else fit.unionByName(some)
        cut = todo.join(hot, "key", "left_semi").where("hi - lo > 1")
        fit = fit.unionByName(todo.join(hot, "key", "left_semi").where("hi - lo <= 1"))
        todo = written(keyed(cut, halves(F.col("lo"), F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"), F.col("hi"))), "keys")
    return (fit.repartition("key").sortWithinPartitions("longer", "key", "lo", "hi")
            .mapInArrow(_tiles, "word string, near string, near_n long"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every word of ``forms (word, form)``, by doubling."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each word of the corpus."""
    words = written(word_counts(docs, id_col, text_col, min_chars, min_count), "words")
    best = (near_words(words).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")))
    form_n = -F.col("best.less")
    found = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= ratio * F.col("n"), F.struct(F.col("best.near").alias("word"), form_n.alias("n"))).alias("form"))
        .select("word", "n", "n_near", F.col("form.word").alias("form"), F.col("form.n").alias("form_n")), "variants")
    roots = _roots(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
