"""How far the sources of a language differ in their terms, exactly.

Term counts of every (language, source) group make one matrix a language, groups
by kept terms. It is cut into units of at most about ``CELLS`` non-zero cells:
some columns (by hash of the term) of two blocks of ``ROWS`` groups. A unit holds
its blocks as K-squared quadtrees. Both trees are descended together for all
pairs of groups: a quadrant empty in both is priced at once (a cell's price there
depends on the two groups alone), the cells that remain are priced one by one.
Sums over units give the pairs; the leaves give each group's leading terms.

No group of rows grows with a language's or source's share of the documents:
counts are added up before each shuffle, and a unit's size is bounded. The pairs
of a language's groups are the result itself, so the groups of a language must be
few enough for it to be written.

Rows: null text, language and source are ''. A group without terms is still
paired. Languages without a kept term have value 0 for every pair. Repeated rows
count as often as they stand; ids and other columns are not read. No documents:
no rows. Counts and prices are exact integers up to 9e15 occurrences in a
language, Python's integers beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.llm.common import parts, ship_package, written
from rowmill.llm.quadtree import QuadTree, joint
from rowmill.llm.text import Words, chunks

MIN_DOCS = 10
TOP = 10
ROWS = 64
CELLS, LEAST_CELLS = 1 << 15, 1 << 10
SCALE = 3                                    # shares are parts of 1000 ** SCALE

LETTER = np.zeros(256, bool)                 # [^\x00-\x40\x5B-\x60\x7B-\x7F]
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def _terms(batches):
    """(lang, source, term, n, docs) of each run of texts; a null term stands for the group itself."""
    for batch in batches:
        for part, buf, offs in chunks(batch, "text"):
            w = Words(buf, offs, LETTER, True)
            size = np.zeros(len(w) + 1, np.int64)
            np.cumsum(w.ends - w.starts, out=size[1:])
            raw = w.buf[LETTER[w.buf]]                            # the words' bytes, one after another
            flat = pa.LargeStringArray.from_buffers(len(w), pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(raw)))
            names = flat.dictionary_encode()
            code, names = names.indices.to_numpy().astype(np.int64), names.dictionary
            group = pc.binary_join_element_wise(part.column("lang"), part.column("source"), "\x00").dictionary_encode()
            of, most = group.indices.to_numpy().astype(np.int64), max(len(names), 1)
            first = np.zeros(len(group.dictionary), np.int64)
            first[of[::-1]] = np.arange(len(of))[::-1]
            cell, n = np.unique(w.doc * most + code, return_counts=True)
            key, at = np.unique(of[cell // most] * most + cell % most, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, n)
            row = np.concatenate([first[key // most], first])
            none = pa.nulls(len(first), names.type)
            zero = np.zeros(len(first), np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(row), part.column("source").take(row),
                 pa.concat_arrays([names.take(key % most), none]).cast(pa.string()),
                 pa.array(np.concatenate([total, zero])), pa.array(np.concatenate([np.bincount(at, minlength=len(key)), zero]))],
                names=["lang", "source", "term", "n", "docs"])


def shares(count: np.ndarray, size: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 (count + 2) / (size + 2 terms))``, exactly."""
    over = size + 2 * terms
    if len(over) and float(over.max()) > 9e15:
        return np.array([1 + 1000 ** SCALE * (int(c) + 2) // int(o) for c, o in zip(count, over, strict=True)], np.int64)
    left, out = count + 2, np.zeros(len(count), np.int64)
    for _ in range(SCALE):                                        # three digits to base 1000 at a time
        left = left * 1000
        out = out * 1000 + left // over
        left = left % over
    return 1 + out


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _unit(table: pa.Table, block_rows: int) -> pa.Table:
    """Partial sums of a unit's pairs, and candidates for its groups' leading terms."""
    lang = table.column("lang")[0].as_py()
    bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
    head = table.filter(pc.is_null(table.column("term")))
    cells = table.filter(pc.is_valid(table.column("term")))
    width, terms, lang_size = (head.column(c)[0].as_py() for c in ("width", "terms", "total"))
    names = cells.column("term").combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    col, g, n = names.indices.to_numpy().astype(np.int64), cells.column("g").to_numpy(), cells.column("n").to_numpy()
    depth = max(1, int(max(width, block_rows, 2) - 1).bit_length())
    sides = []
    for block in (bi, bj):
        rows = np.flatnonzero(head.column("g").to_numpy() // block_rows == block)
        groups, place = np.unique(head.column("g").to_numpy()[rows], return_index=True)
        sizes, here = head.column("n").to_numpy()[rows][place], np.flatnonzero(g // block_rows == block)
        sides.append((groups, sizes, QuadTree(g[here] - block * block_rows, col[here], n[here], depth)))
    (ga, na, ta), (gb, nb, tb) = sides
    many = lambda v: np.full(v, terms)
    total = np.zeros((len(ga), len(gb)), np.int64)
    if terms:
        zero, (r, s, _, x, y) = joint(ta, tb, (len(ga), len(gb)), width, bi == bj)
        empty = [shares(np.zeros(len(v), np.int64), v, many(len(v))) for v in (na, nb)]
        total = zero * price(empty[0][:, None], empty[1][None, :])
        np.add.at(total, (r, s), price(shares(x, na[r], many(len(r))), shares(y, nb[s], many(len(s)))))
    i, j = np.nonzero(np.triu(np.ones(total.shape, bool), 1) if bi == bj else np.ones(total.shape, bool))
    out = {"a": [ga[i]], "b": [gb[j]], "value": [total[i, j]], "term": [pa.nulls(len(i), pa.string())]}
    if bi == bj and len(g):
        p = shares(n, na[g - bi * block_rows], many(len(g)))
        q = shares(cells.column("total").to_numpy(), np.full(len(g), lang_size), many(len(g)))
        f = np.where(p > q, price(p, q), -1)
        order = np.lexsort((-f, g))                               # within a group the largest first
        start = np.searchsorted(g[order], g[order])
        place = np.arange(len(g)) - start
        last = f[order][np.minimum(start + TOP - 1, np.searchsorted(g[order], g[order], "right") - 1)]
        keep = order[(f[order] >= 0) & ((place < TOP) | (f[order] == last))]
        out["a"].append(g[keep])
        out["b"].append(g[keep])
        out["value"].append(f[keep])
        out["term"].append(names.dictionary.take(pa.array(col[keep])).cast(pa.string()))
    size = sum(len(v) for v in out["a"])
    return pa.table({"lang": pa.array([lang] * size, pa.string()), "a": pa.array(np.concatenate(out["a"]), pa.int64()),
                     "b": pa.array(np.concatenate(out["b"]), pa.int64()), "term": pa.chunked_array(out["term"], pa.string()),
                     "value": pa.array(np.concatenate(out["value"]), pa.int64())})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = MIN_DOCS, block_rows: int = ROWS, unit_cells: int = CELLS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has every other
    source of the language by divergence, part ``term`` the group's ``TOP`` terms
    that are commoner in it than in its language."""
    spark = docs.sparkSession
    ship_package(spark)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    read = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = written(read.mapInArrow(_terms, "lang string, source string, term string, n long, docs long")
                     .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = written(counts.where("term is not null").groupBy("lang", "term")
                   .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("cells"))
                   .where(F.col("docs") >= min_docs).drop("docs"), "kept")
    cells = counts.where("term is not null").select("lang", "source", "term", "n").join(kept.drop("cells"), ["lang", "term"])
    by_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.where("term is null").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(
        kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"), F.sum("cells").alias("cells")),
        "lang", "left")
    full = F.ceil(F.col("cells") / F.lit(unit_cells))
    spread = F.least(F.lit(parts(spark)), F.ceil(F.col("cells") / F.lit(LEAST_CELLS)))
    langs = written(langs.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_size", F.lit(0)).alias("lang_size"),
                         F.coalesce(F.greatest(full, spread), F.lit(1)).cast("int").alias("shards"),
                         F.ceil(F.col("groups") / F.lit(block_rows)).cast("int").alias("blocks")), "langs")
    g = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = written(groups.join(by_group, ["lang", "source"], "left").fillna(0, ["size"]).withColumn("g", g)
                     .join(langs, "lang"), "groups")
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    widths = (kept.join(langs, "lang").groupBy("lang", shard.alias("shard")).agg(F.count("*").alias("width")))
    known = groups.select("lang", "source", "g", "shards", "blocks")
    body = cells.join(known, ["lang", "source"]).select(
        "lang", shard.alias("shard"), "blocks", "g", "term", "n", "total", F.lit(0).cast("long").alias("width"),
        F.lit(0).cast("long").alias("terms"))
    head = (groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
            .join(widths, ["lang", "shard"], "left")
            .select("lang", "shard", "blocks", "g", F.lit(None).cast("string").alias("term"), F.col("size").alias("n"),
                    F.col("lang_size").alias("total"), F.coalesce("width", F.lit(0)).cast("long").alias("width"), "terms"))
    block = F.floor(F.col("g") / F.lit(block_rows)).cast("int")
    units = (body.union(head).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("bi", F.least(block, "other")).withColumn("bj", F.greatest(block, "other")).drop("blocks", "other"))
    out = written(units.groupBy("lang", "shard", "bi", "bj").applyInArrow(
        lambda t: _unit(t, block_rows), "lang string, a long, b long, term string, value long"), "units")
    name = groups.select("lang", "source", "g")
    pairs = out.where("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.union(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    other = name.select("lang", F.col("source").alias("item"), F.col("g").alias("b"))
    pair = both.join(other, ["lang", "b"]).select("lang", F.col("a").alias("g"), F.lit("pair").alias("part"), "item", "value")
    term = out.where("term is not null").select("lang", F.col("a").alias("g"), F.lit("term").alias("part"),
                                                F.col("term").alias("item"), "value")
    best = Window.partitionBy("lang", "g").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best))
    return (ranked(pair).union(ranked(term).where(F.col("rank") <= TOP)).join(name, ["lang", "g"])
            .select("lang", "source", "part", "item", "value", "rank"))
