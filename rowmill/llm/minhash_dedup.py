"""Near-duplicate groups from bottom-k sketches of one hash function.

1. A document's set holds the 64-bit hashes of its distinct five-word shingles.
   The 64 smallest are its sketch (``Sizes``, here and below, at 0.75). Equal sets form a class, which its
   smallest id represents from here on.
2. The 48 smallest values of each class go to inverted lists. Two classes
   at 0.75 have at least 18 of them in common (six standard deviations
   under the mean), so values of one class alone are dropped, and so are each
   class's 17 most frequent values: the rarest common value is left in
   both (prefix filter over one order of values). A common passage or line
   therefore joins only classes that are largely made of such values.
3. Rounds make candidates from lists that still hold several components: each
   class with the smallest id of the list; then each with its neighbours
   (``PLACES`` away) when the list is sorted by ``ORDER`` minima of the
   sketch under a hash of the list's own, which puts like sketches together (a
   long list is cut by the first minimum). These are linear in the list, and big
   groups merge in them.
4. What is left is searched exactly. The classes in lists of several components
   are listed again under their full sets, less each set's most frequent
   shingles (a set of n has at least 0.75 n in common with a partner, so the
   rarest common one is left in both). A class whose shingles are too rarely
   shared for any partner is out; of the others, every class outside its list's
   largest component meets the other components, if the lengths and the places
   of the shingle in both sets allow 0.75: at the rarest common shingle, no more
   can be common than is left in either set. No pair is left untried, and no
   list emits all its pairs.
5. A pair stays if the sketch of its union estimates at least
   0.75 less six standard deviations; then both full sets are made from the
   whole texts and compared. Components are found after each round.

Defined results: null or wordless text has an empty set and is linked with
nothing; fewer than five words are one shingle; a null id sorts below all
others; rows that repeat an id share their component; empty table, empty
result; other columns are carried untouched whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.common import NULL_ID, packed, ship_package, written
from rowmill.llm.graph import components
from rowmill.llm.text import MULT_A, NON_WHITE, Words, chunks, mix, windows

SHINGLE = 5
PLACES = (1,)               # neighbours met, a round for each
ORDER = 3
BAND = 1.05                 # lengths within this ratio stand together in the last round


class Sizes:
    """What follows from the likeness num / den that links two sets.

    ``lists`` values of a sketch go to lists, 48 or as many as leave six standard
    deviations under the mean number of common ones above 0; ``least`` is that
    bound, ``estimate`` that of the union sketch."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError(f"a likeness of {num} / {den} is not in (0, 1]")
        self.num, self.den = num, den
        share = num / den
        spread = 6 * (share * (1 - share)) ** 0.5
        self.lists = max(48, int(((spread + (spread * spread + 4 * share) ** 0.5) / (2 * share)) ** 2) + 1)
        self.sketch = self.lists + 16
        self.least = max(1, int(share * self.lists - spread * self.lists ** 0.5))
        self.estimate = max(0.0, share - spread / self.sketch ** 0.5)

    def lengths(self, n: str, m: str) -> str:
        """SQL: sets of these sizes can reach the likeness."""
        return f"{self.den} * least({n}, {m}) >= {self.num} * greatest({n}, {m})"


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(buf, offs, NON_WHITE, True)
    h = w.hashes()
    grams = windows(h, SHINGLE, MULT_A)
    out = []
    for a, n in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(grams[a:a + n - SHINGLE + 1]))
        else:
            out.append(windows(h[a:a + n], n, MULT_A) ^ np.uint64(n) if n else np.zeros(0, np.uint64))
    return out


def _sketch(batches, sketch: int):
    for batch in batches:
        for piece, buf, offs in chunks(batch, "text"):
            sets = shingle_sets(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([s[:sketch].tobytes() for s in sets], pa.binary())],
                names=["id", "n", "digest", "sketch"])


def _postings(batches, lists_: int):
    for batch in batches:
        lists = [np.frombuffer(s, np.int64)[:lists_] for s in batch.column("sketch").to_pylist()]
        if lists:
            size = [len(x) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(lists)), pa.array(np.repeat(batch.column("id").to_numpy(), size)),
                 pa.array(np.repeat(batch.column("n").to_numpy(), size))], names=["v", "id", "n"])


def _alike(batches, sizes: Sizes):
    """Pairs whose union sketch estimates at least ``sizes.estimate``."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            union = np.union1d(p, q)
            if max(len(p), len(q)) == sizes.sketch:       # else both sets are whole
                union = union[:sizes.sketch]
            both = np.intersect1d(p, q, assume_unique=True)
            keep.append(np.searchsorted(both, union[-1], "right") >= sizes.estimate * len(union))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirm(batches, num: int, den: int):
    """Pairs whose full sets reach num/den."""
    last, known = None, np.zeros(0, np.uint64)
    for batch in batches:
        keep = []
        for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
            if a != last:
                last, known = a, _one(ta)
            other = _one(tb)
            same = len(np.intersect1d(known, other, assume_unique=True))
            keep.append(den * same >= num * (len(known) + len(other) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _one(text: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]))[0]


def _sorted_lists(batches):
    """Each class's values with the ORDER smallest hashes of its sketch under that value."""
    for batch in batches:
        out = []
        for i, n, kept, sketch in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "kept", "sketch")), strict=True):
            v = np.array(kept, np.int64)
            h = mix(np.frombuffer(sketch, np.uint64)[None, :] ^ mix(v.view(np.uint64))[:, None])
            if h.shape[1] < ORDER:
                h = np.concatenate([h, np.repeat(h[:, :1], ORDER - h.shape[1], axis=1)], axis=1)
            out.append((v, np.full(len(v), i), np.full(len(v), n), np.sort(np.partition(h, ORDER - 1, axis=1)[:, :ORDER], axis=1).view(np.int64)))
        if out:
            v, i, n, k = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(i), pa.array(n), *(pa.array(k[:, j].copy()) for j in range(ORDER))],
                                             names=["v", "id", "n", *(f"k{j}" for j in range(ORDER))])


def _hub_pairs(post: DataFrame, sizes: Sizes) -> DataFrame:
    """Each member of a list with the list's smallest id."""
    first = (post.groupBy("v").agg(F.min("id").alias("hub"), F.min_by("n", "id").alias("hn"), F.min_by("comp", "id").alias("hcomp"),
                                   F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high"))
    return (post.join(written(first.select("v", "hub", "hn", "hcomp"), "hubs"), "v").where("comp <> hcomp")
            .where(sizes.lengths("n", "hn"))
            .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")))


def _neighbour_pairs(post: DataFrame, place: int, sizes: Sizes) -> DataFrame:
    """Each member of a list with the one ``place`` before it in sketch order."""
    order = Window.partitionBy("v", F.shiftright("k0", 58)).orderBy(*(f"k{j}" for j in range(ORDER)), "id")
    return (post.withColumn("p", F.lag(F.struct("id", "n", "comp"), place).over(order))
            .where("p.comp <> comp and " + sizes.lengths("n", "p.n"))
            .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")))


def _whole_sets(batches):
    for batch in batches:
        for piece, buf, offs in chunks(batch, "text"):
            sets = shingle_sets(buf, offs)
            size = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(piece.column("id").to_numpy(), size)),
                 pa.array(np.repeat(np.array(size, np.int64), size))], names=["v", "id", "n"])


def _rest_pairs(post: DataFrame, texts: DataFrame, sizes: Sizes) -> DataFrame:
    """Every class outside its list's largest component with the other components,
    over lists of full sets.

    Of n + m shingles num / (num + den) must be common, and from its r-th on, in
    order of frequency, a set has r left. So the smaller of two sets (the first by
    id of equal ones) must have (num + den) r >= 2 num n at their rarest common
    shingle, and the larger no more than (num + den) r / num - n shingles. Under
    that, a list's pairs are found per band of lengths: a shingle that many texts
    share is dropped wherever it cannot be the rarest common one."""
    num, den = sizes.num, sizes.den
    live = post.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    ids = written(post.join(live.select("v"), "v", "left_semi").select("id", "comp").distinct(), "unsettled")
    sets = texts.join(ids.select("id"), "id", "left_semi").mapInArrow(_whole_sets, "v long, id long, n long")
    shared = sets.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    of_class = Window.partitionBy("id")
    lists = (sets.join(shared, "v").withColumn("r", F.row_number().over(of_class.orderBy(F.desc("df"), "v")))
             .where(f"{den} * r >= {num} * n").select("v", "id", "n", "r"))
    lists = written(lists.join(ids, "id"), "full-lists")
    by_comp = lists.groupBy("v", "comp").count()
    top = written(by_comp.groupBy("v").agg(F.max_by("comp", "count").alias("top"), F.count("*").alias("k"))
                  .where("k > 1").select("v", "top"), "main-components")
    some = lists.join(top, "v").select("v", "id", "n", "r", "comp", (F.col("comp") == F.col("top")).alias("main"))
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(BAND)) + F.lit(1e-9)).cast("int")
    widest = F.least(F.floor(F.col("n") * den / num), F.floor(F.col("r") * (num + den) / num) - F.col("n"))
    small = written(some.where(f"{num + den} * r >= {2 * num} * n").select(
        "v", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("r").alias("pr"), F.col("comp").alias("pcomp"),
        F.col("main").alias("pmain"), F.explode(F.sequence(band(F.col("n")) - 1, band(widest) + 1)).alias("band")), "smaller")
    large = written(some.withColumn("band", band(F.col("n"))), "larger")
    fits = (f"comp <> pcomp and (n > pn or n = pn and id > p) and {num + den} * least(r, pr) >= {num} * (n + pn) and "
            + sizes.lengths("n", "pn"))
    pairs = None
    for p, q in ((small.where("not pmain"), large), (small.where("pmain"), large.where("not main"))):
        met = p.join(q, ["v", "band"]).where(fits).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
        pairs = met if pairs is None else pairs.union(met)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75,
                    den: int = 100) -> DataFrame:
    """``(id, n_shingles, component_id)``, one row per input row; a null id is NULL_ID."""
    ship_package(docs.sparkSession)
    sizes = Sizes(num, den)
    d = packed(docs, id_col, text_col).select("id", "text")
    sketched = written(d.mapInArrow(lambda it: _sketch(it, sizes.sketch), "id long, n long, digest binary, sketch binary"), "sketches")
    reps = written(sketched.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("id"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes")
    classes = reps.select("digest", F.col("id").alias("rep"))

    values = reps.select("id", "n", "sketch").mapInArrow(lambda it: _postings(it, sizes.lists), "v long, id long, n long")
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    frequent_first = Window.partitionBy("id").orderBy(F.desc("df"), "v")
    post = written(values.join(shared, "v").withColumn("r", F.row_number().over(frequent_first))
                   .where(F.expr(f"r >= least({sizes.least}, ceil({num} * n / {den}))"))
                   .groupBy("id").agg(F.collect_list("v").alias("kept"))            # sizes.lists values at most
                   .join(reps.select("id", "n", "sketch"), "id")
                   .mapInArrow(_sorted_lists, "v long, id long, n long, " + ", ".join(f"k{j} long" for j in range(ORDER))),
                   "lists")
    texts = written(d.join(post.select("id").distinct(), "id", "left_semi"), "candidates")

    edges = tried = labels = None
    for turn in ("hub", *PLACES, "rest"):
        with_comp = post.withColumn("comp", F.col("id")) if labels is None else (
            post.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        if turn == "rest":
            pairs = _rest_pairs(with_comp, texts, sizes)
        else:
            pairs = _hub_pairs(with_comp, sizes) if turn == "hub" else _neighbour_pairs(with_comp, turn, sizes)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = (pairs.join(reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
                 .join(reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b"))
        alike = written(pairs.mapInArrow(lambda it: _alike(it, sizes), "a long, b long"), "alike")
        found = written(alike.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
                        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
                        .select("a", "b", "ta", "tb").mapInArrow(lambda it: _confirm(it, num, den), "a long, b long"),
                        "links")
        tried = alike if tried is None else tried.union(alike)
        if labels is None or not found.isEmpty():
            edges = found if edges is None else edges.union(found)
            labels = components(edges)
    rep_of = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", F.coalesce("comp", "rep").alias("component_id"))
    return sketched.join(rep_of, "digest", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def null_id(column: str):
    """The id as given: NULL_ID stands for null."""
    return F.nullif(F.col(column), F.lit(NULL_ID))
