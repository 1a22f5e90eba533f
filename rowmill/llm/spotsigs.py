"""SpotSigs document fingerprints.

A spot signature is a common word (anchor) with the next ``CHAIN`` content words
after it, skipping other anchors. A text's signatures form a set of 64-bit
hashes; its fingerprint names the partition by set length, the set's digest and
its ``SHOWN`` smallest signatures. Likeness is the Jaccard similarity of two
signature sets. Only neighbours are compared, and their likeness is always the
whole Jaccard value: the pruning by length (``floor`` of ``likeness``) is off
there, and the partition only names part of the fingerprint.

``similar`` compares all texts at a floor: sets meet in inverted lists of their
rarest signatures, kept by length partition, only with sets of their own and the
next partition, only if lengths and places allow the floor, and pairs are decided
by the whole Jaccard value.

Neighbours in id order are compared without a global sort of one task: ids
alone give the range of each partition and its first document, and that one
document is also sent to the partition before.

Defined results: null text is the empty text; a text without a signature uses
chains from every word, or its whole text hash, or (without words) the empty
set; two empty sets are alike (1), an empty and another are not (0); a null id
sorts first; repeated ids stand side by side, by text; the last document is
followed by the first; empty table, empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.common import packed, parts, ship_package, written
from rowmill.llm.text import ALNUM, Words, chunks, mix, span_hashes

CHAIN = 2
SHOWN = 4
GROUP_CHARS = 1 << 20
BASE = 0.75                 # length partitions: sets a partition apart can still reach this likeness

# Frequent function words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this
to was were which with you
au aux avec ce ces dans de des du elle en est et il je la le les leur lui mais ne nous on ou par pas pour qu que qui sa
se ses son sur un une vous
aber als am auch auf aus bei das dass dem den der die durch ein eine einem einen einer er es für hat ich im ist mit nach
nicht noch nur oder sich sie sind so um und von war werden wie wird zu zum zur
al como con del el entre era es esta fue ha hay la las lo los más me mi no nos para pero por que se ser si sin sobre su
sus también un una y ya
""".split()


def _anchor_hashes() -> np.ndarray:
    words = sorted({w.encode() for w in ANCHORS})
    ends = np.cumsum([len(w) for w in words])
    raw = np.frombuffer(b"".join(words), np.uint8)
    return np.sort(span_hashes(raw, np.concatenate([[0], ends[:-1]]), ends))


ANCHOR_HASHES = _anchor_hashes()


def signature_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct signatures of each text."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    w = Words(buf, offs, ALNUM, True)
    h = w.hashes()
    k = np.minimum(np.searchsorted(ANCHOR_HASHES, h), len(ANCHOR_HASHES) - 1)
    anchor = ANCHOR_HASHES[k] == h
    content = np.flatnonzero(~anchor)
    at = np.flatnonzero(anchor)
    first = np.searchsorted(content, at)
    fits = first + CHAIN <= len(content)
    at, first = at[fits], first[fits]
    fits = w.doc[content[first + CHAIN - 1]] == w.doc[at] if len(at) else np.zeros(0, bool)
    at, first = at[fits], first[fits]
    sig = h[at]
    for j in range(CHAIN):
        sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + h[content[first + j]])
    cut = np.searchsorted(w.doc[at], np.arange(len(texts) + 1)).tolist()
    out = []
    for d, t in enumerate(texts):
        s = sig[cut[d]:cut[d + 1]]
        if not len(s):
            own = h[w.first[d]:w.first[d + 1]]
            s = mix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]) if len(own) > 1 else own
            if not len(s) and t:
                s = np.array([xxhash.xxh3_64_intdigest(t)], np.uint64)
        out.append(np.unique(s))
    return out


def length_partition(n: int) -> int:
    """Sets whose partitions differ by two or more are less alike than BASE."""
    return 0 if n == 0 else 1 + int(math.log(n) / -math.log(BASE) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard similarity; 0 at once where the lengths alone keep it under ``floor``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < floor * large or not small:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def fingerprint(s: np.ndarray) -> str:
    return f"{length_partition(len(s))}:{xxhash.xxh3_128_hexdigest(s.tobytes())}:" + "".join(f"{int(x):016x}" for x in s[:SHOWN])


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the following text's beginning."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def _rows(group: list[tuple], following: str) -> pa.RecordBatch:
    ids = [g[0] for g in group]
    own = [g[1] for g in group]
    after = [*own[1:], following]
    other = [edited(a, b) for a, b in zip(own, after, strict=True)]
    sets = signature_sets([t.encode() for t in (*own, following, *other)])
    n = len(own)
    prints = [fingerprint(s) for s in sets]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in other]),
        pa.array(prints[:n]), pa.array(prints[n + 1:]),
        pa.array([likeness(sets[i], sets[n + 1 + i]) for i in range(n)], pa.float64()),
        pa.array([likeness(sets[i], sets[i + 1]) for i in range(n)], pa.float64()),
        pa.array([len(s) for s in sets[:n]], pa.int64())],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
               "n_signatures"])


def _walk(batches):
    """Sorted rows of one partition, the following partition's first document last."""
    group, size = [], 0
    ended = False
    for batch in batches:
        for i, text, guest in zip(batch.column("id").to_pylist(), batch.column("text"),
                                  batch.column("guest").to_pylist(), strict=True):
            t = text.as_py() or ""
            if ended:
                continue
            if guest:
                if group:
                    yield _rows(group, t)
                group, ended = [], True
                continue
            if size >= GROUP_CHARS:
                yield _rows(group, t)
                group, size = [], 0
            group.append((i, t))
            size += len(t)


def _bucket_of(bounds: list[float]):
    """Column function: range partition of an id, by binary search."""
    cut = np.array([int(b) for b in bounds], np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut, ids.to_numpy(), side="right").astype(np.int32))

    return bucket


def _guest_of(firsts: list[int], before: list[int]):
    """Column function: the partition that also needs an id's document, or -1.

    ``firsts`` ascend: the first id of each partition that has rows; ``before``
    names the partition ahead of it (of the first one, the last)."""
    first, to = np.array(firsts, np.int64), np.array(before, np.int32)

    @F.pandas_udf("int")
    def guest(ids: pd.Series) -> pd.Series:
        v = ids.to_numpy()
        if not len(first):
            return pd.Series(np.full(len(v), -1, np.int32))
        k = np.minimum(np.searchsorted(first, v), len(first) - 1)
        return pd.Series(np.where(first[k] == v, to[k], -1).astype(np.int32))

    return guest


def spot_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures)``."""
    spark = docs.sparkSession
    ship_package(spark)
    d = packed(docs, id_col, text_col).select("id", "text")
    n = parts(spark)
    bounds = sorted(set(d.approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket_of = _bucket_of(bounds)
    ids = d.select("id", bucket_of("id").alias("bucket"))
    firsts = sorted(tuple(r) for r in ids.groupBy("bucket").agg(F.min("id")).collect())      # one row per partition
    guest_of = _guest_of([f for _, f in firsts], [firsts[k - 1][0] for k in range(len(firsts))])
    home = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    away = F.struct(F.col("also").alias("bucket"), F.lit(True).alias("guest"))
    d = d.withColumn("bucket", bucket_of("id")).withColumn("also", guest_of("id"))
    sent = (d.select("id", "text", F.explode(F.when(F.col("also") < 0, F.array(home)).otherwise(F.array(home, away))).alias("to"))
            .select("id", "text", "to.bucket", "to.guest"))
    rows = sent.repartitionById(max(len(bounds) + 1, 1), F.col("bucket")).sortWithinPartitions("guest", "id", "text")
    return rows.mapInArrow(_walk, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double, n_signatures long")


def _class_rows(batches):
    for batch in batches:
        for piece, buf, offs in chunks(batch, "text"):
            sets = signature_sets([buf[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "digest", "sigs"])


def _exploded(batches):
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column("sigs").to_pylist()]
        size = [len(s) for s in sets]
        if sum(size):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("id").to_numpy(), size)), pa.array(np.repeat(batch.column("n").to_numpy(), size)),
                 pa.array(np.concatenate(sets))], names=["id", "n", "sig"])


def _alike(batches, num: int, den: int):
    for batch in batches:
        keep, value = [], []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = len(np.intersect1d(a, b, assume_unique=True))
            total = len(a) + len(b) - same
            keep.append(den * same >= num * total)
            value.append(same / total)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value, pa.float64())],
                                         names=["a", "b", "likeness"]).filter(pa.array(keep, pa.bool_()))


def similar(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
            ) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``(id, class_id)`` for every row, where rows of equal
    signature sets share the smallest id, and ``(a, b, likeness)``, a < b, for all
    classes whose sets are at least num / den alike. Empty sets stand alone.

    A set of n signatures has at least num n / den in common with a partner, so the
    rarest common one is among its n - num n / den + 1 rarest: only those are listed.
    Of two sets that meet there, the smaller has at least num (n + m) / (num + den)
    signatures from that one on, and so has the larger. A signature that very many
    sets hold is listed only for sets made of such signatures.
    """
    if not 0 < num <= den:
        raise ValueError(f"a likeness of {num} / {den} is not in (0, 1]")
    ship_package(docs.sparkSession)
    d = packed(docs, id_col, text_col).select("id", "text")
    rows = written(d.mapInArrow(_class_rows, "id long, n long, digest binary, sigs binary"), "signatures")
    reps = written(rows.groupBy("digest").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sigs").alias("sigs")), "classes")
    members = rows.join(reps.select("digest", F.col("id").alias("class_id")), "digest").select("id", "class_id")

    every = reps.mapInArrow(_exploded, "id long, n long, sig long")
    shared = every.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    from_rarest = Window.partitionBy("id").orderBy(F.desc("df"), "sig")
    # r: signatures from this one on, in order of frequency; those no other set holds come after all and are not listed
    lists = (every.join(shared, "sig").withColumn("r", F.row_number().over(from_rarest)).where(f"{den} * r >= {num} * n")
             .withColumn("part", _partition(F.col("n"), num, den)))
    small = written(lists.where(f"{num + den} * r >= {2 * num} * n").select(
        "sig", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("r").alias("pr"),
        F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part")), "smaller-sets")
    large = written(lists.select("sig", "part", "id", "n", "r"), "larger-sets")
    met = (small.join(large, ["sig", "part"])
           .where(f"(n > pn or n = pn and id > p) and {den} * pn >= {num} * n and {num + den} * least(r, pr) >= {num} * (n + pn)")
           .select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct())
    pairs = (met.join(reps.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a")
             .join(reps.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b"))
    return members, pairs.mapInArrow(lambda it: _alike(it, num, den), "a long, b long, likeness double")


def _partition(n, num: int, den: int):
    """Length partition at this floor: a set's partners of more signatures stand in its own or the next one."""
    if num == den:
        return n.cast("int")
    return F.floor(F.log(n) / F.lit(math.log(den / num)) + F.lit(1e-9)).cast("int")
