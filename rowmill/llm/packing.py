"""Packing of token pieces into sequences by a configuration linear program.

A configuration says how many pieces of each length share one sequence. The
length histogram (at most ``capacity`` rows, whatever the input) goes to the
driver, where the program min sum(x) with all pieces covered is solved by
multiplicative weights: lengths that lag behind ask for the configurations that a
knapsack dynamic program over token positions prices best, prices fall with the
part covered, and steps are bounded for every length. The knapsack's worth is the
program's dual, a lower bound (``Program.bound``) on any packing. The fractional
runs are rounded to whole ones (small programs in several orders, of which the one
with the fewest sequences stands); best fit packs only the pieces that these leave.
The plan then says, for each length, which ranks go to which sequence and place;
pieces get their ranks in Spark, counted first per (length, salt).

Pieces: a document's ids are cut only if it has more than ``capacity``; all
pieces but the first are then full.

Defined results: null text is the empty text and packs as the end id alone; a
null id is carried as null; repeated rows are packed as often as they occur,
ties in any order; empty table, empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.common import packed, parts, ship_package, written
from rowmill.llm.text import chunks
from rowmill.llm.tokens import encoder, vocabulary

ROUNDS = 400                # knapsacks solved for one cover, at most
GAP = 1e-3                  # of the bound, at which the program counts as solved
LEARN = 5e-3                # gap from which prices are learned
RATE = 1.0                  # step of the multiplicative weights that learn prices
ROUNDINGS, ROUNDING_STEPS = 24, 60_000     # roundings tried, and configurations looked at in all of them
PARTS, SMALL = (1.0, 0.9, 0.75, 0.5), 500  # of the program's sequences that roundings run; all of them beyond SMALL sequences
FALL = 0.03                 # how prices fall with the part covered
TIE = 1e-4                  # parts of a sequence's worth that make no difference


def _pieces(batches, sent, capacity: int, end_id: int):
    enc = encoder(sent.value)
    for batch in batches:
        for rows, buf, offs in chunks(batch, "text"):
            ids, counts = enc.encode(buf, offs)
            ids = np.insert(ids.astype("<u4"), np.cumsum(counts), end_id)
            at, out = 0, []
            for k, n in enumerate((counts + 1).tolist()):
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for p in range(len(cuts) - 1):
                    a, b = cuts[p], cuts[p + 1]
                    out.append((k, p, a, b - a, zlib.crc32(ids[at + a:at + b])))
                at += n
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id").take(pa.array(cols[0])), pa.array(cols[1], pa.int32())]
                + [pa.array(c, pa.int64()) for c in cols[2:]],
                names=["id", "piece", "start", "length", "ids_crc32"])


class Prices:
    """Knapsack over token positions: the worth of the best sequence of each
    size, for one price per length, and the configurations that reach it."""

    def __init__(self, worth: np.ndarray, capacity: int):
        gain = np.where(worth > 0, worth, -np.inf)
        best = np.zeros(capacity + 1)
        back = best[::-1]
        for c in range(1, capacity + 1):
            best[c] = max(best[c - 1], (back[capacity - c + 1:] + gain[1:c + 1]).max())    # best[c - 1], ..., best[0]
        self.best, self.worth, self.capacity = best, worth, capacity

    def holding(self, held: np.ndarray, weight: np.ndarray, chance) -> tuple[np.ndarray, np.ndarray]:
        """For each length in ``held`` a best configuration (up to ``TIE``) among
        those with a piece of it; ties go by chance, in proportion to ``weight``.
        (place in ``held``, length) of every piece."""
        rows, got = [np.arange(len(held))], [held]
        sizes = np.flatnonzero((self.worth > 0) & (weight > 0))
        room = self.capacity - held
        live = np.flatnonzero(room >= sizes.min(initial=self.capacity + 1))
        while len(live):
            c = room[live][:, None]
            after = self.best[np.maximum(c - sizes, 0)] + self.worth[sizes]
            odds = np.where((sizes <= c) & (after >= self.best[c] - TIE), weight[sizes], 0).cumsum(axis=1)
            some = odds[:, -1] > 0
            live, odds = live[some], odds[some]
            piece = sizes[(odds <= chance.random(len(live))[:, None] * odds[:, -1:]).sum(axis=1)]
            rows.append(live)
            got.append(piece)
            room[live] -= piece
            live = live[room[live] >= sizes.min(initial=0)]
        return np.concatenate(rows), np.concatenate(got)


@dataclass
class Program:
    """Fractional solution: configuration ``row`` holds one piece of length
    ``piece`` per entry and runs ``times[row]`` sequences. ``value`` is their sum,
    ``bound`` a lower bound on any solution, whole or fractional."""
    row: np.ndarray
    piece: np.ndarray
    times: np.ndarray
    value: float
    bound: float


def _dual(need: np.ndarray, prices: np.ndarray, table: Prices) -> float:
    """No sequence is worth more than ``best``, so all pieces need this many."""
    return float((need * prices).sum() / table.best[-1])


def _learned(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Prices by multiplicative weights: the best configuration runs at every
    round, lengths that it covers get cheaper. Those of the best bound are kept."""
    log, kept, bound, chance = np.log(lengths / capacity), lengths / capacity, 0.0, np.random.default_rng(1)
    for k in range(ROUNDS):
        worth = np.zeros(capacity + 1)
        worth[lengths] = np.exp(log)
        table = Prices(worth, capacity)
        now = _dual(need, worth[lengths], table)
        if now > bound:
            bound, kept = now, worth[lengths] / table.best[-1]
        top = lengths[int(np.argmax(worth[lengths] + table.best[capacity - lengths]))]
        _, pieces = table.holding(np.array([top]), worth, chance)
        cover = np.bincount(pieces, minlength=capacity + 1)[lengths] / need
        log -= RATE / np.sqrt(k + 1) * cover / cover.max()
    return kept, bound


def _covered(lengths: np.ndarray, need: np.ndarray, prices: np.ndarray, capacity: int, step: float) -> Program:
    """Cover all pieces round by round. Every length that lags behind asks for the
    best configuration that holds it; no length is covered by more than ``step``
    of its pieces in a round (the width), and prices fall with the part covered."""
    size, chance = len(lengths), np.random.default_rng(len(lengths))
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(size)
    done, volume = np.zeros(size), float((need * prices).sum())
    rows, pieces, times, bound, at = [], [], [], 0.0, 0

    def add(asked, got, x):
        nonlocal at
        rows.append(asked + at)
        pieces.append(got)
        times.append(x)
        at += len(x)

    for k in range(ROUNDS):
        left = np.maximum(1 - done, 0)
        open_ = np.flatnonzero(left > 1e-9)
        if (need * prices * left).sum() <= GAP / 2 * volume:
            break
        worth = np.zeros(capacity + 1)
        worth[lengths] = prices
        if k == 0:
            bound = _dual(need, prices, Prices(worth, capacity))
        worth[lengths] *= np.exp(-FALL * (done - done.min()))
        worth[lengths[left <= 1e-9]] = 0
        table = Prices(worth, capacity)
        lag = open_[np.lexsort((chance.random(len(open_)), np.round(done[open_], 2)))][:max(40, len(open_) // 10)]
        weight = np.zeros(capacity + 1)
        weight[lengths] = left * need * lengths
        asked, got = table.holding(lengths[lag], weight, chance)
        spot = place[got]
        own = np.bincount(asked, spot == lag[asked], minlength=len(lag))
        short = 1 - (worth[lengths[lag]] + table.best[capacity - lengths[lag]]) / table.best[-1]
        x = np.minimum(step, left[lag]) * need[lag] / own * np.exp(-50 * short)
        room = np.minimum(step, left) * need
        for _ in range(3):                                   # configurations that share a length share its room
            use = np.bincount(spot, x[asked], minlength=size)
            cut = np.ones(len(lag))
            np.minimum.at(cut, asked, np.minimum(1, room / np.maximum(use, 1e-30))[spot])
            x = x * cut
        done += np.bincount(spot, x[asked], minlength=size) / need
        add(asked, got, x)
    rest = np.flatnonzero(done < 1 - 1e-9)
    if len(rest):                                            # cover may exceed the need from here on
        worth = np.zeros(capacity + 1)
        worth[lengths] = prices
        asked, got = Prices(worth, capacity).holding(lengths[rest], worth, chance)
        own = np.bincount(asked, got == lengths[rest][asked], minlength=len(rest))
        add(asked, got, (1 - done[rest]) * need[rest] / own)
    times = np.concatenate(times)
    return Program(np.concatenate(rows), np.concatenate(pieces), times, float(times.sum()), bound)


def solve(hist: np.ndarray, capacity: int) -> Program:
    """Configurations, each run a fractional number of times, that cover the
    histogram ``hist[length]``; ``value`` is within ``LEARN`` of ``bound``, or the
    best found in a fixed number of rounds.

    Prices start at a length's share of a sequence. Where those leave a larger gap
    (no mix of lengths fills sequences to the last token) they are learned first,
    and the cover is found in smaller and smaller steps until it is within ``GAP``.
    """
    lengths = np.flatnonzero(hist)
    need = hist[lengths].astype(float)
    found = _covered(lengths, need, lengths / capacity, capacity, 0.5)
    bound = found.bound
    if found.value > (1 + LEARN) * bound + 1:
        prices, bound = _learned(lengths, need, capacity)
        for step in (0.1, 0.03):
            other = _covered(lengths, need, prices, capacity, step)
            found, bound = min(found, other, key=lambda p: p.value), max(bound, other.bound, found.bound)
            if found.value <= (1 + GAP) * bound + 1:
                break
    found.bound = bound
    return found


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Largest length first, then always the largest that still fits; whole multiples at once."""
    hist = hist.copy()
    out = []
    lengths = np.flatnonzero(hist)
    while len(lengths):
        conf: dict[int, int] = {}
        room = capacity
        k = len(lengths) - 1
        while k >= 0 and room >= lengths[0]:
            k = min(k, int(np.searchsorted(lengths, room, "right")) - 1)
            if k < 0:
                break
            size = int(lengths[k])
            n = min(int(hist[size]), room // size)
            conf[size] = n
            room -= n * size
            k -= 1
        times = min(int(hist[s]) // n for s, n in conf.items())
        for s, n in conf.items():
            hist[s] -= times * n
        out.append((conf, times))
        lengths = lengths[hist[lengths] > 0]
    return out


def rounded(program: Program, hist: np.ndarray, seed: int | None = None, part: float = 1.0
            ) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole runs of the program's configurations, and the pieces they leave.

    Fractions are carried from one configuration to the next, so that the runs
    add up to the program's; a run stops where a length has no pieces left. The
    longest runs come first, or with a ``seed`` an order drawn in proportion; after
    ``part`` of the program's sequences the rest is left."""
    left = hist.copy()
    order = np.argsort(program.row, kind="stable")
    cuts = np.searchsorted(program.row[order], np.arange(len(program.times) + 1))
    out, owed, still = [], 0.0, int(np.ceil(part * program.value))
    first = program.times if seed is None else program.times ** 0.2 * np.random.default_rng(seed).random(len(program.times))
    for k in np.argsort(-first, kind="stable").tolist():
        size, n = np.unique(program.piece[order[cuts[k]:cuts[k + 1]]], return_counts=True)
        owed += program.times[k]
        runs = min(int(owed + 1e-9), int((left[size] // n).min()), still)
        if runs > 0:
            left[size] -= runs * n
            owed -= runs
            still -= runs
            out.append((dict(zip(size.tolist(), n.tolist(), strict=True)), runs))
        owed = min(owed, 1.0)
    return out, left


def plan(hist: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole configurations that hold the histogram exactly."""
    if not hist.any():
        return []
    program = solve(hist, capacity)
    best, fewest = [], None
    parts_ = PARTS if program.value <= SMALL else PARTS[:1]
    seeds = [None, *range(ROUNDING_STEPS // len(program.times) // len(parts_))]
    tries = [(s, p) for s in seeds for p in parts_]
    for seed, part in tries[:ROUNDINGS]:
        runs, left = rounded(program, hist, seed, part)
        whole = runs + best_fit(left, capacity)
        count = sum(t for _, t in whole)
        if fewest is None or count < fewest:
            best, fewest = whole, count
        if fewest <= np.ceil(program.bound - 1e-9):
            break
    return best


class Places:
    """Sequence and offset of the r-th piece of each length."""

    def __init__(self, configs: list[tuple[dict[int, int], int]]):
        rows: dict[int, list] = {}
        base = 0
        for conf, times in configs:
            offset = 0
            for size, n in sorted(conf.items(), reverse=True):
                seen = rows.setdefault(size, [])
                first = seen[-1][0] + seen[-1][1] * seen[-1][3] if seen else 0
                seen.append((first, n, base, times, offset))
                offset += n * size
            base += times
        self.sequences = base
        self.runs = {size: np.array(r, np.int64) for size, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length).tolist():
            here = np.flatnonzero(length == size)
            runs = self.runs[size]
            run = runs[np.searchsorted(runs[:, 0], rank[here], "right") - 1]
            r = rank[here] - run[:, 0]
            seq[here] = run[:, 2] + r // run[:, 1]
            off[here] = run[:, 4] + r % run[:, 1] * size
        return seq, off


def _place(batches, sent):
    places = sent.value
    for batch in batches:
        seq, off = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        keep = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(seq), pa.array(off)],
            names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece."""
    spark = docs.sparkSession
    ship_package(spark)
    sc = spark.sparkContext
    vocab = sc.broadcast(vocabulary(vocabulary_path))
    d = packed(docs, id_col, text_col).select("id", "text")
    pieces = written(d.mapInArrow(lambda it: _pieces(it, vocab, capacity, end_id),
                                  "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("length").count().collect():     # at most capacity rows
        hist[size] = n
    places = sc.broadcast(Places(plan(hist, capacity)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts(spark))).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
            .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = (salted.join(base, ["length", "salt"])
              .withColumn("rank", F.col("base") + F.row_number().over(within) - 1)
              .select("id", "piece", "start", "length", "ids_crc32", "rank"))
    return ranked.mapInArrow(lambda it: _place(it, places),
                             "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
