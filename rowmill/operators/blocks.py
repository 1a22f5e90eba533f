"""Block (per-partition) numeric kernels over array<double> columns.

Pattern used by every data-sized numeric aggregate in the library:

1. ``mapInArrow`` turns each Arrow record batch of a partition into a dense
   numpy block (rows x d) and accumulates a *model-sized* partial result
   (a d x d Gram block, d x k cross moment, k x d centroid sums, ...);
   each partition emits its partial once, as a flat vector packed 64
   values per row ``(blk, v0..v63)`` -- about 8 bytes per value.
2. ``groupBy(blk)`` with 64 sums combines the partials (map-side partial
   aggregation, codegen). The shuffle carries partitions x model size
   values, never data rows, so skew in the data (one class or cluster
   holding a third of all rows) does not reach the shuffle. Small enough
   partial sets are summed on the driver directly instead.

Empty partitions and empty batches emit nothing. Model state needed inside
tasks (a direction block P, centres, a projection V) is shipped in the
closure when small and as a broadcast variable when large.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import SparseBlock

# Arrays larger than this many bytes travel as a broadcast variable rather
# than inside the pickled task closure.
BROADCAST_BYTES = 1 << 20
# Model arrays beyond this size are refused: every executor holds a copy.
MAX_BROADCAST_BYTES = 2 << 30


class _Inline:
    """Same interface as a Broadcast: ``.value``."""

    def __init__(self, value):
        self.value = value

    def destroy(self):  # pragma: no cover - symmetry with Broadcast
        pass


def ship(spark, array: np.ndarray):
    """Make a driver-side array available to tasks."""
    if array.nbytes > MAX_BROADCAST_BYTES:
        raise ValueError(f"a model array of {array.nbytes} bytes is over the broadcast bound of "
                         f"{MAX_BROADCAST_BYTES}; use fewer features, outputs or iterates at once")
    if array.nbytes > BROADCAST_BYTES:
        return spark.sparkContext.broadcast(array)
    return _Inline(array)


def release(handle) -> None:
    try:
        handle.destroy()
    except Exception:  # pragma: no cover
        pass


def to_matrix(arr, d: int, name: str = "features") -> np.ndarray:
    """Arrow list<number> array -> (rows x d) float64 block, checking
    nulls and that every row has length d."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        raise ValueError(f"{name}: null rows are not allowed")
    lens = np.diff(arr.offsets.to_numpy())
    if lens.size and (lens.min() != d or lens.max() != d):
        raise ValueError(
            f"{name}: rows of unequal length, expected {d}, found "
            f"{int(lens.min())}..{int(lens.max())}")
    values = arr.flatten()
    if values.null_count:
        raise ValueError(f"{name}: null elements are not allowed")
    out = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return out.reshape(-1, d) if d else out.reshape(len(arr), 0)


def to_vector(arr, name: str = "label") -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        raise ValueError(f"{name}: null values are not allowed")
    return arr.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def one_hot_block(classes: np.ndarray, k: int) -> np.ndarray:
    c = classes.astype(np.int64)
    if c.size and (c.min() < 0 or c.max() >= k):
        raise ValueError(f"class id out of range [0,{k}): {int(c.min())}..{int(c.max())}")
    y = np.zeros((c.size, k))
    y[np.arange(c.size), c] = 1.0
    return y


def list_array(mat: np.ndarray) -> pa.ListArray:
    """(rows x s) numpy -> Arrow list<double> array."""
    rows, s = mat.shape
    offsets = pa.array(np.arange(0, (rows + 1) * s, s, dtype=np.int32) if rows else
                       np.zeros(1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1), type=pa.float64()))


# Output blocks built inside a task are cut into pieces of about this size.
CHUNK_BYTES = 32 << 20


def row_chunks(rows: int, width: int):
    """Row slices whose (rows x width) float64 block stays near CHUNK_BYTES."""
    step = max(1, CHUNK_BYTES // max(1, 8 * width))
    for start in range(0, rows, step):
        yield start, min(rows, start + step)


def to_block(arr, d: int, name: str = "features") -> "np.ndarray | SparseBlock":
    """Rows of either form: dense (array<double>) or sparse (see :mod:`sparse`)."""
    return SparseBlock.of(arr, d, name) if pa.types.is_struct(arr.type) else to_matrix(arr, d, name)


class RowMap:
    """A row-wise map x (d) -> phi(x) (s) that kernels apply inside their pass,
    so that the mapped rows are never a column, stored or shuffled."""

    d: int
    s: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def release(self) -> None:
        """Drop what was shipped for the map."""


def pieces(batch, features: str, d: int, rows: "RowMap | None" = None):
    """``(lo, hi, block)``: the features of a batch as dense blocks of width ``d``,
    mapped a chunk of rows at a time when there is a row map."""
    if rows is None:
        yield 0, batch.num_rows, to_block(batch.column(features), d, features)
        return
    if rows.s != d:
        raise ValueError(f"{features}: the row map gives {rows.s} values a row, expected {d}")
    x = to_block(batch.column(features), rows.d, features)
    for lo, hi in row_chunks(x.shape[0], max(rows.s, rows.d)):
        yield lo, hi, rows(x[lo:hi])


def exchange_free_partitions(df: DataFrame) -> int | None:
    """Partition count of a frame whose plan has no shuffle (scans, cached
    scans, projections, maps), read without running anything; None when
    the plan shuffles (under AQE, asking for its RDD would already run the
    shuffle stages)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan:
        return None
    return df.rdd.getNumPartitions()


@dataclass
class Prepared:
    """Input of a partial kernel, planned once: the selected columns (maybe
    coalesced) and the partition count when known without running anything.
    Iterative fits prepare their persisted frame once and reuse it.

    Every map task emits a model-sized partial of ``partial_values``
    values, so the partial shuffle carries partitions x partial_values
    values. When a scan-like input has many more partitions than 4x the
    cluster's cores, it is coalesced (narrow, no shuffle) to that many
    tasks: every core stays busy and the partial shuffle shrinks by the
    coalescing factor. Wide partials (``WIDE_PARTIAL`` values) go down to one
    task a core: each adds up several input partitions locally before anything
    is shuffled. Inputs that end in a
    shuffle already have spark.sql.shuffle.partitions (AQE-coalesced)
    partitions and are left alone."""
    df: DataFrame
    partitions: int | None


def _session(df):
    return (df.df if isinstance(df, Prepared) else df).sparkSession


class PassFrame:
    """What an iterative fit reads every pass; ``release()`` drops the
    persisted copy only if the fit made it (never the caller's)."""

    def __init__(self, df: DataFrame, partitions: int | None, owned: bool):
        self.df, self.partitions, self.owned = df, partitions, owned

    def release(self) -> None:
        if self.owned:
            self.df.unpersist()


def persist_for_passes(df: DataFrame, columns: list, persist: bool = True) -> PassFrame:
    """The frame an iterative fit re-reads every pass: the needed columns,
    persisted (MEMORY_AND_DISK), and its partition count. A scan-like
    lineage gives the count without running anything; a lineage with a
    shuffle is materialised once first, after which the stored blocks give
    it, so every pass can use the bounded direct combine.

    ``persist=False`` re-reads the source every pass instead (for inputs
    larger than the cluster's storage; a pruned Parquet scan costs about
    what reading a disk-persisted copy costs)."""
    from ..session import cached

    level = df.storageLevel
    already = level.useMemory or level.useDisk
    if not persist or already:
        # re-read the source each pass, or the caller's persisted copy
        # (no second copy of the same data)
        src = df.select(*columns)
        parts = exchange_free_partitions(src)
        if parts is None and already:
            src.count()
            parts = src.rdd.getNumPartitions()
        return PassFrame(src, parts, owned=False)
    frame = cached(df.select(*columns))
    parts = exchange_free_partitions(frame)
    if parts is None:
        frame.count()
        parts = frame.rdd.getNumPartitions()
    return PassFrame(frame, parts, owned=True)


WIDE_PARTIAL = 1 << 16       # values of a partial from which tasks add up all they can before the shuffle


def coalesce_target(spark) -> int | None:
    """Map-task count to coalesce partial aggregates to: 4 x the cluster's
    cores. Under dynamic allocation the registered cores are only those
    present so far, so the configured maximum is used instead, and with no
    maximum nothing is coalesced (None)."""
    sc = spark.sparkContext
    conf = sc.getConf()
    cores = sc.defaultParallelism
    if conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        max_exec = conf.get("spark.dynamicAllocation.maxExecutors", None)
        if not max_exec or not max_exec.isdigit() or int(max_exec) >= 2 ** 31 - 1:
            return None
        per = conf.get("spark.executor.cores", "1")
        cores = max(cores, int(max_exec) * (int(per) if per.isdigit() else 1))
    return 4 * max(1, cores)


def prepare(df: DataFrame, columns: list, partial_values: int,
            partitions: int | None = -1) -> Prepared:
    """``partitions``: the frame's known partition count (from
    :func:`persist_for_passes`); -1 probes the plan."""
    src = df.select(*columns)
    parts = exchange_free_partitions(src) if partitions == -1 else partitions
    target = coalesce_target(df.sparkSession)
    if target is not None and partial_values >= WIDE_PARTIAL:
        target = max(1, target // 4)
    if target is not None and parts is not None and partial_values >= 64 and parts > target:
        return Prepared(src.coalesce(target), target)
    return Prepared(src, parts)


# ---------------------------------------------------------------------------
# Partial vectors: emit, combine, reduce
# ---------------------------------------------------------------------------

# A partial result is a flat float64 vector with a layout known to its
# kernel. It travels as rows (blk, v0 .. v{WIDTH-1}): WIDTH consecutive
# values per row, about 8 bytes per value in the shuffle. Combining is
# groupBy(blk) with WIDTH sums, partially aggregated map-side by codegen.
WIDTH = 64
_VALUE_COLS = [f"v{w}" for w in range(WIDTH)]
PARTIAL_SCHEMA = "blk int, " + ", ".join(f"{c} double" for c in _VALUE_COLS)

# Partials (partitions x vector length) up to this many values are summed on
# the driver straight from the map stage (as treeAggregate would); above it
# they are combined by a shuffle first.
DIRECT_COMBINE_VALUES = 2_000_000


def blocks_of(length: int) -> int:
    return -(-max(length, 1) // WIDTH)


def _vector_rows(vec: np.ndarray) -> pa.RecordBatch:
    nb = blocks_of(vec.size)
    padded = np.zeros(nb * WIDTH)
    padded[: vec.size] = vec
    mat = padded.reshape(nb, WIDTH)
    cols = {"blk": pa.array(np.arange(nb, dtype=np.int32), type=pa.int32())}
    for w, name in enumerate(_VALUE_COLS):
        cols[name] = pa.array(mat[:, w], type=pa.float64())
    return pa.RecordBatch.from_pydict(cols)


def partial_frame(df: "DataFrame | Prepared", columns: list, update: Callable,
                  emit: Callable, length: int) -> DataFrame:
    """Uncombined per-partition partials.

    ``update(state, batch) -> state`` folds one non-empty record batch;
    ``emit(state)`` returns the partial as a flat vector of ``length``.
    Empty partitions emit nothing."""

    def run(batches: Iterator[pa.RecordBatch]):
        state = None
        for b in batches:
            if b.num_rows == 0:
                continue
            state = update(state, b)
        if state is not None:
            vec = np.asarray(emit(state), dtype=np.float64).reshape(-1)
            yield _vector_rows(vec)

    src = df if isinstance(df, Prepared) else prepare(df, columns, length)
    return src.df.mapInArrow(run, PARTIAL_SCHEMA)


def combine(part: DataFrame) -> DataFrame:
    """Lazy shuffle-combine: one row per block."""
    return part.groupBy("blk").agg(*[F.sum(c).alias(c) for c in _VALUE_COLS])


def flat_values(part: DataFrame, length: int) -> DataFrame:
    """Lazy combined vector as long rows ``(idx, v)``, idx < length."""
    cells = combine(part).select(
        "blk", F.posexplode(F.array(*[F.col(c) for c in _VALUE_COLS])).alias("w", "v"))
    idx = (F.col("blk").cast("long") * WIDTH + F.col("w")).alias("idx")
    return cells.select(idx, "v").filter(F.col("idx") < length)


def reduce_vector(part: DataFrame, length: int, partitions: int | None = -1) -> np.ndarray:
    """Driver-side sum of all partials (a vector of ``length``).

    What reaches the driver is bounded: uncombined partials only when the
    partition count is known without running anything and partitions x
    length <= DIRECT_COMBINE_VALUES, otherwise the shuffle-combined blocks
    (model-sized)."""
    nb = blocks_of(length)
    total = np.zeros((nb, WIDTH))
    parts = exchange_free_partitions(part) if partitions == -1 else partitions
    if parts is not None and parts * max(1, length) <= DIRECT_COMBINE_VALUES:
        table = part.toArrow()
        if table.num_rows:
            blk = table.column("blk").to_numpy()
            vals = np.stack([table.column(c).to_numpy() for c in _VALUE_COLS], axis=1)
            np.add.at(total, blk, vals)
    else:
        for row in combine(part).collect():
            total[row["blk"]] = [row[c] for c in _VALUE_COLS]
    return total.reshape(-1)[:length]


def partial_sums(df: DataFrame, columns: list, update: Callable, emit: Callable,
                 length: int) -> DataFrame:
    """Per-partition partials combined lazily, as ``(idx, v)`` rows."""
    return flat_values(partial_frame(df, columns, update, emit, length), length)


# ---------------------------------------------------------------------------
# Normal equations: X'X, X'Y, Y'Y, n in one pass
# ---------------------------------------------------------------------------

@dataclass
class Moments:
    n: float
    xx: np.ndarray | None   # d x d
    xy: np.ndarray | None   # d x k
    yy: np.ndarray | None   # k  (sum of y_c^2 per output)


def normal_equation_length(d: int, k: int = 1, with_label: bool = True,
                           with_xx: bool = True) -> int:
    """Layout: [X'X upper triangle | X'Y (d x k) | diag(Y'Y) (k) | n]."""
    return (d * (d + 1) // 2 if with_xx else 0) + ((d * k + k) if with_label else 0) + 1


def normal_equation_partials(df, features: str, d: int, label: str | None = None,
                             k: int = 1, label_kind: str = "scalar",
                             with_xx: bool = True, rows: RowMap | None = None) -> DataFrame:
    """One pass: X'X (upper triangle), X'Y, diag(Y'Y) and n per partition.
    ``label_kind``: 'scalar' (k=1), 'vector' (array<double> of length k) or
    'class' (int id one-hot encoded in the block, never a column). With ``rows``
    X is the mapped matrix (d its width)."""
    cols = [features] + ([label] if label else [])
    iu = np.triu_indices(d)

    def update(state, b):
        if state is None:
            state = [np.zeros((d, d)) if with_xx else None, np.zeros((d, k)), np.zeros(k), 0.0]
        y = None
        if label:
            if label_kind == "scalar":
                y = to_vector(b.column(label), label)[:, None]
            elif label_kind == "class":
                y = one_hot_block(to_vector(b.column(label), label), k)
            else:
                y = to_matrix(b.column(label), k, label)
            state[2] += (y * y).sum(axis=0)
        for lo, hi, x in pieces(b, features, d, rows):
            if with_xx:
                state[0] += x.T @ x
            if label:
                state[1] += x.T @ y[lo:hi]
        state[3] += b.num_rows
        return state

    def emit(state):
        xx, xy, yy, n = state
        parts = [xx[iu]] if with_xx else []
        if label:
            parts += [xy.reshape(-1), yy]
        parts.append(np.array([n]))
        return np.concatenate(parts)

    return partial_frame(df, cols, update, emit,
                         normal_equation_length(d, k, label is not None, with_xx))


def collect_moments(partials: DataFrame, d: int, k: int = 1, with_label: bool = True,
                    with_xx: bool = True, partitions: int | None = -1) -> Moments:
    """Driver side: the combined vector is model-sized (d²/2 + dk + k + 1)."""
    vec = reduce_vector(partials, normal_equation_length(d, k, with_label, with_xx), partitions)
    pos = 0
    xx = None
    if with_xx:
        iu = np.triu_indices(d)
        xx = np.zeros((d, d))
        m = iu[0].size
        xx[iu] = vec[:m]
        xx[(iu[1], iu[0])] = vec[:m]
        pos = m
    xy = yy = None
    if with_label:
        xy = vec[pos: pos + d * k].reshape(d, k)
        yy = vec[pos + d * k: pos + d * k + k]
        pos += d * k + k
    return Moments(n=float(vec[pos]), xx=xx, xy=xy, yy=yy)


def gram_full_partials(df, features: str, d: int) -> DataFrame:
    """Full X'X (d x d, row-major) per partition, for lazy long output."""

    def update(state, b):
        x = to_matrix(b.column(features), d, features)
        part = x.T @ x
        return part if state is None else state + part

    return partial_frame(df, [features], update, lambda st: st.reshape(-1), d * d)


# ---------------------------------------------------------------------------
# Matrix-free Gram products  X'X P  (P: d x k)
# ---------------------------------------------------------------------------

def gram_times_partials(df, features: str, d: int, p: np.ndarray, handle=None,
                        rows: RowMap | None = None) -> DataFrame:
    """X'X P per partition, row-major d x k; X is the mapped matrix with ``rows``."""
    p = np.asarray(p, dtype=np.float64).reshape(d, -1)
    handle = handle or ship(_session(df), p)

    def update(state, b):
        for _, _, x in pieces(b, features, d, rows):
            part = x.T @ (x @ handle.value)
            state = part if state is None else state + part
        return state

    return partial_frame(df, [features], update, lambda st: st.reshape(-1), p.size)


def gram_times(df: "DataFrame | Prepared", features: str, d: int, p: np.ndarray,
               rows: RowMap | None = None) -> np.ndarray:
    p = np.asarray(p, dtype=np.float64).reshape(d, -1)
    src = df if isinstance(df, Prepared) else prepare(df, [features], p.size)
    handle = ship(_session(src), p)
    try:
        part = gram_times_partials(src, features, d, p, handle, rows)
        return reduce_vector(part, p.size, src.partitions).reshape(p.shape)
    finally:
        release(handle)          # one broadcast per iteration, not one per fit


# ---------------------------------------------------------------------------
# Nearest-centre partial sums (one Lloyd step)
# ---------------------------------------------------------------------------

def _nearest_exact(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre by centre, explicit sums of squared differences; the first
    (lowest) index wins a tie."""
    best = np.full(x.shape[0], np.inf)
    arg = np.zeros(x.shape[0], dtype=np.int64)
    for c in range(centers.shape[0]):
        diff = x - centers[c]
        dist = np.einsum("ij,ij->i", diff, diff)
        better = dist < best
        best = np.where(better, dist, best)
        arg = np.where(better, c, arg)
    return arg, best


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (ties -> lowest index) and its exact
    squared distance.

    Candidates come from one GEMM, ||x||² - 2 x·c + ||c||². Rows whose two
    best candidates are closer than that expansion's rounding bound are
    re-decided with exact differences, so the assignment equals the exact
    centre-by-centre rule; the reported distance is always exact."""
    k, d = centers.shape
    if isinstance(x, SparseBlock):
        return _nearest_sparse(x, centers)
    if k < 2 or k * d < 256:
        return _nearest_exact(x, centers)
    xx = np.einsum("ij,ij->i", x, x)
    cc = np.einsum("ij,ij->i", centers, centers)
    approx = xx[:, None] - 2.0 * (x @ centers.T) + cc[None, :]
    two = np.partition(approx, 1, axis=1)[:, :2]
    bound = 8.0 * (d + 2) * np.finfo(np.float64).eps * (xx + cc.max())
    ambiguous = np.flatnonzero(two[:, 1] - two[:, 0] <= 2.0 * bound)
    arg = np.argmin(approx, axis=1)
    if ambiguous.size:
        arg[ambiguous] = _nearest_exact(x[ambiguous], centers)[0]
    diff = x - centers[arg]
    return arg, np.einsum("ij,ij->i", diff, diff)


def _nearest_sparse(x: SparseBlock, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`nearest_center`; rows that rounding leaves open are compared densely,
    a bounded chunk at a time."""
    k, d = centers.shape
    xx, cc = x.norms_sq(), np.einsum("ij,ij->i", centers, centers)
    approx = xx[:, None] - 2.0 * (x @ centers.T) + cc[None, :]
    arg = np.argmin(approx, axis=1)
    dist = np.maximum(approx[np.arange(len(x)), arg], 0.0)
    bound = 8.0 * (d + 2) * np.finfo(np.float64).eps * (xx + cc.max())
    two = np.partition(approx, 1, axis=1)[:, :2] if k > 1 else np.column_stack([dist, np.full(len(x), np.inf)])
    open_ = np.flatnonzero((two[:, 1] - two[:, 0] <= 2.0 * bound) | (dist <= 1e3 * bound))
    for lo, hi in row_chunks(len(open_), d):
        rows = np.vstack([x[i:i + 1].dense() for i in open_[lo:hi].tolist()])
        arg[open_[lo:hi]], dist[open_[lo:hi]] = _nearest_exact(rows, centers)
    return arg, dist


def centroid_partials(df, features: str, d: int, centers: np.ndarray, handle=None) -> DataFrame:
    """Layout: [per-cluster sums (k x d) | counts (k) | cost]."""
    k = centers.shape[0]
    handle = handle or ship(_session(df), np.asarray(centers, dtype=np.float64))

    def update(state, b):
        x = to_block(b.column(features), d, features)
        arg, dist = nearest_center(x, handle.value)
        if state is None:
            state = [np.zeros((k, d)), np.zeros(k), 0.0]
        if isinstance(x, SparseBlock):
            x.add_rows(state[0], arg)
        else:
            np.add.at(state[0], arg, x)
        state[1] += np.bincount(arg, minlength=k)
        state[2] += dist.sum()
        return state

    def emit(state):
        return np.concatenate([state[0].reshape(-1), state[1], [state[2]]])

    return partial_frame(df, [features], update, emit, k * d + k + 1)


def centroid_sums(df: "DataFrame | Prepared", features: str, d: int,
                  centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(per-cluster sums k x d, counts k, cost) over the whole frame."""
    k = centers.shape[0]
    length = k * d + k + 1
    src = df if isinstance(df, Prepared) else prepare(df, [features], length)
    handle = ship(_session(src), np.asarray(centers, dtype=np.float64))
    try:
        vec = reduce_vector(centroid_partials(src, features, d, centers, handle), length,
                            src.partitions)
    finally:
        release(handle)
    return vec[: k * d].reshape(k, d), vec[k * d: k * d + k], float(vec[-1])
