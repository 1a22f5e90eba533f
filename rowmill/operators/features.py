"""Random feature maps.

* RBF random Fourier features: phi(x) = sqrt(2/s)·cos(Z x + v), Z (s x d)
  i.i.d. N(0,1)/sigma, v (s) i.i.d. U[0, 2π). Drawn once on the driver
  (java.util.Random semantics by default, so features equal those of a
  JVM program using the same seeds), shipped to tasks, applied per Arrow
  batch as one GEMM. Row-local: no shuffle.
* Count sketch: bucket h(j) in [0, s) and sign in {-1, +1} per input index,
  phi_i(x) = Σ_{j: h(j) = i} sign(j)·x_j. Applied row-locally to a sparse
  ``map<int,double>`` row with array higher-order functions (JVM side), so
  a row without entries still yields the zero vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import JavaRandom
from . import blocks
from .sparse import SparseBlock

# Fixed seeds and constant of the original random feature maps.
RFF_SEED_Z = 1234
RFF_SEED_V = 4321
SKETCH_SEED = 1234
TWO_PI = 6.283185307179586


def rff_params(d: int, s: int, sigma: float, rng: str = "java48",
               seed_z: int = RFF_SEED_Z, seed_v: int = RFF_SEED_V) -> tuple[np.ndarray, np.ndarray]:
    """(Z, v). Z is filled column by column (input index outer, output
    index inner), as the original draws it."""
    if rng == "java48":
        g = JavaRandom(seed_z).next_gaussians(s * d)
        u = JavaRandom(seed_v).next_doubles(s)
    else:
        g = np.random.default_rng(seed_z).standard_normal(s * d)
        u = np.random.default_rng(seed_v).random(s)
    z = g.reshape(d, s).T / sigma
    return z, u * TWO_PI


class FourierMap(blocks.RowMap):
    """sqrt(2/s)·cos(Z x + v) as a row map of the fits' kernels."""

    def __init__(self, spark, z: np.ndarray, v: np.ndarray):
        self.s, self.d = z.shape
        self._sent = blocks.ship(spark, np.vstack([z.T, v[None, :]]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        zt_v = self._sent.value
        phi = x @ zt_v[:self.d]
        phi += zt_v[self.d]
        np.cos(phi, out=phi)
        phi *= math.sqrt(2.0 / self.s)
        return phi

    def release(self) -> None:
        blocks.release(self._sent)


class ScaleMap(blocks.RowMap):
    """x_j / m_j as a row map; a zero divisor gives 0. Sparse rows stay sparse."""

    def __init__(self, spark, divisors):
        m = np.asarray(divisors, dtype=np.float64)
        self.s = self.d = m.size
        self._sent = blocks.ship(spark, m)

    def __call__(self, x):
        m = self._sent.value
        if isinstance(x, SparseBlock):
            return x.scaled(m)
        return np.divide(x, m, out=np.zeros_like(x), where=m != 0)

    def release(self) -> None:
        blocks.release(self._sent)


def fourier_map(spark, d: int, s: int, sigma: float, rng: str = "java48") -> FourierMap:
    return FourierMap(spark, *rff_params(d, s, sigma, rng))


def rbf_random_features(df: DataFrame, features: str, d: int, s: int, sigma: float,
                        keep: list[str] | None = None, out: str = "features",
                        rng: str = "java48") -> DataFrame:
    z, v = rff_params(d, s, sigma, rng)
    return apply_rff(df, features, z, v, keep, out)


def apply_rff(df: DataFrame, features: str, z: np.ndarray, v: np.ndarray,
              keep: list[str] | None = None, out: str = "features") -> DataFrame:
    s, d = z.shape
    keep = [c for c in (keep or []) if c != out]
    phi_of = FourierMap(df.sparkSession, z, v)
    src = df.select(*keep, features)
    kept = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] +
                       [f"`{out}` array<double>"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            for lo, hi, phi in blocks.pieces(b, features, s, phi_of):
                cols = {name: b.column(name).slice(lo, hi - lo) for name in keep}
                cols[out] = blocks.list_array(phi)
                yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(run, schema)


def sketch_params(d: int, s: int, seed: int = SKETCH_SEED) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) per input index: d bucket draws, then d sign draws,
    from one generator."""
    r = JavaRandom(seed)
    h = r.next_ints(s, d)
    sign = r.next_ints(2, d) * 2 - 1
    return h, sign


def count_sketch(df: DataFrame, sparse: str, d: int, s: int, keep: list[str] | None = None,
                 out: str = "features", seed: int = SKETCH_SEED) -> DataFrame:
    """``sparse`` is a map<int,double> row (index in [0, d)); output is the
    dense s-vector. Indices outside [0, d) fail the query."""
    h, sign = sketch_params(d, s, seed)
    return _count_sketch_arrow(df, sparse, d, s, h, sign, keep or [], out)


def _count_sketch_arrow(df, sparse, d, s, h, sign, keep, out):
    """Row-local scatter-add per Arrow batch with shipped (bucket, sign)."""
    handle = blocks.ship(df.sparkSession, np.stack([h.astype(np.float64), sign.astype(np.float64)]))
    src = df.select(*keep, sparse)
    kept = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] +
                       [f"`{out}` array<double>"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            col = b.column(sparse)
            if isinstance(col, pa.ChunkedArray):
                col = col.combine_chunks()
            offsets = col.offsets.to_numpy()
            keys = col.keys.to_numpy(zero_copy_only=False).astype(np.int64)
            vals = col.items.to_numpy(zero_copy_only=False).astype(np.float64)
            lo, hi = offsets[0], offsets[-1]
            keys, vals = keys[lo:hi], vals[lo:hi]
            if keys.size and (keys.min() < 0 or keys.max() >= d):
                raise ValueError(f"{sparse}: index outside [0, {d})")
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            table = handle.value
            phi = np.zeros((b.num_rows, s))
            np.add.at(phi, (row, table[0, keys].astype(np.int64)), vals * table[1, keys])
            cols = {name: b.column(name) for name in keep}
            cols[out] = blocks.list_array(phi)
            yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(run, schema)
