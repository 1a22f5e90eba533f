"""Compressed sparse rows inside kernels.

A sparse row is a column ``struct<size:int, indices:array<int>, values:array<double>>``
with ascending 0-based indices. A batch of them is one :class:`SparseBlock`: row
starts, indices and values, with the products the kernels use. Work and memory
follow the stored values. A block more than a quarter full is multiplied as a
dense chunk of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

SPARSE_ROW = StructType([StructField("size", IntegerType()), StructField("indices", ArrayType(IntegerType())),
                         StructField("values", ArrayType(DoubleType()))])
DENSE_FROM = 0.25            # part of stored values from which a chunk is multiplied densely
CHUNK_VALUES = 1 << 21       # values of an intermediate product


def is_sparse(df: DataFrame, features: str) -> bool:
    kind = df.schema[features].dataType
    return isinstance(kind, StructType) and kind.names == SPARSE_ROW.names


class _Transposed:
    """``block.T``: only its products are used."""

    def __init__(self, block: SparseBlock):
        self.block = block

    def __matmul__(self, other):
        return self.block.gram() if other is self.block else self.block.t_dot(np.asarray(other))


class SparseBlock:
    def __init__(self, starts: np.ndarray, indices: np.ndarray, values: np.ndarray, d: int):
        self.starts, self.indices, self.values, self.d = starts, indices, values, d
        self.shape = (len(starts) - 1, d)

    @classmethod
    def of(cls, column, d: int, name: str = "features") -> SparseBlock:
        """From an Arrow column of sparse rows, checked as dense rows are."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        size, index, value = (column.field(k) for k in range(3))
        if column.null_count or size.null_count or index.null_count or value.null_count:
            raise ValueError(f"{name}: null rows are not allowed")
        if len(column) and (np.asarray(size) != d).any():
            raise ValueError(f"{name}: rows of unequal length, expected {d}, found "
                             f"{int(np.min(np.asarray(size)))}..{int(np.max(np.asarray(size)))}")
        starts, other = index.offsets.to_numpy(), value.offsets.to_numpy()
        starts, other = starts - starts[:1], other - other[:1]
        if not np.array_equal(starts, other):
            raise ValueError(f"{name}: a sparse row has {'more' if starts[-1] > other[-1] else 'fewer'} indices than values")
        flat, values = index.flatten(), value.flatten()
        if flat.null_count or values.null_count:
            raise ValueError(f"{name}: null elements are not allowed")
        indices = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        values = values.to_numpy(zero_copy_only=False).astype(np.float64)
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        if len(indices) and (indices.min() < 0 or indices.max() >= d):
            raise ValueError(f"{name}: index outside [0, {d})")
        if ((np.diff(indices) <= 0) & (rows[1:] == rows[:-1])).any():
            raise ValueError(f"{name}: indices of a sparse row must ascend")
        return cls(starts.astype(np.int64), indices, values, d)

    def __getitem__(self, part: slice) -> SparseBlock:
        lo, hi, _ = part.indices(self.shape[0])
        a, b = self.starts[lo], self.starts[hi]
        return SparseBlock(self.starts[lo:hi + 1] - a, self.indices[a:b], self.values[a:b], self.d)

    def __len__(self) -> int:
        return self.shape[0]

    @property
    def T(self) -> _Transposed:
        return _Transposed(self)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.shape[0]), np.diff(self.starts))

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        out[self.rows, self.indices] = self.values
        return out

    def _full(self) -> bool:
        return len(self.values) > DENSE_FROM * self.shape[0] * self.d

    def _parts(self, width: int):
        """Slices of rows whose products hold about CHUNK_VALUES values."""
        if self._full():
            step = max(1, CHUNK_VALUES // max(1, self.d))
            for lo in range(0, self.shape[0], step):
                yield lo, self[lo:lo + step]
            return
        limit, lo = max(1, CHUNK_VALUES // max(1, width)), 0
        while lo < self.shape[0]:
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + limit, "right")) - 1)
            yield lo, self[lo:hi]
            lo = hi

    def __matmul__(self, p: np.ndarray) -> np.ndarray:
        flat = np.asarray(p, dtype=np.float64).reshape(self.d, -1)
        out = np.zeros((self.shape[0], flat.shape[1]))
        for lo, x in self._parts(flat.shape[1]):
            if x._full():
                out[lo:lo + len(x)] = x.dense() @ flat
            elif len(x.values):
                some = np.flatnonzero(np.diff(x.starts))
                out[lo + some] = np.add.reduceat(x.values[:, None] * flat[x.indices], x.starts[some], axis=0)
        return out.reshape((self.shape[0],) + np.shape(p)[1:])

    def t_dot(self, y: np.ndarray) -> np.ndarray:
        flat = y.reshape(self.shape[0], -1)
        out = np.zeros((self.d, flat.shape[1]))
        for lo, x in self._parts(flat.shape[1]):
            here = flat[lo:lo + len(x)]
            if x._full():
                out += x.dense().T @ here
            elif len(x.values):
                order = np.argsort(x.indices, kind="stable")
                index = x.indices[order]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1])
                out[index[cut]] += np.add.reduceat(x.values[order, None] * here[x.rows[order]], cut, axis=0)
        return out.reshape((self.d,) + y.shape[1:])

    def gram(self) -> np.ndarray:
        out = np.zeros((self.d, self.d))
        widest = int(np.diff(self.starts).max(initial=0))
        for _, x in self._parts(widest):
            if x._full():
                dense = x.dense()
                out += dense.T @ dense
                continue
            n = np.diff(x.starts)
            left = np.repeat(np.arange(len(x.values)), n[x.rows])              # every stored value with those of its row
            first = np.cumsum(n[x.rows]) - n[x.rows]
            right = np.arange(len(left)) - np.repeat(first - x.starts[x.rows], n[x.rows])
            np.add.at(out.reshape(-1), x.indices[left] * self.d + x.indices[right], x.values[left] * x.values[right])
        return out

    def norms_sq(self) -> np.ndarray:
        return np.bincount(self.rows, self.values ** 2, minlength=self.shape[0])

    def add_rows(self, out: np.ndarray, to: np.ndarray) -> None:
        """out[to[i]] += row i."""
        np.add.at(out, (to[self.rows], self.indices), self.values)

    def scaled(self, divisors: np.ndarray) -> SparseBlock:
        by = divisors[self.indices]
        return SparseBlock(self.starts, self.indices, np.divide(self.values, by, out=np.zeros_like(self.values), where=by != 0), self.d)
