"""Row matrices in array files: ``.npy`` shards read by row range.

``write_array_files`` makes a folder of shards, one a task: ``part-N.npy`` (rows x d,
float64) and ``part-N.ids.npy``, in ascending order of id over all shards, and a
``manifest`` table with the rows of each. ``read_array_files`` plans ranges of rows
over the shards, and every task maps the part of the file that it was given: a
scan of some rows reads those rows alone.

The folder must be mounted where tasks run (a local path under ``local[*]``, a
shared one on a cluster); other schemes than ``file:`` are refused. A shard takes
its name only when it is whole, so a lost task leaves nothing half written behind.
Null rows, null elements and rows of another length fail the write; a null id is
not allowed; an empty matrix gives no shards.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import blocks

FORMAT = "rowmill_array"
SPLIT_ROWS = 1 << 16
BATCH_ROWS = 1 << 12


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: array files are mapped from a mounted folder, not from another store")
    return path


def write_array_files(df: DataFrame, path: str, d: int, features: str = "features", id_col: str = "id",
                      shards: int | None = None) -> None:
    folder = _local(path)
    ordered = df.select(F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"))
    spark = df.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(shards, "id").sortWithinPartitions("id")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}"
        own = os.path.join(folder, f"_{name}-{task.taskAttemptId()}")
        os.makedirs(folder, exist_ok=True)
        rows, low, high = 0, None, None
        with open(own + ".raw", "wb") as out, open(own + ".ids", "wb") as ids:
            for b in batches:
                if b.num_rows == 0:
                    continue
                if b.column("id").null_count:
                    raise ValueError(f"{id_col}: null ids are not allowed")
                x = np.ascontiguousarray(blocks.to_matrix(b.column("x"), d, features))
                at = b.column("id").to_numpy()
                out.write(x.tobytes())
                ids.write(at.tobytes())
                low, high = (int(at[0]) if low is None else low), int(at[-1])
                rows += b.num_rows
        for raw, shape, kind, end in ((own + ".raw", (rows, d), "<f8", ".npy"), (own + ".ids", (rows,), "<i8", ".ids.npy")):
            with open(own + end, "wb") as out:
                np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": shape})
                with open(raw, "rb") as data:
                    while piece := data.read(1 << 24):
                        out.write(piece)
            os.remove(raw)
            os.replace(own + end, os.path.join(folder, name + end))
        if rows:
            yield pa.RecordBatch.from_pydict({"shard": [name], "rows": pa.array([rows], pa.int64()),
                                              "d": pa.array([d], pa.int32()), "low": pa.array([low], pa.int64()),
                                              "high": pa.array([high], pa.int64())})

    ordered.mapInArrow(write, "shard string, rows long, d int, low long, high long").write.parquet(f"{path}/manifest")


class _Range(InputPartition):
    def __init__(self, shard: str, lo: int, hi: int):
        super().__init__((shard, lo, hi))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, ranges: list[tuple[str, int, int]]):
        self.folder, self.ranges = folder, ranges

    def partitions(self):
        return [_Range(*r) for r in self.ranges] or [_Range("", 0, 0)]

    def read(self, partition):
        shard, lo, hi = partition.value
        if not shard:
            return
        x = np.load(os.path.join(self.folder, shard + ".npy"), mmap_mode="r")
        ids = np.load(os.path.join(self.folder, shard + ".ids.npy"), mmap_mode="r")
        for a in range(lo, hi, BATCH_ROWS):
            b = min(hi, a + BATCH_ROWS)
            part = np.ascontiguousarray(x[a:b])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)),
                                            pa.array(part.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids[a:b])), flat], names=["id", "features"])


class ArrayFiles(DataSource):
    """Options: ``path``, and ``ranges`` as ``shard:lo:hi`` joined by commas."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "id bigint, features array<double>"

    def reader(self, schema):
        ranges = [r.rsplit(":", 2) for r in self.options.get("ranges", "").split(",") if r]
        return _Reader(_local(self.options["path"]), [(s, int(lo), int(hi)) for s, lo, hi in ranges])


def plan_ranges(shards: list[tuple[str, int]], first: int, last: int | None, split_rows: int) -> list[tuple[str, int, int]]:
    """Ranges of rows ``first`` (from 0) up to ``last`` (not with it) of the whole matrix, per shard."""
    out, at = [], 0
    for name, rows in shards:
        lo, hi = max(first - at, 0), rows if last is None else min(rows, last - at)
        out += [(name, a, min(hi, a + split_rows)) for a in range(lo, max(hi, lo), split_rows)]
        at += rows
    return out


def read_array_files(spark: SparkSession, path: str, first: int = 0, last: int | None = None,
                     split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``(id, features)`` of rows ``first`` up to ``last`` in order of id."""
    if first < 0 or (last is not None and last < first):
        raise ValueError(f"rows {first} to {last} are no range")
    spark.dataSource.register(ArrayFiles)
    manifest = spark.read.schema("shard string, rows long, d int, low long, high long").parquet(f"{path}/manifest")
    shards = sorted((r["shard"], r["rows"]) for r in manifest.select("shard", "rows").collect())     # one row a shard
    ranges = ",".join(f"{s}:{lo}:{hi}" for s, lo, hi in plan_ranges(shards, first, last, split_rows))
    return spark.read.format(FORMAT).option("path", path).option("ranges", ranges).load()
