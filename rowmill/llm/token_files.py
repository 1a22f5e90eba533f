"""Token ids as Arrow files of equal-length sequences.

Documents are dealt by id range and sorted, so file k holds the ids before
file k + 1. A file is one task's token stream cut into sequences of ``LENGTH``:
record batches with a fixed-size-list column of ids (the smallest unsigned type
that holds the vocabulary) and one of masks; only the last sequence of a file
is padded, where the mask is false. Buffers are not compressed: any sequence is
a view into the mapped file. A second file lists the documents of the first.

Files are written through Arrow's file systems to the shared folder; each
attempt of a task writes its own name and only names that a finished task
returned are ever read, so lost executors and retries leave no wrong ids.

Defined results: null text is the empty text (its end id alone); a null id
sorts first; repeated ids stand side by side, by text; empty table, no file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.common import packed, parts, ship_package, written
from rowmill.llm.text import chunks
from rowmill.llm.tokens import encoder, vocabulary
from rowmill.session import scratch_path

LENGTH = 2048
BATCH = 256                 # sequences in a record batch


def _open(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def schema(size: int, length: int) -> pa.Schema:
    kind = pa.uint16() if size <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def _batch(form: pa.Schema, ids: np.ndarray, length: int) -> pa.RecordBatch:
    rows = -(-len(ids) // length)
    kind = form.field("ids").type.value_type
    flat = np.zeros(rows * length, kind.to_pandas_dtype())
    flat[:len(ids)] = ids
    mask = np.arange(rows * length) < len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(flat), length),
         pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=form)


def _write(batches, sent, folder: str, end_id: int, length: int):
    """One pair of files for this task; yields its name and counts."""
    enc = encoder(sent.value)
    form = schema(enc.size, length)
    task = TaskContext.get()
    name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
    system, path = _open(name)
    out = writer = listing = None
    held, tokens, docs = [], 0, 0
    listed = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    full = BATCH * length
    for batch in batches:
        for rows, buf, offs in chunks(batch, "text"):
            if writer is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path + ".ids.arrow")
                writer = pa.ipc.new_file(out, form)
                out2 = system.open_output_stream(path + ".docs.arrow")
                listing = pa.ipc.new_file(out2, listed)
            ids, counts = enc.encode(buf, offs)
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            listing.write_batch(pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(tokens + np.cumsum(counts) - counts), pa.array(counts)], schema=listed))
            tokens += len(ids)
            docs += len(counts)
            held.append(ids)
            if sum(map(len, held)) >= full:
                flat = np.concatenate(held)
                whole = len(flat) // full * full
                for a in range(0, whole, full):
                    writer.write_batch(_batch(form, flat[a:a + full], length))
                held = [flat[whole:]]
    if writer is None:
        return
    if sum(map(len, held)):
        writer.write_batch(_batch(form, np.concatenate(held), length))
    for f in (writer, out, listing, out2):
        f.close()
    pa.default_memory_pool().release_unused()
    yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]),
                                      pa.array([tokens], pa.int64()), pa.array([docs], pa.int64())],
                                     names=["part", "name", "n_tokens", "n_docs"])


class TokenFile:
    """Random access to the sequences of one file, without copies where it can be mapped."""

    def __init__(self, name: str):
        system, path = _open(name + ".ids.arrow")
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        b = self.reader.get_batch(k)
        return b.column("ids").flatten().to_numpy(), b.column("mask").flatten()

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence ``i``."""
        ids, mask = self.batch(i // BATCH)
        a = i % BATCH * self.length
        return ids[a:a + self.length], mask.slice(a, self.length).to_numpy(zero_copy_only=False)

    def documents(self, listing: pa.Table) -> Iterator[np.ndarray]:
        """Ids of each listed document, one record batch of the file at a time."""
        per = BATCH * self.length
        at, now = -1, np.zeros(0, np.uint16)
        for start, n in zip(listing.column("start").to_pylist(), listing.column("n_tokens").to_pylist(), strict=True):
            got = []
            while n:
                if start // per != at:
                    at = start // per
                    now = self.batch(at)[0]
                piece = now[start % per:start % per + n]
                got.append(piece)
                start += len(piece)
                n -= len(piece)
            yield got[0] if len(got) == 1 else np.concatenate(got)


def _read(batches):
    for batch in batches:
        for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
            system, path = _open(name + ".docs.arrow")
            with system.open_input_file(path) as f:
                listing = pa.ipc.open_file(f).read_all()
            tokens = TokenFile(name)
            crc = [zlib.crc32(ids.astype("<u4")) for ids in tokens.documents(listing)]
            tokens.source.close()
            table = pa.table({"id": listing.column("id"), "start": pa.array(listing.column("start").to_numpy() + base),
                              "n_tokens": listing.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})
            yield from table.to_batches(max_chunksize=10_000)
            pa.default_memory_pool().release_unused()


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str | None = None,
                 length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns ``(part, name, n_tokens, n_docs)``, a row per file."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    folder = folder or scratch_path(spark, "tokens")
    d = packed(docs, id_col, text_col).select("id", "text")
    rows = d.repartitionByRange(parts(spark), "id").sortWithinPartitions("id", "text")
    return written(rows.mapInArrow(lambda it: _write(it, sent, folder, end_id, length),
                                   "part int, name string, n_tokens long, n_docs long"), "token-files")


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, read back from the files."""
    names = files.orderBy("part").collect()                 # one row per file
    rows, base = [], 0
    for r in names:
        rows.append((r["name"], base))
        base += r["n_tokens"]
    listed = spark.createDataFrame(rows, "name string, base long")
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")
