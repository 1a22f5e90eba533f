"""Vectorised word handling inside Spark tasks.

A text column of an Arrow batch is one byte buffer plus offsets. These
helpers find words by byte class and give each word a 64-bit hash without a
Python loop over words. Batches are cut by bytes first, so memory follows
``CHUNK_BYTES`` (or the one longest text), not the batch's row count.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

# Workers live through many tasks: arrays of 256 kB or more go back to the system
# when freed, instead of staying with the allocator (glibc option M_MMAP_THRESHOLD).
if hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(-3, 1 << 18)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NON_WHITE = ~WHITE                        # words [^\x20\x09-\x0D]+
ALNUM = np.zeros(256, bool)               # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once lower-cased
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LONG_WORD = 128
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2 ** 64 - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64); returns a new array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null is the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    if data is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of at most ``limit`` text bytes (one row at least)."""
    buf, offs = text_buffer(batch.column(column))
    n, at = batch.num_rows, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n)
        yield batch.slice(at, end - at), buf[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
        at = end


class Words:
    """Words of several texts: byte spans, the text of each, 64-bit hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, inside: np.ndarray, lower: bool):
        if lower:
            buf = LOWER[buf]
        self.buf, self.offs = buf, offs
        self._spans(inside[buf])

    def _spans(self, flag: np.ndarray) -> None:
        n, offs = len(self.buf), self.offs
        edge = np.zeros(n + 1, bool)
        edge[offs] = True                          # texts separate words
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, flag
        now = np.empty(n + 1, bool)
        now[:n], now[n] = flag, False
        self.starts = np.flatnonzero(now & (~before | edge))
        self.ends = np.flatnonzero(before & (~now | edge))
        self.doc = np.searchsorted(offs, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offs)       # word range of text i: first[i]:first[i+1]
        self.counts = np.diff(self.first)

    @classmethod
    def flagged(cls, buf: np.ndarray, offs: np.ndarray, flag: np.ndarray) -> Words:
        """Words of the bytes whose flag is set."""
        self = cls.__new__(cls)
        self.buf, self.offs = buf, offs
        self._spans(flag)
        return self

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time for all spans at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > LONG_WORD)
    todo = np.flatnonzero(size <= LONG_WORD) if len(long) else None
    s, left, k = (starts, size, 0) if todo is None else (starts[todo], size[todo], 0)
    part = h if todo is None else h[todo]
    live = np.arange(len(s))
    while len(live):
        lane = lanes[s[live] + k] & _TAIL[np.minimum(left[live] - k, 8)]
        part[live] = mix((part[live] ^ lane) * np.uint64(0xD6E8FEB86659FD93))
        k += 8
        live = live[left[live] > k]
    if todo is not None:
        h[todo] = part
        for i in long.tolist():
            digest = hashlib.blake2b(buf[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
            h[i] = int.from_bytes(digest, "little")
    return h


def windows(w: np.ndarray, n: int, mult: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (by doubling)."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    out, done, power, bit = None, 0, w, 1
    m = np.uint64(mult | 1)
    with np.errstate(over="ignore"):
        while True:
            if n & bit:
                if out is None:
                    out, done = power, bit
                else:
                    out = out[:len(w) - done - bit + 1] * _pow(m, bit) + power[done:done + len(w) - done - bit + 1]
                    done += bit
            if done == n:
                break
            power = power[:-bit] * _pow(m, bit) + power[bit:]
            bit *= 2
    return mix(out)


def _pow(m: np.uint64, e: int) -> np.uint64:
    return np.uint64(pow(int(m), e, 1 << 64))


MULT_A, MULT_B = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


def code_points(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code points of each text (UTF-8 bytes that do not continue another)."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
