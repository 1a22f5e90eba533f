"""The 48-bit linear congruential generator specified for java.util.Random.

The random feature maps must reproduce features drawn with fixed seeds by
a JVM program, so the draws follow the published java.util.Random
algorithm exactly. Draws are produced in numpy blocks (the LCG is advanced
by jump-ahead), so drawing millions of values costs milliseconds.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the java.util.Random specification.
MULTIPLIER = 0x5DEECE66D
ADDEND = 0xB
MASK = (1 << 48) - 1
DOUBLE_UNIT = 2.0 ** -53

_BLOCK = 1024


def _jump(steps: int) -> tuple[int, int]:
    """Coefficients (A, C) with state_{i+steps} = A*state_i + C (mod 2^48)."""
    a, c = 1, 0
    base_a, base_c = MULTIPLIER, ADDEND
    while steps:
        if steps & 1:
            a, c = (a * base_a) & MASK, (c * base_a + base_c) & MASK
        base_a, base_c = (base_a * base_a) & MASK, (base_c * base_a + base_c) & MASK
        steps >>= 1
    return a, c


_JUMP_A, _JUMP_C = _jump(_BLOCK)


class JavaRandom:
    """Stateful generator with java.util.Random semantics."""

    def __init__(self, seed: int):
        self.state = (int(seed) ^ MULTIPLIER) & MASK
        self._next_gaussian: float | None = None

    # -- raw states ------------------------------------------------------
    def _states(self, count: int) -> np.ndarray:
        """The next ``count`` 48-bit states, advancing the generator."""
        out = np.empty(count, dtype=np.uint64)
        if count == 0:
            return out
        first = np.empty(min(count, _BLOCK), dtype=np.uint64)
        s = self.state
        for i in range(first.size):
            s = (s * MULTIPLIER + ADDEND) & MASK
            first[i] = s
        out[: first.size] = first
        pos = first.size
        prev = first
        ja, jc, mask = np.uint64(_JUMP_A), np.uint64(_JUMP_C), np.uint64(MASK)
        while pos < count:
            # uint64 products wrap mod 2^64, which keeps the low 48 bits exact
            block = (prev * ja + jc) & mask
            take = min(_BLOCK, count - pos)
            out[pos: pos + take] = block[:take]
            pos += take
            prev = block
        self.state = int(out[-1])
        return out

    def _next_bits(self, bits: int, count: int) -> np.ndarray:
        return (self._states(count) >> np.uint64(48 - bits)).astype(np.int64)

    # -- public draws ----------------------------------------------------
    def next_doubles(self, count: int) -> np.ndarray:
        st = self._states(2 * count)
        hi = (st[0::2] >> np.uint64(22)).astype(np.int64)
        lo = (st[1::2] >> np.uint64(21)).astype(np.int64)
        return ((hi << 27) + lo).astype(np.float64) * DOUBLE_UNIT

    def next_ints(self, bound: int, count: int) -> np.ndarray:
        if bound <= 0:
            raise ValueError("bound must be positive")
        if bound & (bound - 1) == 0:
            r = self._next_bits(31, count)
            return ((bound * r) >> 31).astype(np.int64)
        out = np.empty(count, dtype=np.int64)
        filled = 0
        while filled < count:
            need = count - filled
            saved = self.state
            bits = self._next_bits(31, need + need // 32 + 8)
            vals = bits % bound
            # the 32-bit overflow test of the specification rejects a draw
            ok = np.flatnonzero(bits - vals + (bound - 1) < 2 ** 31)[:need]
            # rewind, then consume exactly the draws up to the last one used
            # (rejected draws after it are drawn, and rejected, again)
            self.state = saved
            self._states(int(ok[-1]) + 1 if ok.size else bits.size)
            out[filled: filled + ok.size] = vals[ok]
            filled += ok.size
        return out

    def next_gaussians(self, count: int) -> np.ndarray:
        out = np.empty(count, dtype=np.float64)
        filled = 0
        if count and self._next_gaussian is not None:
            out[0] = self._next_gaussian
            self._next_gaussian = None
            filled = 1
        while filled < count:
            need_pairs = (count - filled + 1) // 2
            attempts = int(need_pairs / 0.78) + 8
            saved_state = self.state
            u = self.next_doubles(2 * attempts)
            v1 = 2.0 * u[0::2] - 1.0
            v2 = 2.0 * u[1::2] - 1.0
            s = v1 * v1 + v2 * v2
            ok = np.flatnonzero((s < 1.0) & (s != 0.0))
            if ok.size == 0:
                continue
            # consume exactly up to the last attempt we use
            use = ok[:need_pairs]
            last_attempt = int(use[-1])
            self.state = saved_state
            self._states(4 * (last_attempt + 1))
            ss = s[use]
            mult = np.sqrt(-2.0 * np.log(ss) / ss)
            g = np.empty(2 * use.size, dtype=np.float64)
            g[0::2] = v1[use] * mult
            g[1::2] = v2[use] * mult
            take = min(g.size, count - filled)
            out[filled: filled + take] = g[:take]
            filled += take
            if take < g.size:
                self._next_gaussian = float(g[take])
        return out
