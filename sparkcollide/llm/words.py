"""Words and word n-grams of Arrow text batches, as numpy arrays.

A text's words are the maximal runs of bytes other than space and ``\\t``..``\\r``.
Texts are handled whole, in chunks of about ``CHUNK`` bytes (a longer text makes a
longer chunk), so memory does not depend on the size of an Arrow batch.  Null
texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd, hence invertible modulo 2**64

_rng = np.random.default_rng(20240501)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that all 64 bits depend on all others."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, 0..n, modulo 2**64."""
    have = _powers.get(lane)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        out = []
        for b in (BASES[lane], pow(BASES[lane], -1, 2**64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[lane] = (out[0], out[1])
    return have[0][: n + 1], have[1][: n + 1]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Hash of values[start:end] for many spans: equal spans, equal hash."""
    n = len(values)
    pw, inv = powers(lane, n)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * pw[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U64))


class Chunk:
    """Consecutive rows ``lo:hi`` of a batch with their words."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        n = len(data)
        word = ~IS_SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | cut[1:n]
        last[:-1] &= ~word[1:] | cut[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: index of the first word of each row, and the end
        self.first = np.searchsorted(self.starts, offsets)

    def word_hash(self) -> np.ndarray:
        return span_hash(BYTE_VALUE[self.data], self.starts, self.ends, 0)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def chunks(column: pa.Array, lower: bool = False) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts."""
    column = pc.fill_null(column, "") if column.null_count else column
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1)
        part = data[offs[lo] : offs[hi]]
        yield Chunk(lo, hi, LOWER[part] if lower else part, offs[lo : hi + 1] - offs[lo])
        lo = hi


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs."""
    return h.view(np.int64)
