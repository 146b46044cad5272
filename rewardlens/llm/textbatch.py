"""Whole texts of Arrow batches as numpy arrays: bytes, words and their hashes.

Everything here works on one slice of rows at a time, cut so that its text
stays under ``SLICE_BYTES`` (or is a single row), which bounds a task's memory
by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` text bytes, or one row."""
    _, offs = text_buffer(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: byte ranges, and where each row's words begin."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        word = ~IS_SPACE[buf]
        begins = np.zeros(len(buf) + 1, bool)
        begins[offs] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | begins[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | begins[1:-1]
        self.buf, self.is_word = buf, word
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: index of each row's first word, and the total at the end
        self.row = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    def array(self) -> pa.Array:
        """The words as an Arrow string array."""
        off = np.zeros(len(self.start) + 1, np.int32)
        np.cumsum(self.end - self.start, out=off[1:])
        return pa.Array.from_buffers(pa.string(), len(self.start), [None, pa.py_buffer(off), pa.py_buffer(self.buf[self.is_word])])

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit polynomial hash of each word's bytes."""
        n = len(self.buf)
        total = np.zeros(n + 1, U64)
        np.cumsum((self.buf.astype(U64) + U64(1)) * powers(BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(BASE_INVERSE, n + 1)[self.start])


_POWERS: dict[int, np.ndarray] = {}
#: Longest run of powers that a Python worker keeps between slices.
KEPT_POWERS = (1 << 20) + 1


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    kept = _POWERS.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.full(max(n, KEPT_POWERS), base, U64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if len(out) == KEPT_POWERS:
        _POWERS[base] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (rows not told apart)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out = out * U64(BASE) + h[i:i + m]
    return mix(out)


def inside_row(row: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the run of ``n`` words from each position stays in one row."""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    for b in np.unique(row[1:-1]):
        ok[max(0, b - n + 1):min(b, m)] = False
    return ok
