"""Vectorised text handling shared by the operators of this folder.

Texts arrive as Arrow string columns.  Everything here works on the UTF-8
buffer of such a column with numpy, so no Python object is made per word.

A *word* is a maximal run of ASCII letters, digits and bytes above 127 of the
lower-cased text (SQL: ``regexp_extract_all(lower(text), WORD_RE)``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words for engines with regular expressions, after lower().
WORD_RE = r"[^\x00-/:-`{-\x7f]+"

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _a, _b in ((48, 58), (97, 123), (65, 91)):
    _IS_WORD[_a:_b] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """The powers of _P and of its inverse modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, n.bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (_P, _P_INVERSE)]
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(column) else raw[:0], off - off[0]


def slices(column: pa.Array, max_bytes: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about max_bytes each; a longer row stands alone."""
    n = len(column)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    start = 0
    while start < n:
        base = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, base + max_bytes, side="right")))
        yield start, stop
        start = stop


class Words:
    """The words of some rows: hash, row, and byte range of each, in order."""

    def __init__(self, column: pa.Array):
        self.rows = len(column)
        raw, off = utf8(pc.utf8_lower(column))
        self.raw, self.offsets = raw, off
        mask = _IS_WORD[raw]
        inner = off[1:-1]
        starts_mask = mask.copy()
        starts_mask[1:] &= ~mask[:-1]
        ends_mask = mask.copy()
        ends_mask[:-1] &= ~mask[1:]
        inner = inner[(inner > 0) & (inner < len(raw))]
        starts_mask[inner] = mask[inner]
        ends_mask[inner - 1] = mask[inner - 1]
        self.start = np.flatnonzero(starts_mask)
        self.end = np.flatnonzero(ends_mask) + 1
        self.row = np.searchsorted(off, self.start, side="right") - 1
        #: the words of row i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, off)
        self._total = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(raw * _power_tables(len(raw) + 1)[0][: len(raw)], out=self._total[1:])
        self.hash = self.hash_of(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial of the bytes of each range, from prefix sums over the buffer, scrambled."""
        with np.errstate(over="ignore"):
            value = (self._total[end] - self._total[start]) * _power_tables(len(self.raw) + 1)[1][start]
        return mix64(value + (end - start).astype(np.uint64))

    def texts(self, index: np.ndarray) -> list[str]:
        raw = self.raw.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.start[index].tolist(), self.end[index].tolist())]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def windows_of(values: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive values inside a row, and the index of the first value of each."""
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = values[: len(values) - n + 1].copy()
        for k in range(1, n):
            h = mix64(h * np.uint64(0x100000001B3) + values[k : len(values) - n + 1 + k])
    ok = np.ones(len(h), dtype=bool)
    for k in range(1, n):  # a window may not pass the start of the next row
        cut = first[1:-1] - k
        cut = cut[(cut >= 0) & (cut < len(h))]
        ok[cut] = False
    index = np.flatnonzero(ok)
    return h[index], index
