"""Vectorised hashing of words, shingles and byte windows over Arrow text columns.

A chunk is a run of whole documents of about ``CHUNK`` bytes (or one longer document), so memory is bounded by the
chunk or the longest document. Words are runs of bytes other than ASCII white space, A-Z lower-cased. Hashes are
polynomials modulo 2^64 over random byte codes, finished by a bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE2 = 0xC2B2AE3D27D4EB4F | 1
_INVERSE2 = pow(_BASE2, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for chunks of the usual size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = max(n, CHUNK + CHUNK // 4)
        have = np.full(m, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if m <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Give freed memory back to the system: Python processes live on beside a JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with release() at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Prefix:
    """Prefix polynomial of a byte string: the hash of any [start, end) in constant time. ``second``: by another base and
    other codes, for two hashes of which both must agree."""

    def __init__(self, data: np.ndarray, second: bool = False) -> None:
        code, base, inverse = (_CODE2, _BASE2, _INVERSE2) if second else (_CODE, _BASE, _INVERSE)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(code[data] * _power(base, len(data)), out=self.sums[1:])
        self.inverse = _power(inverse, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, q: int) -> np.ndarray:
        """Hash of every q bytes, by start."""
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


class Words:
    """The words of rows i..j: ``doc`` (row less i), ``start`` and ``end`` in ``data``; ``hash`` on demand.

    ``data`` is lower-cased, with one blank before, between and after the rows and every white space made a blank.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> None:
        rows, own = j - i, offsets[i : j + 1] - offsets[i]
        self.rows = rows
        raw = LOWER[data[offsets[i] : offsets[j]]]
        self.data = np.full(len(raw) + rows + 1, 0x20, np.uint8)
        self.data[np.arange(len(raw)) + np.repeat(np.arange(1, rows + 1), np.diff(own))] = raw
        space = _SPACE[self.data]
        self.data[space] = 0x20
        edge = np.diff(space.view(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        self.bounds = own + np.arange(rows + 1)  # the blank before each row
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(rows + 1))  # each row's first word
        self.prefix = None

    def hash(self) -> np.ndarray:
        self.prefix = self.prefix or Prefix(self.data)
        return self.prefix(self.start, self.end)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k-word shingle, rows ascending, repeats included.

    A row of one to k-1 words has one shingle, its whole sequence; a row without words has none.
    """
    h, doc, n = words.hash(), words.doc, np.diff(words.first)
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, np.uint64)
    for t in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[t : t + m]
    whole = doc[:m] == doc[k - 1 : k - 1 + m]
    rows, values = doc[:m][whole], mix(out[whole] + np.uint64(k))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for t in range(k - 1):
            at = np.minimum(words.first[short] + t, len(h) - 1)
            extra = np.where(t < n[short], extra * np.uint64(0xD6E8FEB86659FD93) + h[at], extra)
        rows, values = np.concatenate([rows, short]), np.concatenate([values, mix(extra + n[short].astype(np.uint64))])
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    return rows, values


def distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) pairs without repeats, sorted by row, then value."""
    order = np.argsort(values)
    order = order[np.argsort(rows[order].astype(np.uint16 if len(rows) and rows.max() < 65536 else np.int64), kind="stable")]
    rows, values = rows[order], values[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[new], values[new]
    return rows, values


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
