"""Words, lines and 64-bit word hashes of whole texts, vectorised over Arrow batches.

A word is a maximal run of characters other than space and U+0009..U+000D.
Texts travel as UTF-8 bytes (``cast('binary')``), so nothing is decoded and
malformed UTF-8 cannot stop a task.  Work is cut into chunks of about
``CHUNK_BYTES`` between texts; a longer text forms a chunk of its own and is
processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CONT = np.zeros(256, dtype=bool)
_CONT[0x80:0xC0] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = _BASE_INV
        _inverse = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverse


class Chunk:
    """Some whole texts laid end to end, with the spans of their words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf = _LOWER[buf] if lower else buf
        self.offsets = offsets
        self.n = len(offsets) - 1
        self._sums: np.ndarray | None = None
        inside = ~_WHITE[self.buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = edge[edge > 0] - 1
        last[edge] = inside[edge]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand."""
        powers, inverse = _power_tables(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODE[self.buf] * powers[: len(self.buf)], out=self._sums[1:])
        value = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        """Per text: how many of its bytes the boolean table of 256 entries marks."""
        sums = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.cumsum(table[self.buf], out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def code_points(self) -> np.ndarray:
        return self.count_bytes(~_CONT)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_doc(self, values: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc if doc is None else doc, weights=values, minlength=self.n)


def white_table() -> np.ndarray:
    return _WHITE.copy()


def continuation_table() -> np.ndarray:
    return _CONT.copy()


def binary_views(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (as int64) of an Arrow binary column without nulls."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column, lower: bool = False) -> Iterator[tuple[int, int, Chunk]]:
    """``(first row, end row, Chunk)`` over a whole binary column."""
    n = len(column)
    if not n:
        return
    raw, offsets = binary_views(column)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, Chunk(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j
