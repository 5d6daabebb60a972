"""Vectorised text kernels shared by the corpus operators (numpy over Arrow buffers).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  Those bytes never occur
inside a multi-byte UTF-8 sequence, so splitting bytes and splitting characters agree.
Texts are taken whole; work is cut into chunks of whole documents only to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE_BYTE = 0x9E3779B97F4A7C15 | 1
_BASE_WORD = 0xD1342543DE82EF95 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that stand between letter tokens: all of ASCII but letters and digits.
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = np.asarray(x, dtype=_U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown when needed."""

    def __init__(self, base: int) -> None:
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self._base), ("down", self._inverse)):
                row = np.full(size, base, dtype=_U)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE_BYTE), _Powers(_BASE_WORD)


def sums(values: np.ndarray, powers: _Powers = _WORD_POWERS) -> np.ndarray:
    """Prefix sums of values times powers; span_hash() turns two of them into a hash."""
    out = np.zeros(len(values) + 1, dtype=_U)
    up, _ = powers.upto(len(values) or 1)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers = _WORD_POWERS) -> np.ndarray:
    """A hash of values[start:end] that does not depend on where the span stands."""
    _, down = powers.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))


class Words:
    """The words of a chunk of documents.

    starts, ends: byte offsets in buf; first: for each document its first word's index,
    with the total appended, so document i owns words first[i]:first[i + 1].
    """

    __slots__ = ("buf", "doc_bytes", "ends", "first", "hashes", "starts")

    def __init__(self, buf: np.ndarray, doc_bytes: np.ndarray, *, lower: bool = False, hashed: bool = True, space: np.ndarray = _SPACE) -> None:
        if lower:
            buf = _LOWER[buf]
        self.buf, self.doc_bytes = buf, doc_bytes
        inside = ~space[buf]
        begin, end = inside.copy(), inside.copy()
        if len(buf):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            cuts = doc_bytes[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(buf))]
            begin[cuts[inside[cuts]]] = True
            last = cuts - 1
            end[last[inside[last]]] = True
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, doc_bytes)
        self.hashes = None
        if hashed:
            self.hashes = span_hash(sums(_BYTE_CODE[buf], _BYTE_POWERS), self.starts, self.ends, _BYTE_POWERS) if len(self.starts) else np.zeros(0, dtype=_U)

    def prefix_hashes(self, size: int) -> np.ndarray:
        """Hashes of each word's first `size` bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=_U)
        return span_hash(sums(_BYTE_CODE[self.buf], _BYTE_POWERS), self.starts, np.minimum(self.ends, self.starts + size), _BYTE_POWERS)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_null(column.type):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, offsets


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about `limit` bytes; nulls are empty."""
    if column.null_count:  # a null may own bytes in the buffer
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"") if not pa.types.is_null(column.type) else column
    buf, offsets = _buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, stop, buf[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    found = batch.column(batch.schema.get_field_index(name))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def binary_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column from one byte buffer and the end of each row's bytes."""
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = ends
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
