"""Words, word hashes and n-gram hashes of whole Arrow text columns, as numpy arrays.

Hashes have 64 bits: polynomial over a word's bytes, then mixed. All functions take a column in slices
of about ``SLICE`` bytes, so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from plumbline.llm.common import process_state

SLICE = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_table(base: int, n: int) -> np.ndarray:
    tables = process_state()
    table = tables.get(f"powers-{base}")
    if table is None or len(table) < n:
        size = max(n, SLICE + 1)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        tables[f"powers-{base}"] = table
    return table[:n]


def _flags(pattern) -> np.ndarray:
    return np.array([bool(pattern(b)) for b in range(256)])


#: Bytes of words after lower-casing: no ASCII white space; and letters, digits, all of non-ASCII.
NOT_SPACE = _flags(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALPHANUMERIC = _flags(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[0x41:0x5B] += 32


def strings_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings that lie at [start, end) of UTF-8 bytes."""
    bounds = np.concatenate([[0], np.cumsum(end - start)])
    at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], end - start)
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at].tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(start), buffers)


@dataclass
class Words:
    """The words of rows ``first`` to ``first + rows``: hashes, and where each row's words begin."""

    first: int
    rows: int
    hashes: np.ndarray
    bounds: np.ndarray  # rows + 1 word numbers


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets into them) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sums of all beginnings of ``data``, one longer than it."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(data)), out=sums[1:])
    return sums


def inverse_powers(n: int) -> np.ndarray:
    """What a difference of prefix sums is multiplied with, by its first place, to forget the place."""
    return _power_table(_INVERSE, n)


def hash_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every range [start, end) of bytes or code points."""
    sums = prefix_sums(data)
    rolled = (sums[end] - sums[start]) * inverse_powers(len(data) + 1)[start]
    return mix(rolled + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(column: pa.Array, word_bytes: np.ndarray, lower: bool = True) -> Iterator[Words]:
    for first, rows, data, offsets in text_slices(column):
        if lower:
            data = _TO_LOWER[data]
        inside = word_bytes[data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[:1] = False
        before[edges] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        end = np.flatnonzero(inside & ~after) + 1
        yield Words(first, rows, hash_pieces(data, start, end), np.searchsorted(start, offsets))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; those that cross rows are to be left out by the caller."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(hashes) - n + 1
    total = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        total = total * np.uint64(_BASE) + hashes[j : j + size]
    return mix(total)
