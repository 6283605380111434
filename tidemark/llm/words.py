"""Words and word shingles of whole texts, hashed in numpy straight from Arrow's text buffers.

A word is a run of ``[^\\x20\\x09-\\x0D]``; these six separators are single bytes in UTF-8, so words
are found on the bytes. A shingle is five words in a row; a text of one to four words has its whole
sequence as its only shingle; a null text or one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 15

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)


def mix(value: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    value = (value ^ (value >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> _U(27))) * _U(0x94D049BB133111EB)
    return value ^ (value >> _U(31))


def _powers(count: int) -> np.ndarray:
    factors = np.full(count, _BASE, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS = _powers(4096)


@dataclass
class Words:
    """Words of consecutive texts: hash, first byte and end of each; ``offsets[i]`` is text i's first."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each text (one more than texts); null: empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of pieces of bounded size; no text is cut."""
    data, offsets = text_buffers(column)
    first, rows = 0, len(column)
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, first + 1), first + CHUNK_ROWS, rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: np.ndarray = _SPACE) -> Words:
    """Words of the texts that lie one after the other in ``data``; ``between`` marks the bytes that part them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    space = between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= space[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    counted = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), starts, ends, counted)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = _POWERS if place.max() < len(_POWERS) else _powers(int(place.max()) + 1)
    value = _BYTE[_LOWER[data[starts[0] :]] if lower else data[starts[0] :]]
    value *= powers[place]
    value[space[starts[0] :]] = 0
    hashes = np.add.reduceat(value, starts - starts[0])
    return Words(mix(hashes + (ends - starts).astype(np.uint64)), starts, ends, counted)


def shingles(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle in order of place, and offsets of the texts' shingles.

    A text of five words or more has one shingle per word but the last four.
    """
    hashes, offsets = found.hashes, found.offsets
    counts = np.diff(offsets)
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    out_offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out_offsets[1:])
    out = np.zeros(out_offsets[-1], np.uint64)
    if len(hashes) >= WIDTH:
        total = len(hashes) - WIDTH + 1
        whole = np.zeros(total, np.uint64)
        for j in range(WIDTH):
            whole += mix(hashes[j : j + total] + _PLACE[j]) * _PLACE[j]
        valid = np.arange(total) + WIDTH <= np.repeat(offsets[1:], counts)[:total]
        target = np.repeat(counts >= WIDTH, sizes)
        out[target] = whole[valid]
    for size in range(1, WIDTH):
        rows = np.flatnonzero(counts == size)
        short = np.full(len(rows), size, np.uint64)
        for j in range(size):
            short += mix(hashes[offsets[rows] + j] + _PLACE[j]) * _PLACE[j]
        out[out_offsets[rows]] = short
    return mix(out), out_offsets


def owners(offsets: np.ndarray) -> np.ndarray:
    """Number of the text each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def binary(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each."""
    raw = np.ascontiguousarray(values)
    width = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def slices(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive stretches of an array as one binary value each."""
    raw = np.ascontiguousarray(values)
    ends = (offsets * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]
    )
