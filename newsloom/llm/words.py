"""Vectorised words over Arrow string columns: byte blocks, word hashes, shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space of the word rule ``[^\\x20\\x09-\\x0D]+``, as a mask over byte values.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of longer characters.
SYMBOLS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

BLOCK_BYTES = 1 << 20
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing mix of 64-bit values, so that any bits of a hash may be used alone."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 17)
_BYTE[np.arange(ord("A"), ord("Z") + 1)] = _BYTE[np.arange(ord("a"), ord("z") + 1)]
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the rows' offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a longer row is a run of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def hashed_words(values: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte) of every word, in order; A-Z count as a-z, ``apart`` marks separators."""
    none = np.zeros(0, np.int64)
    if not len(values):
        return none.astype(np.uint64), none, none
    outside = apart[values]
    before = np.empty(len(values), bool)
    before[0] = True
    before[1:] = outside[:-1]
    before[offsets[:-1][offsets[:-1] < len(values)]] = True
    begins = before & ~outside
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none.astype(np.uint64), none, none
    run = np.diff(np.append(starts, len(values)))
    place = np.arange(starts[0], len(values)) - np.repeat(starts, run)
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _PLACE))
    parts = _BYTE[values[starts[0] :]] * powers[place]
    parts[outside[starts[0] :]] = 0
    hashes = mix(np.add.reduceat(parts, starts - starts[0]))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts


def prefix_hashes(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, length: int, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words have at least ``length`` bytes, hashes of their first ``length`` bytes)."""
    long = np.flatnonzero(starts + length <= offsets[rows + 1])
    total = np.full(len(long), length, np.uint64)
    whole = np.ones(len(long), bool)
    factors = constants(length, 211)
    for k in range(length):
        byte = values[starts[long] + k]
        whole &= ~apart[byte]
        total += _BYTE[byte] * factors[k]
    return long[whole], mix(total[whole])


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every row's runs of ``size`` words; a shorter row is one run."""
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    factors = constants(size, 101)
    runs = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        runs += hashes[k : k + len(runs)] * factors[k]
    runs = mix(runs)
    out = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        start = end - count
        if count >= size:
            out.append(np.unique(runs[start : end - size + 1]))
        elif count:
            out.append(mix(np.array([(hashes[start:end] * factors[:count]).sum() + np.uint64(count)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
