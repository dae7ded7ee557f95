"""Vectorised work on the bytes of many texts at once (numpy over Arrow buffers).

A slice is a run of rows whose texts lie one after another in one uint8 array; `offsets` has one more entry than
there are rows. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which never cut a UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that start a code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80

_random = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Odd multipliers for combining hashes by position.
MULTIPLIERS = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_FILLED = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
SEEDS = _random.integers(1, 2**63, 1024, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        step = np.full(max(n + 1, 2 * SLICE_BYTES), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(buffer: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about `most` bytes; a longer text comes alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, buffer[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    n = len(buffer)
    inside = IS_WORD[buffer]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | cut[:n]))
    before = edge[1:] | cut[1:]
    before[-1:] = True
    ends = np.flatnonzero(inside & before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hashes(buffer: np.ndarray) -> np.ndarray:
    """Sums of value(byte) * BASE ** place over all prefixes, modulo 2 ** 64; only for `window_hashes`."""
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * powers(BASE, len(buffer))[: len(buffer)], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` bytes. Texts can be written whose windows collide, so equality of these decides no result."""
    return mix((prefix[size:] - prefix[:-size]) * powers(INVERSE, len(prefix))[: len(prefix) - size])


def _blocks(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 8-byte blocks of spans of at least one byte (the last one filled with zeros), their places in the span, and each span's first."""
    each = (sizes + 7) >> 3
    first = np.concatenate([[0], np.cumsum(each)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], each)
    at = np.repeat(starts, each) + 8 * place
    wide = np.concatenate([buffer, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(wide) - 7, "<u8", wide, strides=(1,))[at]
    last = first[1:] - 1
    blocks[last] &= _FILLED[sizes - 8 * (each - 1)]
    return blocks, place, first[:-1]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes in [start, end): equal bytes, equal hash, wherever they stand.

    Every block of 8 bytes is mixed with its place by itself before the sum, so that exchanging parts of a text changes the sum. Where
    equality of hashes decides a result, bytes are compared too (`equal_spans`).
    """
    sizes = ends - starts
    out = sizes.astype(np.uint64) * MULTIPLIERS[63]
    some = np.flatnonzero(sizes > 0)
    if len(some):
        blocks, place, first = _blocks(buffer, starts[some], sizes[some])
        most = int(place.max()) + 1
        salt = mix(np.arange(most, dtype=np.uint64) * MULTIPLIERS[62] + MULTIPLIERS[61])
        out[some] += np.add.reduceat(mix(blocks ^ salt[place]), first)
    return mix(out)


def equal_spans(buffer: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from one equal those from two."""
    out = np.ones(len(sizes), bool)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        a, _, first = _blocks(buffer, one[some], sizes[some])
        b, _, _ = _blocks(buffer, two[some], sizes[some])
        out[some] = np.logical_and.reduceat(a == b, first)
    return out


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_row(kind, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums by row of values that lie in row order; a row's sum depends on nothing but its own values."""
    if kind is np.float64:
        return np.bincount(rows_of(bounds), values, len(bounds) - 1)
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
