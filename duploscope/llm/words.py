"""Words and shingles of Arrow string columns as 64-bit hashes, computed on whole buffers in numpy.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered unless asked otherwise.
Its hash is a polynomial in the bytes' random values, modulo 2**64, and then mixed; a word costs
no Python object. Texts go through in slices of bounded size, and one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses
_values = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_lowered = np.arange(256)
_lowered[65:91] += 32
_LOWER_VALUES = _values[_lowered]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = _inverses = np.ones(1, np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` powers of the base and of its inverse."""
    global _powers, _inverses
    if len(_powers) < size:
        size = max(size, SLICE_BYTES + 1)
        for_powers, for_inverses = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        for_powers[0] = for_inverses[0] = 1
        _powers, _inverses = np.cumprod(for_powers), np.cumprod(for_inverses)
    return _powers[:size], _inverses[:size]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Slice(NamedTuple):
    first: int  # row of the column at which the slice begins
    data: np.ndarray  # bytes of its texts
    bounds: np.ndarray  # where each text begins in `data`, and the end of the last


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's texts in slices of at most `limit` bytes, or one longer text."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        wide = pa.types.is_large_string(chunk.type)
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)
        offsets = offsets[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        content = chunk.buffers()[2]
        data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield Slice(row + at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
            at = upto
        row += len(chunk)


class Words(NamedTuple):
    hashes: np.ndarray
    starts: np.ndarray  # byte where each word begins
    ends: np.ndarray
    bounds: np.ndarray  # number of the first word of each text, and the number of words


def words(part: Slice, keep_case: bool = False) -> Words:
    data, size = part.data, len(part.data)
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = part.bounds[:-1] < part.bounds[1:]
    heads, tails = part.bounds[:-1][filled], part.bounds[1:][filled] - 1
    begins[heads] = inside[heads]
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = powers(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((_values if keep_case else _LOWER_VALUES)[data] * up[:size], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, part.bounds))


_STEPS = mixed(np.arange(1, 65, dtype=np.uint64) * _BASE) | np.uint64(1)


class Shingles(NamedTuple):
    hashes: np.ndarray
    bounds: np.ndarray  # number of the first shingle of each text, and the number of shingles


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> Shingles:
    """Hashes of all runs of `width` words in order; a shorter, non-empty text has one of all its words."""
    counts = np.diff(bounds)
    amounts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out = np.concatenate(([0], np.cumsum(amounts)))
    # word at which each shingle begins: the text's first word plus the shingle's place in its text
    begin = np.repeat(bounds[:-1] - out[:-1], amounts) + np.arange(out[-1])
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    short = np.flatnonzero((counts > 0) & (counts < width))
    sums = np.zeros(out[-1], np.uint64)
    for step in range(width):
        sums += padded[begin + step] * _STEPS[step]
    for row in short:
        own = hashes[bounds[row] : bounds[row + 1]]
        sums[out[row]] = np.concatenate((own * _STEPS[: len(own)], _STEPS[-len(own) - 1 :][:1])).sum(dtype=np.uint64)
    return Shingles(mixed(sums), out)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of one text."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))] if len(hashes) else hashes
