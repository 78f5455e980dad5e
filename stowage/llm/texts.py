"""Words and shingles of Arrow text columns as numpy arrays, in bounded pieces of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are taken together up to this many bytes; a longer text is taken alone.
PIECE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64; fixed values)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))


BYTE_VALUE = seeds(256, 11)
STEP = seeds(1, 12)[0] | U64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of a string column; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after the other, and each text's first word.

    The third array has one more entry than there are texts. ``breaks`` marks the bytes that separate words.
    """
    inside = ~breaks[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit value of every word's bytes, with A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    within = np.arange(len(first)) + first  # the places of all bytes in words
    place = within - np.repeat(starts, lengths)
    values = BYTE_VALUE[LOWER[data[within]] if lower else data[within]]
    values *= powers(STEP, int(lengths.max()))[place]
    sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return mix(sums + lengths.astype(U64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Values of all runs of ``size`` words of each text, and each text's first one.

    A text with fewer words is one run as a whole; one without words has none.
    """
    factors = seeds(size, 13) | U64(1)
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(runs)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], runs)
    padded = np.concatenate((hashes, np.zeros(size, U64)))
    total = np.zeros(len(at), U64)
    # In a short text the words past its end count as nothing.
    room = np.repeat(np.minimum(counts, size), runs)
    for k in range(size):
        part = padded[at + k] * factors[k]
        total += np.where(room > k, part, U64(0)) if (room <= k).any() else part
    return mix(total + room.astype(U64)), begin
