"""Arrow text columns as byte arrays: word bounds and rolling hashes without a Python string per word.

Hashes are polynomials modulo 2**64 over random byte values, read off prefix sums, so that the hash of
any span costs one subtraction and one product. Different seeds give independent polynomials.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21  # bytes hashed at once: bounds the working arrays whatever the text length
NO_ID = np.iinfo(np.int64).max  # stands for a null id inside a task; sorts last

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(8)
def _base(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(seed + 7919)
    values = rng.integers(1, 2**64, 256, dtype=np.uint64)
    factor = int(rng.integers(0, 2**64, dtype=np.uint64)) | 5
    return values, np.uint64(factor), np.uint64(pow(factor, -1, 2**64))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor**i and factor**-i for i up to n."""
    if seed not in _POWERS or len(_POWERS[seed][0]) <= n:
        _, factor, inverse = _base(seed)
        size = max(n + 1, 1 << 16)
        out = []
        for step in (factor, inverse):
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[seed] = (out[0], out[1])
    return _POWERS[seed]


def roll(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `width` consecutive 64-bit values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(seed, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return (sums[width:] - sums[:n - width + 1]) * down[:n - width + 1]


def byte_values(data: np.ndarray, seed: int = 0) -> np.ndarray:
    return _base(seed)[0][data]


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one array, and the bounds of each row; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_binary()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def id_column(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.int64())
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def row_pieces(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose first column holds at most `size` bytes, or one row."""
    ends = byte_column(batch.column(0))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space, never across rows), and how many each row has."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[bounds] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def _pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        yield at, to
        at = to


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for at, to in _pieces(starts, ends):
        base, stop = int(starts[at]), int(ends[to - 1])
        piece = data[base:stop]
        if lower:
            piece = LOWER[piece]
        up, down = _powers(seed, max(stop - base, PIECE))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(byte_values(piece, seed) * up[:len(piece)], out=sums[1:])
        first = starts[at:to] - base
        out[at:to] = (sums[ends[at:to] - base] - sums[first]) * down[first]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    if len(values) < width:
        return values[:0]
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[:len(values) - (width - done)], values[width - done:]) if width > done else values
