"""Array helpers for work inside tasks: words and their hashes straight from Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most`` bytes of ``text``, so that memory stays bounded."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        _, offsets = buffer_of(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets into them; nulls count as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if where is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    content = content[offsets[0] : offsets[-1]]
    return content, offsets - offsets[0]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the pair (a, b), element by element; the order counts."""
    x = a * _B
    x ^= b + _A
    x ^= x >> np.uint64(32)
    x *= _A
    x ^= x >> np.uint64(29)
    return x


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        found = np.full(size, base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if size <= 1 << 22:
            _powers[base] = found
    return found[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each row's offsets into the words."""
    gap = IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a row's first byte begins a word even after another row's word
    before = np.concatenate([[True], gap[:-1]]) if len(data) else gap
    starts = np.flatnonzero(~gap & (before | first[:-1]))
    after = np.concatenate([gap[1:], [True]]) if len(data) else gap
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial; equal spans have equal hashes."""
    return sequence_hashes(data.astype(np.uint64) + np.uint64(1 + seed), starts, ends)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of numbers; equal spans have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=total[1:])
    x = (total[ends] - total[starts]) * _power(_INVERSE, len(values))[starts]
    return finish(x ^ ((ends - starts).astype(np.uint64) * _A))


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words and each row's offsets into them.

    A row of fewer words, but at least one, has one shingle of them all.
    """
    n = np.diff(bounds)
    x = np.full(len(hashes), 0x5851F42D4C957F2D, np.uint64)
    for k in range(size):
        x[: len(hashes) - k] = mix(x[: len(hashes) - k], hashes[k:])
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(len(n)), count)
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out[-1]) - out[row] + bounds[row]
    found = x[at]
    for i in np.flatnonzero((n > 0) & (n < size)):  # the chain above ran into the next row
        y = np.full(1, 0x5851F42D4C957F2D, np.uint64)
        for h in hashes[bounds[i] : bounds[i + 1]]:
            y = mix(y, np.array([h], np.uint64))
        found[out[i]] = y[0]
    return found, out
