"""Vectorised text primitives over Arrow string columns (numpy, whole batches).

Everything here works on one contiguous UTF-8 buffer plus document offsets,
so the cost per byte is a handful of numpy passes and no Python loop runs per
word.  Hashes are position independent: equal words (lines, windows) hash
equally wherever they stand and on whichever executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = int(_rng.integers(2**40, 2**62)) * 8 + 5
_BASE_INV = pow(_BASE, -1, 2**64)
_SLICE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 2**64))
        done += step
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SLICE, 1 << int(n).bit_length())
    if size > _SLICE:  # one word longer than a slice: not worth keeping
        return _powers(_BASE, size), _powers(_BASE_INV, size)
    if size not in _tables:
        _tables[size] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _tables[size]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multiplications)."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair(x: np.ndarray, y: np.ndarray, salt: int = 0) -> np.ndarray:
    """Ordered combination of two hash arrays."""
    return mix(x * U64(0xD6E8FEB86659FD93) + (y ^ (y >> U64(29))) * U64(0xA0761D6478BD642F), salt)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 buffer, int64 offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` (or other blanks), and words per document."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (ascending, not overlapping), by its bytes alone."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        power, inverse = _tables_for(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


class Words:
    """The words of a batch of documents and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = _SPACE):
        self.data = ASCII_LOWER[data] if lower else data
        self.starts, self.ends, self.counts = word_spans(self.data, offsets, blank)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # first word of each document
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def starts_of(self, width: int) -> np.ndarray:
        """Word numbers at which a window of so many words fits in its document."""
        at = np.arange(len(self.hashes))
        return at[at + width <= self.first[1:][self.doc]]


def windows(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of the `width` consecutive items from each place (length - width + 1), in log(width) passes."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    out, size, part, step = None, 0, mix(h, salt), 1
    while step <= width:
        if width & step and out is None:
            out, size = part, step
        elif width & step:
            n = len(h) - size - step + 1
            out, size = pair(out[:n], part[size : size + n], step + salt), size + step
        if step * 2 <= width:
            part = pair(part[:-step], part[step:], 64 + step + salt)
        step *= 2
    return out


def runs(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... as one array."""
    total = int(n.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 as byte planes of their differences: about log2(range / count) bits each before compression."""
    gaps = np.diff(values, prepend=U64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def contains(sorted_values: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Which probes occur in an ascending array."""
    if not len(sorted_values):
        return np.zeros(len(probes), bool)
    at = np.searchsorted(sorted_values, probes)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == probes
