"""Vectorised work on Arrow text columns inside tasks: words, lines and their hashes.

A column's texts lie one after another in one byte buffer.  Words, lines and windows are found and hashed
for the whole buffer with NumPy, in slices of a few megabytes of text, so that a task's memory doesn't grow
with its partition.  Hashes mix eight bytes at a time; two seeds give the keys of exact grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once unless asked otherwise; one longer text is handled alone.
SLICE = 1 << 20

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are not the continuation of a UTF-8 character, so one for each code point.
HEAD = (np.arange(256) & 0xC0) != 0x80


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x *= _B
    x ^= x >> U(27)
    x *= _C
    x ^= x >> U(31)
    return x


class Texts:
    """Some texts: ``data`` holds their bytes and eight more, ``at`` the n + 1 offsets."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = np.zeros(len(data) + 8, np.uint8)
        self.data[: len(data)] = data
        self.at, self.n, self.size = at, len(at) - 1, len(data)

    def bytes(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a flag for each byte over each text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def runs(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the runs of bytes that ``breaks`` (a table of 256) doesn't mark."""
        inside = ~breaks[self.data[: self.size]]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = self.at[1:] > self.at[:-1]
        edge = self.at[:-1][full]
        first[edge] = inside[edge]
        edge = self.at[1:][full] - 1
        last[edge] = inside[edge]
        starts = np.flatnonzero(first)
        counts = np.diff(np.searchsorted(starts, self.at))
        return starts, np.flatnonzero(last) + 1, np.repeat(np.arange(self.n), counts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(SPACE)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        view = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        size = ends - starts
        h = mixed(size.astype(U) * _A + U(seed))
        left, at, which = size, starts, None
        for _ in range(128):
            if not len(left):
                return h
            x = view[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * np.clip(left, 1, 8).astype(U)))
            x = np.where(left > 0, x, U(0))
            if which is None:
                h = mixed(h ^ x)
            else:
                h[which] = mixed(h[which] * _A ^ x)
            more = np.flatnonzero(left > 8)
            which = more if which is None else which[more]
            left, at = left[more] - 8, at[more] + 8
        for i, s, e in zip(which, at, at + left, strict=True):  # the rest of words of over a thousand bytes
            h[i] = mixed(h[i : i + 1] ^ _long(self.data[s:e], seed))[0]
        return h


def _long(data: np.ndarray, seed: int) -> U:
    """Hash of many bytes: the sum of their eight-byte words, each mixed with its place."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    places = mixed(np.arange(1, len(padded) // 8 + 1, dtype=U) * _A ^ U(seed))
    return mixed(mixed(padded.view("<u8") ^ places) * _A).sum(dtype=U) ^ U(len(data))


def texts(column: pa.Array, change: Callable[[pa.Array], pa.Array] | None = None, size: int = SLICE) -> Iterator[tuple[int, Texts]]:
    """The column in slices of about ``size`` bytes: first row and texts.  Null counts as empty.

    ``change`` is applied to each slice alone, so that no changed copy of a whole batch is held.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    data, at = _buffers(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        end = min(end, len(column))
        if change is None:
            yield row, Texts(data[at[row] : at[end]], at[row : end + 1] - at[row])
        else:
            own, cut = _buffers(change(column.slice(row, end - row)))
            yield row, Texts(own[cut[0] : cut[-1]], cut - cut[0])
        row = end


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes under a column and its n + 1 offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def windows(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` consecutive words of one text, and the first word of each."""
    if len(h) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total, span, done, out, c = h, 1, 0, None, _A | U(1)
    power = lambda n: U(pow(int(c), n, 1 << 64))
    n = len(h) - k + 1
    while span <= k:  # runs of 1, 2, 4 ... words; k is put together from its binary digits
        if k & span:
            piece = total[done : done + n]
            out = piece.copy() if out is None else out + piece * power(done)
            done += span
        if span * 2 <= k:
            total = total[: len(total) - span] + total[span:] * power(span)
        span *= 2
    first = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mixed(out[first]), first


def covered(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in the windows of ``k`` words that start at ``first``."""
    edge = np.zeros(n + k + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + k, -1)
    return np.cumsum(edge)[:n] > 0


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes, one after another."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    width = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(data) // sum(width), [], 0
    for k, w in zip(kinds, width, strict=True):
        out.append(np.frombuffer(data, k, n, at))
        at += n * w
    return out
