"""Words and word windows of whole batches of texts as 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09 to 0x0D; in UTF-8 these bytes
occur only as those characters. All arithmetic is modulo 2**64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, x, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of an array of strings; null counts as empty."""
    a = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the n + 1 offsets of the texts among the words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    up, down = _tables(len(data))
    values = (_LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    values[space] = 0
    values *= up[: len(data)]
    sums = np.add.reduceat(values, starts) * down[starts]
    return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(_STEP)), at


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    have, out, done, x, size = len(hashes), None, 0, hashes, 1
    while n:  # x: windows of size words, for sizes 1, 2, 4, ...; out: windows of the done words so far
        if n & 1:
            out = x if out is None else out[: have - done - size + 1] * np.uint64(pow(_STEP, size, 1 << 64)) + x[done : done + have - done - size + 1]
            done += size
        n >>= 1
        if n:
            x = x[: len(x) - size] * np.uint64(pow(_STEP, size, 1 << 64)) + x[size:]
            size *= 2
    return mix(out + np.uint64(done))


def window_starts(at: np.ndarray, n: int) -> np.ndarray:
    """Positions among the words at which a window of n words of one text starts."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    total = int(counts.sum())
    firsts = np.repeat(at[:-1], counts)
    return firsts + (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts))


def chunks(texts: pa.ChunkedArray | pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about most bytes together: first text, one past the last, bytes, offsets."""
    array = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    data, offsets = buffers(array)
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
