"""Runs of bytes between gaps, in whole batches of texts, as arrays.

Texts are joined by a line feed, which has to be a gap, so no run crosses from one text to the next. In UTF-8 an ASCII byte
occurs as that character only, so a table of 256 entries tells gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskspark.llm.textwords import _LOWER, _STEP, _tables, mix

#: Bytes of text in a batch, about.
BATCH = 1_000_000


def gaps(own: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(own)] = True
    return table


def batches(texts: pa.ChunkedArray | pa.Array, most: int = BATCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, bytes with A-Z lower-cased and a line feed after each text, and the first byte of each text and one past the last; null is empty."""
    lengths = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy().astype(np.int64) + 1
    edges, i = np.concatenate([[0], np.cumsum(lengths)]), 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, "right")) - 1)
        body = "\n".join([x or "" for x in texts.slice(i, j - i).to_pylist()]) + "\n"
        yield i, _LOWER[np.frombuffer(body.encode(), np.uint8)], edges[i : j + 1] - edges[i]
        i = j


def runs(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, one past the last, and 64-bit hash of every run."""
    inside = ~gap[data]
    change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    up, down = _tables(len(data))
    values = np.where(inside, data, 0).astype(np.uint64) + inside
    values *= up[: len(data)]
    return starts, ends, mix(np.add.reduceat(values, starts) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP))
