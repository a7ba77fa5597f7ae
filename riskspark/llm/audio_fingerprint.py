"""Chroma audio fingerprints of a column of recordings, and their alignment.

A recording is 16-bit little-endian mono PCM. Overlapping frames are folded into the energies of twelve pitch classes.
Sixteen filters, differences of rectangles that an integral image over frames and classes sums at once, are cut into
four levels each; the 32 bits of one position are a packed integer. Recordings align where many equal integers
agree on an offset (a histogram of offsets) and the packed integers there differ in few bits: over the whole overlap, or
else over a stretch of it, so a passage that two recordings share is found whatever stands around it.

Recordings with equal fingerprints are merged into classes before any comparison, so copies cost and return one row each.
The search takes a stated set of query recordings against all classes, in blocks of both; a block of the grid is one task's arrays, and
the equal integers of a query and a block are counted a bounded number at a time, so a common integer (silence) costs time, not memory.
Every class that matches is returned, the query's own one too; the rank only orders them.

A null or empty recording has no frames and no integers and matches nothing. One shorter than a filter is padded with
silence. A very long recording is one row, heard in one piece. Of alignments of equal votes the longest counts, then the one with the fewest
errors, then the lowest offset. Repeated rows are recordings of one class; rows with null or repeated keys are recordings of their own.
Columns besides keys and audio are left out; no column may be named n_frames or items. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm.components import checkpoint

#: Samples a second, samples in a frame, samples from one frame to the next.
RATE, FRAME, HOP = 2000, 1024, 256
LOW, HIGH = 100.0, 900.0
WIDTH, SMOOTH = 12, np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: A filter: how its rectangle is halved, first pitch class, classes, frames.
FILTERS = tuple((("time", "pitch", "both", "middle")[i % 4], (5 * i) % 9, 3 + (i * 7) % 10 if (5 * i) % 9 + 3 + (i * 7) % 10 <= 12 else 3, (4, 6, 8, 12)[i // 4]) for i in range(16))
CUTS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: What a match needs at one offset: equal integers, share of differing bits at most, positions.
VOTES, MOST_ERRORS, OVERLAP = 3, 0.2, 6
#: Equal integers that are counted at once.
AT_ONCE = 4_000_000
#: Packed integers in a block of recordings and in a block of queries, about.
BLOCK_ITEMS, QUERY_ITEMS = 1_500_000, 1_000_000


@lru_cache
def _classes(rate: int) -> np.ndarray:
    """Weight of each spectral bin in each pitch class: bins in range, by the nearest semitone to 440 Hz."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12), np.float32)
    use = np.flatnonzero((f >= LOW) & (f <= HIGH))
    out[use, np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by pitch classes, smoothed over time, each frame of length one (or zero if silent)."""
    n = max(1, -(-len(pcm) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(pcm)] = pcm[: len(padded)] / np.float32(32768)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    spectrum = np.fft.rfft(frames)
    energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _classes(rate)
    around = np.pad(energy, ((2, 2), (0, 0)))
    smooth = sum(w * around[k : k + n] for k, w in enumerate(SMOOTH.astype(np.float32)))
    size = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(size > 1e-3, smooth / np.maximum(size, 1e-3), 0).astype(np.float32)


def packed(image: np.ndarray) -> np.ndarray:
    """The packed integer of each position of a chroma image."""
    if len(image) < WIDTH:
        image = np.pad(image, ((0, WIDTH - len(image)), (0, 0)))
    n = len(image) - WIDTH + 1
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t: int, frames: int, y: int, classes: int) -> np.ndarray:
        a, b = total[t : t + n], total[t + frames : t + frames + n]
        return b[:, y + classes] - b[:, y] - a[:, y + classes] + a[:, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        half, low = w // 2, h // 2
        whole = area(0, w, y, h)
        if kind == "time":
            part = area(0, half, y, h)
        elif kind == "pitch":
            part = area(0, w, y, low)
        elif kind == "both":
            part = area(0, half, y, low) + area(half, w - half, y + low, h - low)
        else:
            part = area(w // 4, half, y, h)
        value = np.log((1 + part) / (1 + whole - part))
        out = out << np.uint32(2) | GRAY[np.searchsorted(CUTS, value)]
    return out


def fingerprint(recordings: DataFrame, keys: list[str], audio: str = "audio", rate: int = RATE, decode: Callable | None = None) -> DataFrame:
    """The keys, n_frames and items (packed integers as bytes) of each recording; no shuffle.

    decode: makes PCM of one value of the column, in the task, so that samples never leave it; None: the column is PCM."""
    rows = recordings.select(*keys, F.col(audio).alias("_audio"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def hear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, items = [], []
            for raw in b.column(len(keys)).to_pylist():
                raw = decode(raw) if decode and raw is not None else raw
                pcm = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") if raw else np.zeros(0, "<i2")
                n.append(-(-len(pcm) // HOP))
                items.append(packed(chroma(pcm, rate)).astype("<u4").tobytes() if len(pcm) else b"")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(items, pa.binary())], [*keys, "n_frames", "items"])

    return rows.mapInArrow(hear, f"{schema}, n_frames long, items binary")


def differing(a: np.ndarray, b: np.ndarray, offset: int) -> np.ndarray:
    """Differing bits at each position of the overlap of b laid at an offset in a."""
    x, y = a[max(0, offset) : max(0, offset + len(b))], b[max(0, -offset) :]
    n = min(len(x), len(y))
    return np.bitwise_count(x[:n] ^ y[:n])


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap of b laid at an offset in a, and the share of differing bits there."""
    wrong = differing(a, b, offset)
    return len(wrong), float(wrong.sum()) / (32 * len(wrong)) if len(wrong) else 1.0


def stretch(wrong: np.ndarray, least: int, votes: int, most_errors: float = MOST_ERRORS, around: int = OVERLAP) -> tuple[int, int, float] | None:
    """Equal integers, length and share of differing bits of what matches at an offset, of `least` positions with so many votes.

    It is the whole overlap if few of its bits differ, and else the longest run of positions around which, `around` of them
    averaged, few bits differ."""
    n = len(wrong)
    total, equal = np.concatenate([[0], wrong.cumsum(dtype=np.int64)]), np.concatenate([[0], (wrong == 0).cumsum()])
    a, b = np.array([0]), np.array([n])
    if total[-1] > most_errors * 32 * n:
        at = np.arange(n)
        low, high = np.maximum(at - around // 2, 0), np.minimum(at - around // 2 + around, n)
        good = total[high] - total[low] <= most_errors * 32 * (high - low)
        edges = np.flatnonzero(np.diff(good, prepend=False, append=False))
        a, b = edges[::2], edges[1::2]
    fits = (b - a >= max(1, least)) & (equal[b] - equal[a] >= votes)
    if not fits.any():
        return None
    a, b = a[fits], b[fits]
    k = int(np.argmax(b - a))
    return int(equal[b[k]] - equal[a[k]]), int(b[k] - a[k]), float(total[b[k]] - total[a[k]]) / (32 * int(b[k] - a[k]))


def _histogram(query: np.ndarray, every: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) pairs, packed, and how many equal integers each has; the integers of the block are sorted."""
    a, b = np.searchsorted(every, query, "left"), np.searchsorted(every, query, "right")
    n = b - a
    ends, bins, votes = np.cumsum(n), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, AT_ONCE):
        k = np.arange(low, min(low + AT_ONCE, total))
        own = np.searchsorted(ends, k, "right")
        at = a[own] + k - (ends[own] - n[own])
        some, count = np.unique((row[at] << 32) + (place[at] - own + (1 << 31)), return_counts=True)
        bins, inverse = np.unique(np.concatenate([bins, some]), return_inverse=True)
        votes = np.bincount(inverse, np.concatenate([votes, count]), len(bins)).astype(np.int64)
    return bins, votes


def _grid(left: pa.Table, right: pa.Table, votes: int = VOTES, most_errors: float = MOST_ERRORS, overlap: int = OVERLAP) -> list[tuple]:
    """The alignment of each pair of a block of queries and a block of classes: query, class, offset, overlap, votes, errors.
    Of several offsets it is the one with the most votes, then the longest, then the one with the fewest errors."""
    own = [np.frombuffer(x, "<u4") for x in left["items"].to_pylist()]
    names, sizes = left["class_id"].to_pylist(), np.array([len(x) for x in own])
    every = np.concatenate(own)
    row = np.repeat(np.arange(len(own)), sizes)
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(every, kind="stable")
    every, row, place = every[order], row[order], place[order]
    out = []
    for name, raw in zip(right["class_id"].to_pylist(), right["items"].to_pylist(), strict=True):
        query = np.frombuffer(raw, "<u4")
        bins, count = _histogram(query, every, row, place)
        least = min(votes, len(query))
        bins = bins[count >= least]
        best: dict[int, tuple] = {}
        for r, off in zip((bins >> 32).tolist(), ((bins & 0xFFFFFFFF) - (1 << 31)).tolist(), strict=True):
            fits = stretch(differing(own[r], query, off), min(overlap, len(query), len(own[r])), least, most_errors, overlap)
            if fits:
                best[r] = min(best.get(r, (1,)), (-fits[0], -fits[1], fits[2], off))
        out += [(name, names[r], off, -length, -v, errors) for r, (v, length, errors, off) in best.items()]
    return out


def search(prints: DataFrame, is_query, keys: list[str], votes: int = VOTES, most_errors: float = MOST_ERRORS, overlap: int = OVERLAP) -> DataFrame:
    """One row per query recording and match: the keys, class_id, rank, match_class, copies, n_matches, offset, overlap, votes, bit_errors.

    prints: from fingerprint(); they are worked out once and written down. is_query: a condition on their columns. Classes are named by
    their smallest keys, in a struct. votes, most_errors, overlap: what a match needs; all that have it are returned (votes = 1 takes
    every offset at which any integer is equal). offset: the place in the match at which the query starts (below zero if the match starts
    later). overlap, votes and bit_errors are of what matches at that offset, see stretch(). rank: by votes, then overlap, then bit errors."""
    one = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    heard = checkpoint(prints.where(F.length("items") > 0).select(one.alias("keys"), "items", F.sha2("items", 256).alias("digest"), F.coalesce(is_query.cast("int"), F.lit(0)).alias("asked")))
    classes = checkpoint(heard.groupBy("digest").agg(F.min("keys").alias("class_id"), F.first("items").alias("items"), F.count("*").alias("copies"), F.max("asked").alias("asked")))
    total, asked = classes.agg(F.coalesce(F.sum(F.length("items")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asked") == 1, F.length("items"))), F.lit(0))).first()
    n, m = max(8, -(-total // (4 * BLOCK_ITEMS))), max(1, -(-asked // (4 * QUERY_ITEMS)))
    part = lambda k, seed: F.pmod(F.xxhash64(F.lit(seed), "digest"), F.lit(k)).cast("int")
    left = classes.select(part(n, 1).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_q"), F.col("digest").alias("class_id"), "items")
    right = classes.where("asked = 1").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_b"), part(m, 2).alias("_q"), F.col("digest").alias("class_id"), "items")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = _grid(a, b, votes, most_errors, overlap) if a.num_rows and b.num_rows else []
        columns = list(zip(*found, strict=True)) if found else [[]] * 6
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query", "match", "offset", "overlap", "votes", "bit_errors"])

    found = left.groupBy("_b", "_q").cogroup(right.groupBy("_b", "_q")).applyInArrow(cell, "query string, match string, offset long, overlap long, votes long, bit_errors double")
    mine = Window.partitionBy("query")
    order = mine.orderBy(F.desc("votes"), F.desc("overlap"), "bit_errors", "match")
    found = found.withColumns({"rank": F.row_number().over(order), "n_matches": F.count("*").over(mine)})
    found = found.join(classes.select(F.col("digest").alias("match"), F.col("class_id").alias("match_class"), "copies"), "match")
    members = heard.where("asked = 1").select("keys", F.col("digest").alias("query"))
    named = members.join(classes.select(F.col("digest").alias("query"), "class_id"), "query").join(found, "query")
    whole = lambda c: F.struct(*[F.col(c).getField(f"k{i}").alias(k) for i, k in enumerate(keys)]).alias(c)
    return named.select(*[F.col("keys").getField(f"k{i}").alias(k) for i, k in enumerate(keys)], whole("class_id"), "rank", whole("match_class"), "copies", "n_matches", "offset", "overlap", "votes", "bit_errors")


@lru_cache
def _notes() -> np.ndarray:
    """A note for each of 24 semitones from 110 Hz, HOP samples, with soft ends."""
    t = np.arange(HOP) / RATE
    ends = np.minimum(1, np.minimum(np.arange(HOP), np.arange(HOP)[::-1]) / 24)
    return np.array([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in range(24)]) * ends * 9000


def played(text: str) -> bytes:
    """PCM of a text: each word sounds for one hop, as the chord of its first three letters."""
    pitch = np.array([[ord(w[min(k, len(w) - 1)]) % 24 for k in range(3)] for w in text.lower().split()], int).reshape(-1, 3)
    return _notes()[pitch].sum(1).astype("<i2").tobytes()


def recordings_query(spark, sf_dir: str) -> DataFrame:
    """The turns of all conversations, played, as recordings; those of every fiftieth conversation are looked for in all."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    prints = fingerprint(turns, ["conv_id", "turn"], "text", decode=played)
    found = search(prints, F.col("conv_id") % 50 == 0, ["conv_id", "turn"])
    return found.select("conv_id", "turn", F.col("class_id.conv_id").alias("class_conv_id"), F.col("class_id.turn").alias("class_turn"), "rank", F.col("match_class.conv_id").alias("match_conv_id"), F.col("match_class.turn").alias("match_turn"), "copies", "n_matches", "offset", "overlap", "votes", "bit_errors")
