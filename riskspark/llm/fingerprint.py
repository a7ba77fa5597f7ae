"""Bottom-k sketches of word shingle hashes as document fingerprints.

A sketch holds the k smallest distinct hashes of a text's shingles of five words (a shorter text is
one shingle, a text without words has none); sketches of parts of a text merge by keeping the k
smallest of both. From sketches come estimates of resemblance, of containment and of the number of
distinct shingles; they are exact while a text has k shingles or fewer.

A fingerprint is the base64 text of the sorted hashes as little-endian 64-bit integers. Null texts count as empty;
their fingerprint is the empty string, and two empty fingerprints are alike (1.0). A very long text is sketched in one piece.
Repeated rows have fingerprints of their own, which are equal; ids are of any type with an order and only matter for what follows what.
Other columns are left out and may have any names. An empty table gives no rows."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.components import checkpoint
from riskspark.llm.textwords import chunks, window_starts, windows, words

K, WORDS = 128, 5
#: Characters of text in a range of neighbouring ids, about, and the most ranges: a larger corpus has larger ranges, whose rows are
#: sorted with spill and read in batches, so that what the driver and a broadcast hold of them (edges, first ids) stays below a megabyte.
RANGE, MOST_RANGES = 12_000_000, 20_000
#: Rows of the sample that tells the ranges of ids which are no numbers, for each range.
SAMPLE = 40


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, sorted."""
    if len(hashes) > 8 * k:
        low = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def sketches(texts: pa.Array, k: int = K, n: int = WORDS) -> list[np.ndarray]:
    """The sketch of each text."""
    out = []
    for i, j, data, offsets in chunks(texts):
        hashes, at = words(data, offsets)
        starts = window_starts(at, n)
        grams = windows(hashes, n)[starts] if len(starts) else np.zeros(0, np.uint64)
        edges = np.searchsorted(starts, at).tolist()
        at = at.tolist()
        for r in range(j - i):
            own = grams[edges[r] : edges[r + 1]]
            short = hashes[at[r] : at[r + 1]]
            out.append(bottom(own, k) if len(own) else windows(short, len(short)) if len(short) else short)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together (of their shingles; those across the cut are in neither)."""
    return bottom(np.concatenate([a, b]), k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of shingles of both among those of either."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, n: int = WORDS) -> DataFrame:
    """id_col, fingerprint and estimated distinct shingles of each row; no shuffle."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = sketches(b.column(1), k, n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(x) for x in own], pa.string()), pa.array([distinct(x, k) for x in own], pa.float64())], ["_id", "fingerprint", "n_distinct"])

    return rows.mapInArrow(sketch, f"_id {rows.schema['_id'].dataType.simpleString()}, fingerprint string, n_distinct double").withColumnRenamed("_id", id_col)


def merged(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """One fingerprint per key from the fingerprints of its parts. Each task folds its rows first, so a key
    with many parts sends one sketch from each task."""
    kind = parts.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for own, s in zip(b[key], b["fingerprint"], strict=True):
                own = None if pd.isna(own) else own
                held[own] = merge(held[own], from_text(s), k) if own in held else from_text(s)
                if len(held) >= 50_000:
                    yield pd.DataFrame({key: list(held), "fingerprint": [to_text(x) for x in held.values()]})
                    held = {}
        yield pd.DataFrame({key: pd.Series(list(held), dtype=object), "fingerprint": pd.Series([to_text(x) for x in held.values()], dtype=object)})

    def fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sketch, any_row = None, None, False
        for b in batches:
            done = []
            for x, s in zip(b[key], b["fingerprint"], strict=True):
                x = None if pd.isna(x) else x
                if any_row and x == own:
                    sketch = merge(sketch, from_text(s), k)
                else:
                    if any_row:
                        done.append((own, to_text(sketch)))
                    own, sketch, any_row = x, from_text(s), True
            yield pd.DataFrame(done, columns=[key, "fingerprint"], dtype=object)
        if any_row:
            yield pd.DataFrame([(own, to_text(sketch))], columns=[key, "fingerprint"], dtype=object)

    schema = f"{key} {kind}, fingerprint string"
    return parts.select(key, "fingerprint").mapInPandas(fold, schema).repartition(key).sortWithinPartitions(key).mapInPandas(fold_sorted, schema)


def _edges_of(rows: DataFrame, count: int, n: int) -> list[str]:
    """Ids that part the rows into about n ranges of equal numbers, from a sample of about SAMPLE rows a range."""
    near = rows.where(F.col("_id").isNotNull() & (F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30)) <= min(1.0, SAMPLE * n / max(count, 1)) * (1 << 30)))
    found = sorted(r[0] for r in near.select(F.col("_id").cast("string")).collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def _placed(rows: DataFrame, span: int, most: int) -> tuple[DataFrame, int]:
    """The rows with _place, a number that never falls as ids rise, and the number of ranges. Numbers stand for themselves; for other ids
    it is their range among those of a sample. Null ids lie below all others, spread by the hash of the text."""
    kind = rows.schema["_id"].dataType
    plain = F.col("_id").cast("double") if isinstance(kind, T.NumericType) else None
    total, count, low = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count("*"), F.min(plain) if plain is not None else F.lit(0.0)).first()
    n = min(max(12, -(-total // span)), most)
    if plain is None:
        edges = _edges_of(rows, count, n)

        @F.pandas_udf("double")
        def range_of(ids: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else float(bisect.bisect_right(edges, x)) for x in ids], dtype="float64")

        plain = F.when(F.col("_id").isNotNull(), range_of(F.col("_id").cast("string")))
    low = low or 0.0
    spread = (F.xxhash64("_text") / 2.0**64) + 0.5
    return rows.withColumn("_place", F.coalesce(plain, F.lit(low) - F.lit(abs(low) * 1e-6 + 1.0) * (spread + 1.0))), n


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = RANGE, most: int = MOST_RANGES) -> DataFrame:
    """Rows laid out so that each is followed by the next document in descending id order: (_range, _guest, _place, _id, _text),
    sorted within partitions. The last row of a range is a guest, a copy of the first row of the range below
    (below the last one: of the very first). Null ids are below all others, in the order of their texts' hashes; rows of one id are ordered by text."""
    rows, n = _placed(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), span, most)
    edges = sorted(set(rows.approxQuantile("_place", [i / n for i in range(1, n)], 0.2 / n) or []))
    placed = rows.withColumn("_range", F.lit(0))
    if edges:
        cut = Bucketizer(splits=[-np.inf, *edges, np.inf], inputCol="_place", outputCol="_bucket")
        placed = cut.transform(rows).withColumn("_range", F.col("_bucket").cast("int")).drop("_bucket")
    tops = checkpoint(placed.groupBy("_range").agg(F.max(F.struct("_place", "_id")).alias("_top")))  # a row for each range, without texts
    used = sorted(r["_range"] for r in tops.select("_range").collect())
    up = docs.sparkSession.createDataFrame([(r, used[(i + 1) % len(used)]) for i, r in enumerate(used)], "_range int, _to int")
    tops = tops.select(F.col("_range").alias("_own"), "_top").join(F.broadcast(up), F.col("_own") == F.col("_range")).drop("_range")
    # rows of a range's greatest id: one, or those that share the id, of which the greatest text is the guest
    first = placed.join(F.broadcast(tops), (F.col("_range") == F.col("_own")) & (F.col("_place") == F.col("_top._place")) & F.col("_id").eqNullSafe(F.col("_top._id")))
    guests = first.groupBy("_to").agg(F.max(F.struct("_place", "_id", "_text")).alias("_row")).select(F.col("_to").alias("_range"), F.lit(True).alias("_guest"), "_row.*")
    laid = placed.select("_range", F.lit(False).alias("_guest"), "_place", "_id", "_text").unionByName(guests)
    return laid.repartitionById(n, "_range").sortWithinPartitions("_range", "_guest", F.desc("_place"), F.desc_nulls_last("_id"), F.desc("_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, n: int = WORDS) -> DataFrame:
    """Fingerprints of each text, of the text whose last half is replaced by the start of the next document, and their likeness."""
    laid = with_next(docs, id_col, text)
    kind = laid.schema["_id"].dataType.simpleString()
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # range, guest, id, text, sketch
        for b in batches:
            own = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), sketches(b.column(4), k, n), strict=True))
            seen = ([last] if last else []) + own
            last = seen[-1]
            pairs = [(x, y) for x, y in zip(seen, seen[1:], strict=False) if not x[1] and x[0] == y[0]]
            edited = []
            for x, y in pairs:
                half = len(x[3]) // 2
                edited.append(x[3][: len(x[3]) - half] + y[3][:half])
            after = sketches(pa.array(edited, pa.string()), k, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], b.schema.field(3).type),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([to_text(x[4]) for x, _ in pairs], pa.string()),
                    pa.array([to_text(e) for e in after], pa.string()),
                    pa.array([resemblance(x[4], e, k) for (x, _), e in zip(pairs, after, strict=True)], pa.float64()),
                    pa.array([resemblance(x[4], y[4], k) for x, y in pairs], pa.float64()),
                ],
                names,
            )

    return laid.mapInArrow(walk, f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("_id", id_col)


def fingerprint_query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
