"""Quality of texts by naive Bayes support vectors.

A text is the set of its byte n-grams (1 to 4 bytes, case kept, hashed to 2**18 features) and of the shapes of its word n-grams (2 to 6 words
that are all the same, and pairs of pairs). Each indicator is scaled by its log-count
ratio between good and bad texts, the vector is brought to length one, and a linear hinge-loss model is fitted by dual coordinate
descent. Its margins become probabilities by a logistic curve, fitted on margins that models of the other folds give.

The model is fitted in one task on a bounded sample: at most MOST labelled texts, half of each class, those of the smallest
hashes of their ids; the shares of the classes among all labelled rows set the curve's intercept. Every text is scored, whole.

Null texts are empty ones; an empty text has no n-gram and its score follows from the intercept. An id whose labels differ is not
learned from, repeated labels count once, and of several texts of a labelled id one is taken. Null labels and ids are not
learned from; a null id is not held out. Without labels every score is 0.5, with labels of one class it is that class. Very long
texts are read in one piece within their batch. Repeated rows get equal scores; other columns may have any names; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.language_id import held_out
from riskspark.llm.textwords import chunks, mix, words

#: Documented bound of the training sample, in texts.
MOST = 8000
BITS, ORDERS, ROUNDS, COST, FOLDS = 18, (1, 2, 3, 4), 12, 1.0, 3


@dataclass(frozen=True)
class Model:
    """weight: w * ratio of each feature; square: ratio ** 2; the curve is 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        size = self.square[features].sum()
        return float(self.weight[features].sum() / np.sqrt(size) + self.bias) if size > 0 else self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -500, 500))))

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.bias, self.slope, self.shift], self.weight, self.square]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        x = np.frombuffer(raw, "<f8")
        n = (len(x) - 3) // 2
        return cls(x[3 : 3 + n], x[3 + n :], *x[:3].tolist())


def indicators(texts: pa.ChunkedArray | pa.Array, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """The distinct features of each text, in order of appearance by length of n-gram."""
    last = np.zeros(1 << bits, np.int64)
    shape = (mix(np.arange(8, dtype=np.uint64) + np.uint64(1 << 50)) >> np.uint64(64 - bits)).astype(np.int64)
    for _, _, data, offsets in chunks(texts):
        grams, gram = [], np.zeros(len(data), np.uint64)
        for n in range(1, max(orders) + 1):
            if len(data) < n:
                break
            gram = (gram[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
            if n in orders:
                grams.append((n, (mix(gram + np.uint64(n << 40)) >> np.uint64(64 - bits)).astype(np.int64)))
        hashes, at = words(data, offsets, lower=True)
        for a, b, first, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = [g[a : b - n + 1] for n, g in grams if b - a >= n] + [shape[_shapes(hashes[first:end])]]
            own = np.concatenate(own)
            place = np.arange(len(own))
            last[own[::-1]] = place[::-1]  # the first place of each feature is written last
            yield own[last[own] == place]


def _shapes(hashes: np.ndarray) -> list[int]:
    """Numbers of the shapes that a text's words have somewhere: n equal words for 2 to 6, and two equal ones twice."""
    pair = hashes[1:] == hashes[:-1]
    if not pair.any():
        return []
    found = [7] if len(pair) > 2 and (pair[:-2] & pair[2:] & ~pair[1:-1]).any() else []
    longest = int(np.diff(np.flatnonzero(np.diff(pair, prepend=False, append=False)))[::2].max()) + 1
    return found + list(range(2, min(longest, 6) + 1))


def ratios(rows: list[np.ndarray], good: np.ndarray, size: int) -> np.ndarray:
    """Log-count ratio of each feature, counts of texts plus one."""
    out = []
    for side in (good, ~good):
        count = np.ones(size)
        for k in np.flatnonzero(side).tolist():
            count[rows[k]] += 1
        out.append(np.log(count / count.sum()))
    return out[0] - out[1]


def descend(rows: list[np.ndarray], good: np.ndarray, size: int, rounds: int = ROUNDS, cost: float = COST) -> tuple[np.ndarray, np.ndarray, float]:
    """Weight times ratio, squared ratio and bias of the hinge-loss model over scaled indicators; the classes weigh the same."""
    square = ratios(rows, good, size) ** 2
    norm = np.sqrt([max(square[x].sum(), 1e-12) for x in rows])
    sign, most = np.where(good, 1.0, -1.0), np.where(good, cost * len(rows) / (2 * good.sum()), cost * len(rows) / (2 * (~good).sum()))
    weight, bias, dual, order = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for k in order.permutation(len(rows)).tolist():
            x = rows[k]
            gradient = sign[k] * (weight[x].sum() / norm[k] + bias) - 1
            step = min(max(dual[k] - gradient / 2, 0.0), most[k]) - dual[k]  # a scaled row and its constant have a squared length of two
            if step:
                dual[k] += step
                weight[x] += step * sign[k] / norm[k] * square[x]
                bias += step * sign[k]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, square, bias


def curve(margins: np.ndarray, good: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over margins, by Newton steps, with the classes' shares held off 0 and 1."""
    up, down = good.sum(), (~good).sum()
    want, x = np.where(good, (up + 1) / (up + 2), 1 / (down + 2)), np.stack([margins, np.ones_like(margins)], 1)
    at = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (want - p) - 1e-6 * at)
        at += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], good: np.ndarray, odds: float, size: int = 1 << BITS, folds: int = FOLDS) -> Model:
    """odds: of the good class among all labelled rows."""
    fold, margins, known = np.random.default_rng(17).permutation(len(rows)) % folds, np.zeros(len(rows)), np.zeros(len(rows), bool)
    for f in range(folds):
        here = np.flatnonzero(fold != f)
        if 0 < good[here].sum() < len(here):
            part = Model(*descend([rows[k] for k in here.tolist()], good[here], size), 1.0, 0.0)
            for k in np.flatnonzero(fold == f).tolist():
                margins[k], known[k] = part.margin(rows[k]), True
    slope, shift = curve(margins[known], good[known]) if 0 < good[known].sum() < known.sum() else (1.0, 0.0)
    return Model(*descend(rows, good, size), slope, shift + float(np.log(odds) - np.log(good.sum() / (~good).sum())))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST) -> Model | float:
    """The model of labels (id_col, label), or the only score where labels give none."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_good"), F.max(label).alias("_most")).where("_good = _most")
    own = own.select("_id", (F.col("_good") > 0).alias("_good"), F.xxhash64(F.lit(13), "_id").alias("_hash"))
    count = {r["_good"]: r["count"] for r in own.groupBy("_good").count().collect()}
    if len(count) < 2:
        return float(next(iter(count), 0.5))
    chosen = [own.where(F.col("_good") == side).orderBy("_hash", "_id").limit(most // 2) for side in (True, False)]
    chosen = chosen[0].union(chosen[1])  # at most `most` ids
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "_good", "_hash").agg(F.min("_text").alias("_text"))

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = [x.astype("<i4").tobytes() for x in indicators(part["_text"])]
            yield pa.RecordBatch.from_arrays([part["_hash"], part["_good"], pa.array(own, pa.binary())], ["_hash", "_good", "_features"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_hash", "ascending"), ("_good", "ascending")])
        vectors, good = [np.frombuffer(x, "<i4") for x in table["_features"].to_pylist()], np.array(table["_good"].to_pylist())
        one_sided = not 0 < good.sum() < len(good)  # the other class has labels, but no texts
        return pa.table({"_model": pa.array([None if one_sided else fit(vectors, good, count[True] / count[False]).to_bytes()], pa.binary()), "_only": pa.array([float(good[0]) if one_sided else None], pa.float64())})

    found = rows.mapInArrow(features, "_hash long, _good boolean, _features binary").withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(learn, "_model binary, _only double").first()
    if found is None:
        return 0.5
    return found["_only"] if found["_model"] is None else Model.from_bytes(found["_model"])


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """The documents with the probability of being good, from their texts alone."""
    if isinstance(model, float):
        return docs.withColumn(out, F.lit(model))
    types = [docs.schema[c].dataType.simpleString() for c in docs.columns]
    names, at = [f"c{k}" for k in range(len(types))], docs.columns.index(text)

    def scores(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([model.score(x) for x in indicators(part.column(at))], pa.float64())], [*names, "score"])

    schema = ", ".join(f"{n} {t}" for n, t in zip([*names, "score"], [*types, "double"], strict=True))
    return docs.toDF(*names).mapInArrow(scores, schema).toDF(*docs.columns, out)


def quality_query(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels.quality of those not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(~held_out("doc_id", 5, 0)))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
