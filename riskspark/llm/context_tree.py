"""Language-model scores by context-tree weighting over bytes.

A text (A-Z in lower case, UTF-8) is a sequence of bytes ended by a zero byte. Each byte is eight binary
decisions; a decision's contexts are the bits of its byte so far with the last 0, 1, ..., depth bytes.
Every context holds a Krichevsky-Trofimov estimate from the counts of the training texts, and a context's
weighted probability is half its own estimate's and half that of the contexts one byte longer. A frozen
tree predicts a bit by mixing the estimates along the path with the weights that the training data left.

The tree is built where its counts are: (depth + 1)-byte grams of a block of documents are packed and sent to the
pair of last two context bytes they have. The counts of a pair are merged FAN blocks at a time, level by level, so a task reads
FAN lists of distinct grams, however large the corpus and however common the pair; below a pair the tree is one task's arrays, of distinct grams.
The two levels above have at most 256 * 255 + 255 nodes, whatever the corpus, and are broadcast. The log probabilities
go back down the same levels, each list of grams getting those of its own.

Beside it stands a unigram baseline over words and an end token with additive smoothing.

Null and empty texts are just the end. A text that holds a zero byte is scored as if it ended and began again there.
A very long text is one document of its block, read in pieces. Repeated rows, and rows with equal or null ids, count and are scored like
others; equal texts have equal scores. Ids are of any type; other columns are not looked at and may have any names. With no
training texts every bit has probability one half. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm import blocks
from riskspark.llm.components import checkpoint
from riskspark.llm.language_id import held_out
from riskspark.llm.textwords import _LOWER, chunks, words

DEPTH = 4
#: Characters of text in a block, about: larger blocks have fewer keys in all.
BLOCK = 24_000_000
#: Lists of grams that are merged at once.
FAN = 8
_LN2, _LN10 = np.log(2.0), np.log(10.0)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and the end of each text with the bytes before it, nearest first, as one integer; and the texts' offsets among them."""
    n, total = len(offsets) - 1, int(offsets[-1])
    laid = np.zeros(total + n * (depth + 1), np.uint8)
    lengths = np.diff(offsets)
    laid[np.arange(total) + np.repeat(np.arange(n) * (depth + 1) + depth, lengths)] = _LOWER[data]
    at = offsets + np.arange(n + 1)
    here = np.arange(total + n) + np.repeat(np.arange(1, n + 1) * depth, lengths + 1)
    key = laid[here - 1].astype(np.uint64)
    for k in range(2, depth + 1):
        key = key << np.uint64(8) | laid[here - k]
    return key << np.uint64(8) | laid[here], at


def tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint64(1)))
    return every[first], np.add.reduceat(count[order], first) if len(first) else count


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers, by Stirling's series above 8."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def block_probability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - np.log(np.pi) - _ln_gamma(a + b + 1)


class Level:
    """The nodes of one depth: sorted keys (context, bits so far), estimates of a one, and the weight of a node's own estimate."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        a, b = a.astype(float), b.astype(float)  # bincount of nothing counts in integers
        self.keys, self.a, self.b = keys, a, b
        own = block_probability(a, b)
        self.weighted = own if below is None else np.logaddexp(own, below) - _LN2
        self.share = np.ones(len(keys)) if below is None else np.exp(own - _LN2 - self.weighted)
        self.one = (b + 0.5) / (a + b + 1)

    def mix(self, keys: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of the bit at each of these nodes, given that of the nodes below; a half where training never was."""
        if not len(self.keys):
            return np.full(len(keys), 0.5)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        one = self.one[at]
        return np.where(self.keys[at] == keys, self.share[at] * np.where(bit, one, 1 - one) + (1 - self.share[at]) * deeper, 0.5)


def _bits(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol (rows) and each of its eight decisions: the bits so far with a leading one, and the bit."""
    j = np.arange(8, dtype=np.uint64)
    x = symbols[:, None].astype(np.uint64)
    return (np.uint64(1) << j) | (x >> (np.uint64(8) - j)), (x >> (np.uint64(7) - j)) & np.uint64(1)


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """From distinct grams with counts, the levels of depth, depth - 1, ..., top. Keys drop what lies above the grams' first byte."""
    keys, counts = keys[counts > 0], counts[counts > 0]
    so_far, bit = _bits(keys & np.uint64(255))
    node = ((keys >> np.uint64(8) << np.uint64(8))[:, None] | so_far).ravel()
    n, bit = np.repeat(counts.astype(float), 8), bit.ravel() > 0
    out: list[Level] = []
    below = None
    own, inverse = np.unique(node, return_inverse=True)
    a, b = np.bincount(inverse, n * ~bit, len(own)), np.bincount(inverse, n * bit, len(own))
    for d in range(depth, top - 1, -1):
        out.append(Level(own, a, b, below))
        if d > top:
            parent = (own >> np.uint64(16) << np.uint64(8)) | (own & np.uint64(255))
            own, inverse = np.unique(parent, return_inverse=True)
            below = np.bincount(inverse, out[-1].weighted, len(own))
            a, b = np.bincount(inverse, a, len(own)), np.bincount(inverse, b, len(own))
    return out


def below(keys: np.ndarray, own: list[Level]) -> np.ndarray:
    """Probability of each gram's eight bits at the nodes of two context bytes, from the levels down from depth."""
    so_far, bit = _bits(keys & np.uint64(255))
    p, context, bit = np.full(so_far.size, 0.5), keys >> np.uint64(8), bit.ravel() > 0
    for level in own:
        p = level.mix((context[:, None] << np.uint64(8) | so_far).ravel(), bit, p)
        context = context >> np.uint64(8)
    return p


def log_probability(keys: np.ndarray, p: np.ndarray, depth: int, upper: list[Level]) -> np.ndarray:
    """Natural logarithm of each gram's last byte given its context. p: from below(); upper: levels 1 and 0."""
    so_far, bit = _bits(keys & np.uint64(255))
    first, bit = keys >> np.uint64(8 * depth), bit.ravel() > 0
    p = upper[0].mix((first[:, None] << np.uint64(8) | so_far).ravel(), bit, p)
    p = upper[1].mix(so_far.ravel(), bit, p)
    return np.log(p).reshape(-1, 8).sum(1)


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte of all rows, learned from rows where trains holds."""
    if not 3 <= depth <= 7:
        raise ValueError("depth is from 3 to 7")
    spark = docs.sparkSession
    seen = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.coalesce(trains, F.lit(False)).alias("_train"))
    total, ends = seen.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count_if("_train")).first()
    parts, n_blocks, kind = blocks.count_of(total), blocks.count_of(total, BLOCK), blocks.id_type(docs, id_col)
    dealt = blocks.deal(seen, total, "_id", "_text", BLOCK, more=("_train",))
    inner = np.uint64((1 << (8 * (depth - 1))) - 1)

    def count(table: pa.Table) -> pa.Table:
        train = np.array(table["_train"].to_pylist(), bool)
        held: dict[str, tuple[list, list]] = {"words": ([], []), "grams": ([], [])}
        for i, j, data, offsets in chunks(table["_text"]):
            hashes, at = words(data, offsets, lower=True)
            keys, at_key = grams(data, offsets, depth)
            for name, every, edges in (("words", hashes, at), ("grams", keys, at_key)):
                k, n = tally([every], [np.repeat(train[i:j], np.diff(edges)).astype(np.int64)])
                held[name][0].append(k)
                held[name][1].append(n)
        out = []
        own, n = tally(*held["words"])
        out += [(k, own[a:b], n[a:b]) for k, a, b in blocks.ranges(own, parts, 64)]
        own, n = tally(*held["grams"])
        pair = (own >> np.uint64(8 * (depth - 1))).astype(np.int64)
        edges = np.flatnonzero(np.diff(pair, prepend=-1, append=1 << 62))
        out += [(-1 - int(pair[a]), own[a:b] & inner, n[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        block = table["_block"][0].as_py()
        return pa.table([pa.array([k for k, _, _ in out], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array([blocks.pack_sorted(k) for _, k, _ in out], pa.binary()), pa.array([blocks.pack(n.astype("<u4")) for _, _, n in out], pa.binary())], ["_part", "_block", "_keys", "_counts"])

    sent = checkpoint(dealt.groupBy("_block").applyInArrow(count, "_part int, _block int, _keys binary, _counts binary"))

    def together(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
        keys = [blocks.unpack_sorted(x) for x in table["_keys"].to_pylist()]
        return keys, *tally(keys, [blocks.unpack(x)[0].astype(np.int64) for x in table["_counts"].to_pylist()])

    def merge(table: pa.Table) -> pa.Table:
        _, every, n = together(table)
        return pa.table([table["_part"][:1], table["_up"][:1], pa.array([blocks.pack_sorted(every)], pa.binary()), pa.array([blocks.pack(n.astype("<u8"))], pa.binary())], ["_part", "_block", "_keys", "_counts"])

    up = (F.col("_block") / FAN).cast("int").alias("_up")
    lists, n = [sent.where("_part < 0")], n_blocks
    while n > 1:
        lists.append(checkpoint(lists[-1].select("*", up).groupBy("_part", "_up").applyInArrow(merge, "_part int, _block int, _keys binary, _counts binary")))
        n = -(-n // FAN)

    def tree(table: pa.Table) -> pa.Table:
        """A pair's tree: for each gram the probability of its eight bits at the nodes of two context bytes, and these nodes for the level above."""
        _, every, n = together(table)
        own = levels(every, n, depth, 2)
        root = own[-1]
        one = lambda *x: pa.array([blocks.pack(*x)], pa.binary())
        return pa.table([table["_part"][:1], pa.array([blocks.pack_sorted(every)], pa.binary()), one(below(every, own).astype("<f4").ravel().view("<u4")), one(root.keys, *(x.astype("<f8").view("<u8") for x in (root.a, root.b, root.weighted)))], ["_part", "_keys", "_low", "_root"])

    trees = checkpoint(lists[-1].groupBy("_part").applyInArrow(tree, "_part int, _keys binary, _low binary, _root binary"))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, *sums = blocks.unpack(body)
                yield pa.RecordBatch.from_arrays([pa.array([(-1 - part) >> 8] * len(keys), pa.int32()), pa.array(keys.astype(np.int32)), *[pa.array(x.view("<f8")) for x in sums]], ["first", "bits", "a", "b", "weighted"])

    nodes = trees.select("_part", "_root").mapInArrow(roots, "first int, bits int, a double, b double, weighted double")
    ones = nodes.groupBy("first", "bits").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("w")).orderBy("first", "bits").collect()  # 256 * 255 rows at most
    key = np.array([r["first"] << 8 | r["bits"] for r in ones], np.uint64)
    a, b, w = (np.array([r[c] for r in ones], float) for c in "abw")
    one = Level(key, a, b, w)
    own, inverse = np.unique(key & np.uint64(255), return_inverse=True)
    zero = Level(own, *(np.bincount(inverse, x, len(own)) for x in (a, b, one.weighted)))
    upper = spark.sparkContext.broadcast([one, zero])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for part, keys, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                every = blocks.unpack_sorted(keys) | np.uint64((-1 - part) << (8 * (depth - 1)))
                value = log_probability(every, blocks.unpack(low)[0].view("<f4").astype(float), depth, upper.value)
                values.append(blocks.pack((value / _LN10).astype("<f4").view("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(values), pa.int32()), batch.column(1), pa.array(values, pa.binary())], ["_part", "_block", "_keys", "_values"])

    def hand_down(left: pa.Table, right: pa.Table) -> pa.Table:
        """Lists of grams get the values that their merged list has."""
        if not left.num_rows:
            return _answers(left, [])
        every, value = blocks.unpack_sorted(right["_keys"][0].as_py()), blocks.unpack(right["_values"][0].as_py())[0]
        return _answers(left, [blocks.pack(value[np.searchsorted(every, blocks.unpack_sorted(x))]) for x in left["_keys"].to_pylist()])

    def answer_words(table: pa.Table) -> pa.Table:
        keys, every, n = together(table)
        return _answers(table, [blocks.pack(n[np.searchsorted(every, k)].astype("<u8")) for k in keys])

    def count_words(table: pa.Table) -> pa.Table:
        n = together(table)[2]
        return pa.table([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], ["_sum", "_distinct"])

    schema = "_part int, _block int, _keys binary, _values binary"
    words_sent = sent.where("_part >= 0")
    values = trees.select("_part", "_keys", "_low").mapInArrow(judge, schema)
    for grams_sent in reversed(lists[:-1]):
        values = grams_sent.select("*", up).groupBy("_part", "_up").cogroup(values.groupBy("_part", "_block")).applyInArrow(hand_down, schema)
    answered = values.unionByName(words_sent.groupBy("_part").applyInArrow(answer_words, schema))
    n_words, n_distinct = words_sent.groupBy("_part").applyInArrow(count_words, "_sum long, _distinct long").agg(F.coalesce(F.sum("_sum"), F.lit(0)), F.coalesce(F.sum("_distinct"), F.lit(0))).first()
    n_train, n_types = n_words + ends, n_distinct + (ends > 0)
    scale = float(np.log10(n_train + 0.5 * (n_types + 1)))

    def lay(left: pa.Table, right: pa.Table) -> pa.Table:
        part = np.array(right["_part"].to_pylist(), np.int64)
        keys = [blocks.unpack_sorted(x) for x in right["_keys"].to_pylist()]
        values = [blocks.unpack(x)[0] for x in right["_values"].to_pylist()]
        word_keys, counts, gram_keys, logs = [], [], [], []
        for p, k, v in zip(part.tolist(), keys, values, strict=True):
            if p >= 0:
                word_keys.append(k)
                counts.append(v)
            else:
                gram_keys.append(k | np.uint64((-1 - p) << (8 * (depth - 1))))
                logs.append(v.view("<f4"))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        word_keys, counts, gram_keys, logs = join(word_keys, np.uint64), join(counts, np.uint64), join(gram_keys, np.uint64), join(logs, np.float32)
        order = np.argsort(word_keys)
        word_keys, counts = word_keys[order], counts[order].astype(float)
        order = np.argsort(gram_keys)
        gram_keys, logs = gram_keys[order], logs[order].astype(float)
        known, gain = counts > 0, np.log10(counts + 0.5)
        n_tokens, n_known, base, total, size = [], [], [], [], []
        for i, j, data, offsets in chunks(left["_text"]):
            hashes, at = words(data, offsets, lower=True)
            row = np.repeat(np.arange(j - i), np.diff(at))
            place = np.searchsorted(word_keys, hashes)
            n_tokens.append(np.diff(at) + 1)
            n_known.append(np.bincount(row, known[place], j - i) + (ends > 0))
            base.append(np.bincount(row, gain[place], j - i) + np.log10(ends + 0.5))
            own, at = grams(data, offsets, depth)
            total.append(np.bincount(np.repeat(np.arange(j - i), np.diff(at)), logs[np.searchsorted(gram_keys, own)], j - i))
            size.append(np.diff(at))
        join = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
        return pa.table([left["_id"].combine_chunks(), left["_train"].combine_chunks(), join(n_tokens, np.int64), join(n_known, np.int64), join(base, float), join(total, float), join(size, np.int64)], ["_id", "_train", "n_tokens", "n_known", "_base", "score", "_size"])

    out = dealt.groupBy("_block").cogroup(answered.repartitionById(n_blocks, "_block").groupBy("_block")).applyInArrow(lay, f"_id {kind}, _train boolean, n_tokens long, n_known long, _base double, score double, _size long")
    return out.select(
        F.col("_id").alias(id_col),
        (~F.col("_train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("_base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10.0))) / F.col("_size")).alias("bits_per_byte"),
    )


def _answers(table: pa.Table, values: list[bytes]) -> pa.Table:
    """A part's rows with their values."""
    return pa.table([table["_part"], table["_block"], table["_keys"], pa.array(values, pa.binary())], ["_part", "_block", "_keys", "_values"])


def scores_query(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, ~held_out("doc_id", 5, 1))
