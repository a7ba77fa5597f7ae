"""Phrases that occur often and together, by mergeable Misra-Gries summaries.

Words are runs without blanks within pieces between punctuation marks and line ends, A-Z lower-cased; phrases are up to `most` words of
one piece. Everything is counted for each language by itself.

First pass: documents are dealt into blocks; each block sends its phrases, as short hashes with counts, to the partitions of the hash
space. A partition merges what blocks send into one Misra-Gries summary: counters are added, and when there are more of them than its
capacity, the (capacity + 1)-th largest count is taken off all. The capacity exceeds the partition's mass divided by the threshold, so
less than the threshold is ever taken off a counter: every phrase that reaches the threshold survives, in memory of bounded size.
Second pass: the survivors' counts are added up again, exactly, and hashes below the threshold go. Hashes that two phrases share only let more
stay, so each block counts the phrases of the hashes that stayed and sends them as text, and their sums decide. Parts of a frequent phrase are frequent, so the counts that a score needs are there too.

Null and empty texts have no words; a null language is `und`. Very long texts are one document of their block, read whole. Repeated rows count
as often as they stand there, null or equal ids make no difference, and other columns may have any names. Equal scores are told apart by
count and phrase. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm import blocks
from riskspark.llm.components import checkpoint
from riskspark.llm.runs import batches, gaps, runs
from riskspark.llm.textwords import mix, windows

THRESHOLD, MOST, TOP = 10, 3, 2000
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_GAP, _END = gaps(b" \t" + _PIECE_ENDS), gaps(_PIECE_ENDS)
#: Parts into which a language's phrases are dealt before the last ranking.
_PARTS = 64


class Summary:
    """A Misra-Gries summary: at most `capacity` counters; `taken` is what has been taken off each at most."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Counts of distinct keys. They are merged when as many wait as there are counters."""
        self._waiting.append((keys, counts))
        self._size += len(keys)
        if self._size > self.capacity:
            self.merge()

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self._waiting, strict=True))
        self._waiting, self._size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        if len(keys):
            first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts = keys[counts > off], counts[counts > off] - off
            self.taken += off
        self.keys, self.counts = keys, counts

    def reaching(self, threshold: int) -> np.ndarray:
        """Sorted keys whose true count may be that large."""
        if self._waiting:
            self.merge()
        return self.keys[self.counts + self.taken >= threshold]


def _phrases(table: pa.Table, most: int):
    """For each batch: text of the words with one blank after each, first and last byte of each word there, language of each word (as a row
    of the table), and for each size the words that begin a phrase and the phrases' keys."""
    languages = table["_lang_key"].to_numpy().astype(np.uint64)
    for i, data, edges in batches(table["_text"]):
        starts, ends, hashes = runs(data, _GAP)
        row = np.searchsorted(edges, starts, "right") - 1 + i
        piece = np.cumsum(_END[data])[starts] if len(starts) else starts
        kept = ~_GAP[data]
        kept[ends] = True  # one byte after each word
        place = np.cumsum(kept) - 1
        text = np.where(_GAP[data], np.uint8(32), data)[kept].tobytes()
        own, sizes = mix(languages[row]), []
        for n in range(1, most + 1):
            keys = windows(hashes, n)
            good = np.flatnonzero(piece[: len(keys)] == piece[n - 1 :]) if len(keys) else np.zeros(0, int)
            sizes.append((n, good, mix(keys[good] ^ own[good])))
        yield text, place[starts], place[ends], row, sizes


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1))) if len(keys) else np.zeros(0, int)
    return keys[first], order[first], np.diff(first, append=len(keys))


def frequent(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, most: int = MOST, block: int = blocks.BLOCK) -> DataFrame:
    """(lang, size, phrase, f): every phrase of up to `most` words that occurs `threshold` times, with its exact count; size 0: all words of the language."""
    total = blocks.corpus_size(docs, text)
    language = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), language.alias("_lang"), F.xxhash64(language).alias("_lang_key"))
    dealt = blocks.deal(rows, total, "id", "text", block, ("_lang", "_lang_key"))
    bits, n, n_blocks = blocks.key_bits(total), blocks.count_of(total), blocks.count_of(total, block)
    short = np.uint64(64 - bits)

    def send(table: pa.Table) -> pa.Table:
        keys = [k for *_, sizes in _phrases(table, most) for _, _, k in sizes]
        keys, _, counts = _distinct(np.concatenate([k >> short for k in keys]) if keys else np.zeros(0, np.uint64))
        parts = blocks.ranges(keys, n, bits)
        own = table["_block"][0].as_py()
        return pa.table(
            [pa.array([k for k, _, _ in parts], pa.int32()), pa.array([own] * len(parts), pa.int32()), pa.array([blocks.pack_sorted(keys[a:b]) for _, a, b in parts], pa.binary()), pa.array([blocks.pack(counts[a:b].astype("<u4")) for _, a, b in parts], pa.binary()), pa.array([int(counts[a:b].sum()) for _, a, b in parts], pa.int64())],
            ["_range", "_block", "_keys", "_counts", "_mass"],
        )

    def survive(table: pa.Table) -> pa.Table:
        summary = Summary(sum(table["_mass"].to_pylist()) // threshold + 1)
        for keys, counts in zip(table["_keys"], table["_counts"], strict=True):
            summary.add(blocks.unpack_sorted(keys.as_py()), blocks.unpack(counts.as_py())[0].astype(np.int64))
        alive, names, out = summary.reaching(threshold), [], []
        count = np.zeros(len(alive), np.int64)
        for keys, counts in zip(table["_keys"], table["_counts"], strict=True):
            own = blocks.unpack_sorted(keys.as_py())
            here = blocks.found(own, alive)
            count[np.searchsorted(alive, own[here])] += blocks.unpack(counts.as_py())[0].astype(np.int64)[here]
        alive = alive[count >= threshold]
        for name, keys in zip(table["_block"].to_pylist(), table["_keys"], strict=True):
            own = blocks.unpack_sorted(keys.as_py())
            own = own[blocks.found(own, alive)]
            if len(own):
                names.append(name)
                out.append(blocks.pack_sorted(own))
        return pa.table([pa.array(names, pa.int32()), pa.array(out, pa.binary())], ["_block", "_keys"])

    sent = dealt.groupBy("_block").applyInArrow(send, "_range int, _block int, _keys binary, _counts binary, _mass long")
    alive = sent.repartitionById(n, "_range").groupBy("_range").applyInArrow(survive, "_block int, _keys binary").repartitionById(n_blocks, "_block")

    def count(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = np.sort(np.concatenate([blocks.unpack_sorted(x) for x in answers["_keys"].to_pylist()])) if answers.num_rows else np.zeros(0, np.uint64)
        names, key_of = table["_lang"].to_pylist(), mix(table["_lang_key"].to_numpy().astype(np.uint64))
        bodies: list[bytes] = []
        parts: list[tuple] = []  # key, row that tells the language, size, count
        for body, first, end, row, sizes in _phrases(table, most):
            which, words = np.unique(row, return_counts=True)
            parts.append((key_of[which], which, np.zeros(len(which), int), words))
            bodies += [b""] * len(which)
            for size, good, keys in sizes:
                here = blocks.found(keys >> short, own)
                good, keys = good[here], keys[here]
                keys, place, counts = _distinct(keys)
                at = good[place]
                parts.append((keys, row[at], np.full(len(at), size), counts))
                bodies += [body[a:b] for a, b in zip(first[at].tolist(), end[at + size - 1].tolist(), strict=True)]
        key, row, size, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.uint64)] * 4
        order = np.lexsort((key, size > 0))  # a language's own key may be that of a phrase
        new = np.diff(key[order], prepend=key[order][:1] ^ np.uint64(1)).astype(bool) | np.diff(size[order] > 0, prepend=False)
        first = np.flatnonzero(new)
        counts = np.add.reduceat(counts[order], first) if len(first) else counts
        at = order[first]
        to, out = (key[at] % np.uint64(n)).astype(int), []
        for k in np.unique(to).tolist():
            mine = np.flatnonzero(to == k)
            mine = mine[np.argsort(np.array([bodies[x] for x in at[mine].tolist()], object), kind="stable")]  # neighbours alike, so that they pack
            texts, spoken = [bodies[x] for x in at[mine].tolist()], [names[x] for x in row[at[mine]].tolist()]
            known = sorted(set(spoken))
            place = {x: y for y, x in enumerate(known)}
            body = zstandard.compress(b"\n".join(texts), 3)
            out.append((k, known, body, blocks.pack(np.array([place[x] for x in spoken], "<u4"), size[at[mine]].astype("<u2"), counts[mine].astype("<u4"))))
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())], ["_range", "_langs", "_texts", "_counts"])

    def add(table: pa.Table) -> pa.Table:
        out = []
        for known, texts, packed in zip(table["_langs"], table["_texts"], table["_counts"], strict=True):
            which, size, counts = blocks.unpack(packed.as_py())
            texts = zstandard.ZstdDecompressor().decompressobj().decompress(texts.as_py()).split(b"\n")
            out.append(pa.table([known.values.take(pa.array(which.astype("<i4"))), pa.array(size.astype("<i4")), pa.array(texts, pa.binary()), pa.array(counts.astype("<i8"))], ["lang", "size", "phrase", "f"]))
        found = pa.concat_tables(out).group_by(["lang", "size", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "size", "phrase", "f"])
        found = found.filter((pc.field("f") >= threshold) | (pc.field("size") == 0))
        return found.set_column(2, "phrase", found["phrase"].cast(pa.string()))

    counted = dealt.groupBy("_block").cogroup(alive.groupBy("_block")).applyInArrow(count, "_range int, _langs array<string>, _texts binary, _counts binary")
    return counted.repartitionById(n, "_range").groupBy("_range").applyInArrow(add, "lang string, size int, phrase string, f long")


def collocations(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, most: int = MOST, top: int = TOP, covered: int = 50, block: int = blocks.BLOCK) -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a, l, r, n, score. A phrase of which a longer one makes up `covered` percent is left out.

    Scores are exact: products of counts below 10 ** 13 are decimals of up to 35 digits."""
    counts = checkpoint(frequent(docs, id_col, text, lang, threshold, most, block))
    words = lambda c: F.split(F.col(c), " ", -1)
    slices = lambda c, a, n: F.array_join(F.slice(words(c), a, n), " ")
    candidates = counts.where("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", slices("phrase", F.lit(1), F.col("k"))).withColumn("right", slices("phrase", F.col("k") + 1, F.col("size") - F.col("k")))
    part = lambda name, of: counts.where((F.col("size") > 0) & (F.col("size") < most)).select("lang", F.col("phrase").alias(of), F.col("f").alias(name))
    cuts = cuts.join(part("l", "left"), ["lang", "left"]).join(part("r", "right"), ["lang", "right"])
    d = lambda c: F.col(c).cast("decimal(13,0)")
    cuts = cuts.withColumn("_up", d("a") * d("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("_down", d("l") * d("r"))
    best = cuts.withColumn("score", F.expr("_up div _down")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("size > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    inner = inner.groupBy("lang", slices("phrase", F.col("i"), F.col("n")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)).alias("part"))
    for by in (["lang", "part"], ["lang"]):  # no task ranks all phrases of a language
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return kept.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_query(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
