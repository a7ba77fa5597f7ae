"""Ranked lexical search over K2-treaps of terms and documents.

Documents are dealt into blocks. A block is a grid: a row for each of its terms, the most frequent first, and a column for each document with a
term, by ascending id; a cell's value is the impact of the term on the document, which the statistics of the whole corpus set. The grid is a
compressed quadtree: a node for each square that is not empty, level by level in Z order, with four bits for its quarters and the largest
impact in it, told as the difference from the node above.

A query descends all its terms' rows at once: a range of documents is known by one node for each term, the square that holds the term's row and the
range, so the weighted sum of these nodes' maxima bounds the score of every document there. Ranges are opened best bound first, many at a time, until
no bound reaches the k-th best document found. At the last level a bound is a document's score. A task carries its best documents from one block to
the next, and what the tasks found is ranked over all of them; nothing is left out, and ties go to the smallest id.

Terms are maximal runs of ASCII letters, digits and all other characters from U+0080 on, A-Z lower-cased, and are told apart by 64-bit hashes. Null and
empty texts have no terms and are never found. Very long texts are one document of their block, read whole. Every row counts as a document: repeated
rows and rows with null or equal ids are found as often as they stand there, null ids after others of their score. Items without a known term have no rows;
items of one id are one query with the terms of all. Other columns may have any names. Empty tables give no rows."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from riskspark.llm import blocks
from riskspark.llm.components import shared_folder
from riskspark.llm.runs import batches, gaps, runs

TOP = 50
#: Items answered in one pass over the index, and ranges of documents opened at a time.
ITEMS, OPENED = 256, 256
#: Parts into which an item's documents are dealt before the last ranking.
_PARTS = 64
_GAP = gaps(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_BITS = np.array([bin(x).count("1") for x in range(16)], np.int64)
INDEX_SCHEMA = "_block int, _terms binary, _df binary, _masks binary, _drops binary, _ids array<{kind}>, _height int"


def _terms(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term in order."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for i, data, edges in batches(texts):
        starts, _, hashes = runs(data, _GAP)
        out.append((hashes, np.searchsorted(edges, starts, "right") - 1 + i))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spread(x: np.ndarray) -> np.ndarray:
    """Each bit of a number below 2**32 at twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term that occurs tf times adds to a document of n terms, before its weight."""
    m = 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def tree(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Height, bits of the quarters and differences of the maxima of a grid's points, from the top level down."""
    height = int(max(rows.max(), columns.max())).bit_length()
    code = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(code)
    code, value = code[order], values[order]
    masks, drops = [], []
    for _ in range(height):
        up = code >> np.uint64(2)
        first = np.flatnonzero(np.diff(up, prepend=up[:1] ^ np.uint64(1)))
        top = np.maximum.reduceat(value, first)
        drops.append((np.repeat(top, np.diff(first, append=len(code))) - value).astype("<u4"))
        masks.append(np.add.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first).astype(np.uint8))
        code, value = up[first], top
    return height, blocks.pack(*masks[::-1]), blocks.pack(value.astype("<u4"), *drops[::-1])


class Treap:
    """A quadtree read back: for each node the bits of its quarters, its first child and its largest impact; the last node is the empty one."""

    def __init__(self, height: int, masks: bytes, drops: bytes):
        top, *drop = blocks.unpack(drops)
        mask = blocks.unpack(masks)
        value, level = [top.astype(np.int64)], 0
        for m, d in zip(mask, drop, strict=True):
            value.append(np.repeat(value[level], _BITS[m]) - d)
            level += 1
        self.height, self.value = height, np.concatenate([*value, [0]])
        self.mask = np.concatenate([*mask, np.zeros(len(value[-1]) + 1, np.uint8)]).astype(np.int64)
        self.child = np.cumsum(_BITS[self.mask]) - _BITS[self.mask] + 1
        self.none = len(self.value) - 1

    def step(self, nodes: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        mask = self.mask[nodes]
        return np.where((mask >> quarter) & 1, self.child[nodes] + _BITS[mask & ((1 << quarter) - 1)], self.none)


def descend(t: Treap, rows: np.ndarray, weights: np.ndarray, best: list[int], top: int, opened: int = OPENED) -> list[tuple[int, int]]:
    """(score, column) of documents that may be among the `top` best; best: a heap of the largest scores found so far, kept up to date."""
    out: list[tuple[int, int]] = []
    level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
    nodes = np.zeros((1, len(rows)), np.int64)
    bound = np.array([int((weights * t.value[0]).sum())])
    while len(bound):
        least = best[0] if len(best) == top else 1
        if len(bound) > opened:
            pick = np.argpartition(bound, len(bound) - opened)[len(bound) - opened :]
        else:
            pick = np.arange(len(bound))
        now = np.zeros(len(bound), bool)
        now[pick] = bound[pick] >= least
        rest = ~now & (bound >= least)
        if not now.any():
            break
        at, to, own, reach = level[now], column[now], nodes[now], bound[now]
        level, column, nodes, bound = level[rest], column[rest], nodes[rest], bound[rest]
        whole = at == t.height
        for s, c in zip(reach[whole].tolist(), to[whole].tolist(), strict=True):
            out.append((s, c))
            heapq.heappush(best, s)
            if len(best) > top:
                heapq.heappop(best)
        at, to, own = at[~whole], to[~whole], own[~whole]
        if len(at):
            half = ((rows[None, :] >> (t.height - 1 - at)[:, None]) & 1) * 2
            children = np.concatenate([t.step(own, half), t.step(own, half + 1)])
            reach = t.value[children] @ weights
            good = reach >= (best[0] if len(best) == top else 1)
            level, column = np.concatenate([level, np.concatenate([at, at])[good] + 1]), np.concatenate([column, np.concatenate([to * 2, to * 2 + 1])[good]])
            nodes, bound = np.concatenate([nodes, children[good]]), np.concatenate([bound, reach[good]])
    return out


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            _, row = _terms(part["_text"])
            yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(row))], pa.int64()), pa.array([len(row)], pa.int64())], ["documents", "terms"])

    found = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).mapInArrow(count, "documents long, terms long")
    return tuple(found.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


def index(docs: DataFrame, documents: int, terms: int, id_col: str = "doc_id", text: str = "text", block: int = blocks.BLOCK) -> DataFrame:
    """A row for each block: its terms (hashes, sorted, with their rows), how many documents hold them, the quadtree and the ids of its columns.

    documents, terms: statistics() of the corpus that scores refer to."""
    dealt = blocks.deal(docs, blocks.corpus_size(docs, text), id_col, text, block)
    kind = blocks.id_type(docs, id_col)

    def build(table: pa.Table) -> pa.Table:
        table = blocks.in_order(table)
        hashes, row = _terms(table["_text"])
        if not len(hashes):
            return pa.table({"_block": [], "_terms": [], "_df": [], "_masks": [], "_drops": [], "_ids": [], "_height": []}, pa.schema([("_block", pa.int32()), *[(c, pa.binary()) for c in ("_terms", "_df", "_masks", "_drops")], ("_ids", pa.list_(table.schema.field("_id").type)), ("_height", pa.int32())]))
        there, column = np.unique(row, return_inverse=True)
        n = np.bincount(column)
        own, which = np.unique(hashes, return_inverse=True)
        point, tf = np.unique(which * len(there) + column, return_counts=True)
        term, column = point // len(there), point % len(there)
        df = np.bincount(term)
        place = np.empty(len(own), np.int64)
        place[np.argsort(-df, kind="stable")] = np.arange(len(own))
        height, masks, drops = tree(place[term], column, impacts(tf, n[column], documents, terms))
        ids = table["_id"].take(pa.array(there)).combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table(
            [pa.array([table["_block"][0].as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in (blocks.pack_sorted(own), blocks.pack(df.astype("<u4"), place.astype("<u4")), masks, drops)], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([height], pa.int32())],
            ["_block", "_terms", "_df", "_masks", "_drops", "_ids", "_height"],
        )

    return dealt.groupBy("_block").applyInArrow(build, INDEX_SCHEMA.format(kind=kind))


def _rows_of(terms: bytes, df: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the wanted sorted hashes those in a block: their places among the wanted, documents, rows."""
    own, (count, place) = blocks.unpack_sorted(terms), blocks.unpack(df)
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    known = np.flatnonzero(own[at] == wanted)
    return known, count[at[known]].astype(np.int64), place[at[known]].astype(np.int64)


def search(indexed: DataFrame, items: DataFrame, documents: int, item: str = "item_id", text: str = "text", out_id: str = "doc_id", top: int = TOP, at_once: int = ITEMS) -> DataFrame:
    """(item, rank, out_id, score): the `top` best documents of each item. Items are answered in blocks of about at_once, each by two passes over the index."""

    def words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes, row = _terms(part["text"])
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part["item"], pa.array([np.unique(hashes[a:b]).astype("<u8").tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["item", "terms"])

    item_kind = items.schema[item].dataType
    asked = items.select(F.col(item).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(words, f"item {item_kind.simpleString()}, terms binary").groupBy("item").agg(F.collect_list("terms").alias("terms"))
    parts, out = max(1, -(-items.count() // at_once)), None
    for k in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect() if parts > 1 else asked.collect()  # about at_once stated queries
        found = _answer(indexed, [(r["item"], np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in r["terms"]]))) for r in own], documents, item_kind, top)
        out = found if out is None else out.union(found)
    order = [F.desc("score"), F.col("doc").asc_nulls_last()]
    for by in (["item", "part"], ["item"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return out.select(F.col("item").alias(item), "rank", F.col("doc").alias(out_id), "score")


def _answer(indexed: DataFrame, queries: list, documents: int, item_kind: T.DataType, top: int) -> DataFrame:
    """(item, doc, score, part) of a block of queries (item, sorted hashes of its terms): the best of each task."""
    wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for _, t in queries]]))

    def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for part in parts:
            for terms, df in zip(part["_terms"], part["_df"], strict=True):
                known, count, _ = _rows_of(terms.as_py(), df.as_py(), wanted)
                total[known] += count
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(total[known], pa.int64())], ["term", "df"])

    df = {r["term"]: r["df"] for r in indexed.select("_terms", "_df").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # of the queries' terms
    weights = np.array([weight(documents, df[k]) if k in df else 0 for k in range(len(wanted))], np.int64)
    asked = [np.searchsorted(wanted, t) for _, t in queries]
    names, id_type = pa.array([i for i, _ in queries], to_arrow_type(item_kind)), to_arrow_type(indexed.schema["_ids"].dataType.elementType)

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[int]] = [[] for _ in queries]
        kept: list[list[tuple]] = [[] for _ in queries]
        for part in parts:
            for b in range(part.num_rows):
                known, _, rows = _rows_of(part["_terms"][b].as_py(), part["_df"][b].as_py(), wanted)
                row = np.full(len(wanted), -1, np.int64)
                row[known] = rows
                t, ids = Treap(part["_height"][b].as_py(), part["_masks"][b].as_py(), part["_drops"][b].as_py()), part["_ids"][b].values
                for q, own in enumerate(asked):
                    own = own[(row[own] >= 0) & (weights[own] > 0)]
                    if len(own):
                        found = sorted(descend(t, row[own], weights[own], heaps[q], top), key=lambda x: (-x[0], x[1]))[:top]
                        values = ids.take(pa.array([c for _, c in found], pa.int64())).to_pylist()
                        kept[q] += [(-s, v is None, v, s) for (s, _), v in zip(found, values, strict=True)]
                        if len(kept[q]) > top:
                            kept[q] = sorted(kept[q], key=lambda x: x[:3] if not x[1] else (*x[:2], 0))[:top]
        who = [q for q, own in enumerate(kept) for _ in own]
        flat = [x for own in kept for x in own]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(who, pa.int64())), pa.array([x[2] for x in flat], id_type), pa.array([x[3] for x in flat], pa.int64())], ["item", "doc", "score"])

    found = indexed.mapInArrow(best, f"item {item_kind.simpleString()}, doc {indexed.schema['_ids'].dataType.elementType.simpleString()}, score long")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_PARTS)))


def stored(indexed: DataFrame) -> DataFrame:
    """The index as a table in the shared folder, so that a pass reads only the columns that it needs."""
    at = f"{shared_folder(indexed.sparkSession)}/index-{uuid.uuid4().hex}"
    indexed.write.parquet(at)
    return indexed.sparkSession.read.parquet(at)


def search_query(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each item of benchmark."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    documents, terms = statistics(docs)
    return search(stored(index(docs, documents, terms)), items, documents).select("item_id", "rank", "doc_id", "score")
