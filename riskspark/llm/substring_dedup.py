"""Removal of repeated passages by fixed-block anchors.

A passage is a window of `window` words; a window repeats an earlier one if the same words also
start at a smaller document id, or earlier in the same document. Every document is cut into
non-overlapping blocks of window // 2 words, which are the index; any window holds a whole one.
Every rolling run of as many words, of every document, is a probe. A window can only repeat if each
index block inside it is found by a probe elsewhere, so hits extend to maximal repeats: stretches
of windows of which every index block was hit. The windows of those stretches are compared by two 64-bit
hashes over the whole corpus, and all but the first of each are removed.

Index, probes and windows travel as packed arrays between blocks of documents (blocks.py).

Null and empty texts have no words and keep an empty text. Documents shorter than a window lose
nothing. A very long text is one document of its block, read in one piece. Of equal windows the one with the smallest id stays, then
the first in its document; null ids come last. Rows with the same id are documents of their own, in an order that follows
from id and text, so repeated rows lose what the first of them keeps. Ids are of any type with an order, and other columns may
have any names. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import blocks
from riskspark.llm.textwords import chunks, mix, window_starts, windows, words

WINDOW = 20
#: Turns word hashes into others, for the second hash of a window.
_SECOND = np.uint64(0xA24BAED4963EE407)


def _probes(table: pa.Table, run: int, bits: int):
    """For each chunk of texts: first row, word offsets, word hashes, run starts, run keys."""
    for i, _, data, offsets in chunks(table["_text"]):
        hashes, at = words(data, offsets)
        starts = window_starts(at, run)
        keys = windows(hashes, run)[starts] >> np.uint64(64 - bits) if len(starts) else np.zeros(0, np.uint64)
        yield i, at, hashes, starts, keys


def _in_document(at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and position in it of places among the words."""
    row = np.searchsorted(at, places, "right") - 1
    return row, places - at[row]


def _candidates(table: pa.Table, hit: np.ndarray, window: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows all of whose index blocks were hit: two hashes, row, position, in the order of the rows."""
    run, out = window // 2, []
    for i, at, hashes, starts, keys in _probes(table, run, bits):
        if not len(starts):
            continue
        good = np.zeros(len(hashes) + 1, np.int64)
        row, place = _in_document(at, starts)
        anchor = place % run == 0
        anchors = starts[anchor][~blocks.found(keys[anchor], hit)]
        good[anchors + 1] = 1  # anchors without a hit
        missed = np.cumsum(good)
        at_window = window_starts(at, window)
        if not len(at_window):
            continue
        row, place = _in_document(at, at_window)
        first = at_window + (-place) % run  # whole index blocks inside start from here up to window - run
        keep = missed[at_window + window - run + 1] == missed[first]
        where = at_window[keep]
        if len(where):
            out.append((windows(hashes, window)[where], windows(mix(hashes ^ _SECOND), window)[where], row[keep] + i, place[keep]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _repeats(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """In that order, if a place has the keys of the one before."""
    same = np.ones(len(order), bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    return same


def _marks(block: int, row: np.ndarray, place: np.ndarray) -> tuple[int, bytes]:
    """Windows to remove, in order, as differences."""
    order = np.lexsort((place, row))
    return block, blocks.pack(row[order].astype("<u4"), place[order].astype("<u4"))


def _places(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    row, place = blocks.unpack(value)
    return row.astype(np.int64), place.astype(np.int64)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = blocks.BLOCK, more: tuple[str, ...] = (), as_it_is: bool = False) -> DataFrame:
    """id_col, n_words, n_removed, kept_text (kept words joined by a space) and the columns `more`, one row for each row.

    as_it_is: a document that loses nothing keeps its text with its white space."""
    if window < 4:
        raise ValueError("a window has 4 words at least")
    total = blocks.corpus_size(docs, text)
    dealt, run = blocks.deal(docs, total, id_col, text, block, tuple(F.col(c).alias(f"_more_{c}") for c in more)), window // 2
    bits, n, n_blocks, kind = blocks.key_bits(total // 4), blocks.count_of(total), blocks.count_of(total, block), blocks.id_type(docs, id_col)

    def probe(table: pa.Table) -> pa.Table:
        keys, indexed = [], []
        for _, at, _, starts, k in _probes(table, run, bits):
            keys.append(k)
            indexed.append(_in_document(at, starts)[1] % run == 0)
        return blocks.send(table["_block"][0].as_py(), np.concatenate(keys), np.concatenate(indexed), n, bits)

    hits = blocks.repeated(dealt.groupBy("_block").applyInArrow(probe, blocks.REPEAT_SCHEMA), n, n_blocks)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"_range": [], "_block": [], "_hashes": [], "_ids": [], "_marks": []}
        if left.num_rows and right.num_rows:
            own = left["_block"][0].as_py()
            table = blocks.in_order(left)
            hashes, second, row, place = _candidates(table, blocks.answers(right)[0], window, bits)
            order = np.lexsort((np.arange(len(hashes)), second, hashes))
            again = _repeats(order, hashes, second)
            later, first = order[again], np.sort(order[~again])
            if len(later):  # the first one is in this block, so these go in any case
                out["_range"].append(-1 - own)
                out["_block"].append(own)
                out["_hashes"].append(None)
                out["_ids"].append(None)
                out["_marks"].append(_marks(own, row[later], place[later])[1])
            hashes, second, row, place = hashes[first], second[first], row[first], place[first]
            to = (hashes % np.uint64(n)).astype(np.int64)
            for k in np.unique(to).tolist():
                mine = to == k
                out["_range"].append(k)
                out["_block"].append(own)
                out["_hashes"].append(blocks.pack(hashes[mine], second[mine]))
                out["_ids"].append(table["_id"].take(pa.array(np.unique(row[mine]))).to_pylist())  # one for each row
                out["_marks"].append(blocks.pack(row[mine].astype("<u4"), place[mine].astype("<u4")))
        return pa.table(out, pa.schema([("_range", pa.int32()), ("_block", pa.int32()), ("_hashes", pa.binary()), ("_ids", pa.list_(left.schema.field("_id").type)), ("_marks", pa.binary())]))

    candidates = dealt.groupBy("_block").cogroup(hits.groupBy("_block")).applyInArrow(extend, f"_range int, _block int, _hashes binary, _ids array<{kind}>, _marks binary")

    def firsts(table: pa.Table) -> pa.Table:
        if table["_hashes"][0].as_py() is None:
            return table.select(["_block", "_marks"])
        table = table.sort_by("_block")
        hashes, second = (np.concatenate(x) for x in zip(*[blocks.unpack(x) for x in table["_hashes"].to_pylist()], strict=True))
        ids = table["_ids"].combine_chunks()
        rank = pc.rank(ids.values, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        edges, places, who = ids.offsets.to_numpy(), [_places(x) for x in table["_marks"].to_pylist()], []
        for k, (own, _) in enumerate(places):
            who.append(rank[edges[k] : edges[k + 1]][np.searchsorted(np.unique(own), own)])
        row, place = (np.concatenate(x) for x in zip(*places, strict=True))
        source = np.repeat(np.arange(len(places)), [len(own) for own, _ in places])
        order = np.lexsort((place, row, source, np.concatenate(who), second, hashes))
        later = order[_repeats(order, hashes, second)]
        names, out = table["_block"].to_pylist(), []
        for s in np.unique(source[later]).tolist():
            mine = later[source[later] == s]
            out.append(_marks(names[s], row[mine], place[mine]))
        return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())], ["_block", "_marks"])

    marks = candidates.repartitionById(n, "_range").groupBy("_range").applyInArrow(firsts, "_block int, _marks binary").repartitionById(n_blocks, "_block")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        table = blocks.in_order(left)
        places = [_places(x) for x in right["_marks"].to_pylist()]
        row = np.concatenate([p[0] for p in places]) if places else np.zeros(0, np.int64)
        place = np.concatenate([p[1] for p in places]) if places else np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
        edges = np.searchsorted(row, np.arange(table.num_rows + 1))
        n_words, n_removed, kept = [], [], []
        for k, body in enumerate(table["_text"].to_pylist()):
            own = body.encode().split()
            own_places = place[edges[k] : edges[k + 1]]
            n_words.append(len(own))
            if not len(own_places):
                n_removed.append(0)
                kept.append(body.encode() if as_it_is else b" ".join(own))
                continue
            step = np.bincount(own_places, minlength=len(own) + 1)[: len(own) + 1] - np.bincount(own_places + window, minlength=len(own) + 1)[: len(own) + 1]
            stay = np.cumsum(step)[: len(own)] == 0
            n_removed.append(len(own) - int(stay.sum()))
            kept.append(b" ".join([own[x] for x in np.flatnonzero(stay).tolist()]))
        names = [f"_more_{c}" for c in more]
        return pa.table([table["_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *[table[c] for c in names]], ["_id", "n_words", "n_removed", "kept_text", *names])

    fields = "".join(f", `_more_{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    out = dealt.groupBy("_block").cogroup(marks.groupBy("_block")).applyInArrow(remove, f"_id {kind}, n_words long, n_removed long, kept_text string{fields}")
    return out.withColumnRenamed("_id", id_col).withColumnsRenamed({f"_more_{c}": c for c in more})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """The documents and their columns without repeated passages; a document of which every word goes, goes. A null text is an empty one then."""
    others = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in (id_col, text)}  # their names may be ours
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(own) for c, own in others.items()])
    out = dedup(rows, "id", "text", window, more=tuple(others.values()), as_it_is=True)
    out = out.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    new = {id_col: F.col("id"), text: F.col("kept_text")} | {c: F.col(own) for c, own in others.items()}
    if chars in docs.columns:
        new[chars] = F.length("kept_text").cast(docs.schema[chars].dataType)
    return out.select(*[new[c].alias(c) for c in docs.columns])


def substring_query(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated windows of 20 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
