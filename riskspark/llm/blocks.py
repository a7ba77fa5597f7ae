"""Blocks of documents and the exchange of hashed keys between them.

Several operators ask of every word window of the corpus whether it also occurs elsewhere. Rows
of one window each would cost many times the input in shuffled bytes. Instead documents are dealt
into blocks of bounded size by a hash; each block sends its distinct key hashes,
sorted and packed, to the ranges of the key space, and each range answers each block with the keys
that matter. A key in a third of all documents is one key per block, so no range is hot.

A row of documents is (_block, _id, _text). Blocks and ranges are numbered and each is one partition, so the size
of a task does not depend on the number of shuffle partitions. The block follows from id, text and the columns carried along, so rows with a
null or a common id are spread; only rows that are equal in all of these share a block. Ids may be of any type that has an order; null
sorts after all others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a block, about.
BLOCK = 8_000_000


def corpus_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in all documents: one number, by an aggregate."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def count_of(total: int, block: int = BLOCK) -> int:
    """Blocks (or ranges) that so many bytes need."""
    return max(8, -(-total // block))


def deal(docs: DataFrame, total: int, id_col: str = "doc_id", text: str = "text", block: int = BLOCK, more: tuple[str, ...] = ()) -> DataFrame:
    """(_block, _id, _text) and more columns of all documents, each block in its own partition."""
    n = count_of(total, block)
    spread = F.xxhash64(F.col(id_col), F.col(text), *more)
    rows = docs.select(F.pmod(spread, F.lit(n)).cast("int").alias("_block"), F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *more)
    return rows.repartitionById(n, "_block")


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows by id (null last), then text."""
    return table.sort_by([("_id", "ascending"), ("_text", "ascending")])


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Integer arrays as one compressed value; the bytes of equal rank lie together."""
    z, out = zstandard.ZstdCompressor(level=level), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = z.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
        out.append(np.array([len(a), a.itemsize, len(body)], "<u4").tobytes() + body)
    return b"".join(out)


def unpack(value: bytes) -> list[np.ndarray]:
    z, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(value):
        n, width, size = np.frombuffer(value, "<u4", 3, at).tolist()
        body = np.frombuffer(z.decompress(value[at + 12 : at + 12 + size], max_output_size=max(1, n * width)), np.uint8)
        out.append(np.ascontiguousarray(body.reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += 12 + size
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as differences."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)
    low, high = (steps & np.uint64(0xFFFFFFFF)).astype("<u4"), (steps >> np.uint64(32)).astype("<u4")
    return pack(low, high)


def unpack_sorted(value: bytes) -> np.ndarray:
    low, high = unpack(value)
    return np.cumsum(low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32)), dtype=np.uint64)


def key_bits(total: int) -> int:
    """Bits of a key hash, so that a key of the corpus meets another one's hash once in 2**14 at most."""
    return min(64, int(np.ceil(np.log2(max(total, 2)))) + 14)


def found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each key, if it is in the sorted array."""
    if not len(among):
        return np.zeros(len(keys), bool)
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.minimum(np.searchsorted(among, keys[order]), len(among) - 1)
    return among[at] == keys


def ranges(sorted_keys: np.ndarray, n: int, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, one past the last) of the sorted keys over n equal ranges of the key space."""
    width = ((1 << bits) + n - 1) // n
    edges = np.searchsorted(sorted_keys, np.array([min(k * width, (1 << 64) - 1) for k in range(1, n)], np.uint64)) if n > 1 else np.zeros(0, int)
    edges = [0, *edges.tolist(), len(sorted_keys)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


REPEAT_SCHEMA = "_range int, _block int, _keys binary, _flags binary"
ANSWER_SCHEMA = "_block int, _keys binary, _counts binary"
_MOST = 32_767  # counts are held down to this


def send(block: int, keys: np.ndarray, indexed: np.ndarray, n: int, bits: int) -> pa.Table:
    """A block's keys for repeated(): each distinct one, how often it occurs here, if it is indexed."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1))) if len(keys) else np.zeros(0, int)
    flags = np.minimum(np.diff(first, append=len(keys)), _MOST).astype(np.uint16) << np.uint16(1)
    if len(first):
        flags |= np.maximum.reduceat(indexed[order].astype(np.uint16), first)
    keys = keys[first]
    parts = ranges(keys, n, bits)
    return pa.table(
        [pa.array([k for k, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int32()), pa.array([pack_sorted(keys[a:b]) for _, a, b in parts], pa.binary()), pa.array([pack(flags[a:b]) for _, a, b in parts], pa.binary())],
        ["_range", "_block", "_keys", "_flags"],
    )


def repeated(sent: DataFrame, n: int, blocks: int) -> DataFrame:
    """Answers (_block, _keys, _counts): its keys that occur at least twice in the corpus and are indexed somewhere, and how often they occur.

    n: ranges; blocks: blocks, in whose partitions the answers lie."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        blocks = table["_block"].to_pylist()
        keys = [unpack_sorted(x) for x in table["_keys"].to_pylist()]
        flag = np.concatenate([unpack(x)[0] for x in table["_flags"].to_pylist()])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every, flag = every[order], flag[order]
        first = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint64(1)))
        count = np.add.reduceat((flag >> np.uint16(1)).astype(np.int64), first)
        good = (count > 1) & (np.bitwise_or.reduceat(flag, first) & np.uint16(1) > 0)
        mine, count = every[first][good], np.minimum(count[good], 2 * _MOST).astype("<u2")
        out = []
        for b, own in zip(blocks, keys, strict=True):
            own = own[found(own, mine)]
            if len(own):
                out.append((b, pack_sorted(own), pack(count[np.searchsorted(mine, own)])))
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["_block", "_keys", "_counts"])

    return sent.repartitionById(n, "_range").groupBy("_range").applyInArrow(answer, ANSWER_SCHEMA).repartitionById(blocks, "_block")


def answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a block's answers, sorted, and how often they occur in the corpus."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    keys = np.concatenate([unpack_sorted(x) for x in table["_keys"].to_pylist()])
    counts = np.concatenate([unpack(x)[0] for x in table["_counts"].to_pylist()])
    order = np.argsort(keys)
    return keys[order], counts[order]
