"""Byte-level BPE by a global shuffle of distinct words.

A word is a piece of text from one blank to the next, with the blank before it; the split pattern
never matches across such a cut, so the words of a text can be encoded apart. Each segment of
documents is exploded into words with positions; its distinct words go, packed, to the ranges of the
words' hash, where each distinct word is encoded once (every match of the pattern separately). The
ids come back to the segment and are laid out by position. Decoding joins ids with the token bytes: within the task of a segment,
once for each distinct word (encode), or by a join of a table of ids (decode).

A frequent word travels once per segment, so none is hot. Segments and ranges have a bounded number of
characters, so there are more of them for more text. Null texts count as empty and have no ids; long texts make a segment of their own;
repeated rows, and rows with null or equal ids, are encoded like others; ids are of any type; other columns are left out and may have
any names; an empty table gives no rows."""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.blocks import corpus_size, count_of, pack, unpack

#: Characters of text in a segment, about, and bytes of text for a range of words.
SEGMENT, RANGE = 32_000_000, 16_000_000
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_known: dict = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _coder(path: str, pattern: str):
    if path not in _known:
        import tiktoken

        own = ranks(path)
        table = np.empty(max(own.values()) + 1, object)
        table[:] = b""
        for token, k in own.items():
            table[k] = token
        _known[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={}), table
    return _known[path]


def cut(text: str) -> list[str]:
    """The words of a text; each but the first has a blank before it that is left out."""
    if text.isascii() and not ("  " in text or "\n " in text or "\t " in text or "\r " in text or "\x0b " in text or "\x0c " in text):
        return text.split(" ")
    return _BLANK.split(text)


class Segment:
    """Documents as indices into their distinct words."""

    def __init__(self):
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.docs: list = []
        self.sizes: list[int] = []
        self.places: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc, text: str) -> None:
        own = cut(text)
        own[0] = (own[0],)  # a first word has no blank: another key than the same letters elsewhere
        self.places.append(np.fromiter(map(self.words.__getitem__, own), np.uint32, len(own)))
        self.docs.append(doc)
        self.sizes.append(len(own))
        self.chars += len(text)

    def rows(self, number: int, ranges: int) -> list[tuple]:
        """(range, segment, part, documents, body): one row with positions, and one for each range of words."""
        words = [(w[0] if isinstance(w, tuple) else " " + w).encode("utf-8", "surrogatepass") for w in self.words]
        places = np.concatenate(self.places)
        order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        words, places = [words[i] for i in order.tolist()], rank[places]
        at = np.fromiter((xxhash.xxh3_64_intdigest(w) % ranges for w in words), np.int64, len(words))
        z = zstandard.ZstdCompressor(level=3)
        body = pack(places, np.array(self.sizes, "<u4"), at.astype("<u2") if ranges <= 1 << 16 else at.astype("<u4"), level=6)
        out = [(-1 - number, number, -1, self.docs, body)]
        for k in np.unique(at).tolist():
            own = [words[i] for i in np.flatnonzero(at == k).tolist()]
            sizes = pack(np.array([len(w) for w in own], "<u4"))
            out.append((k, number, k, None, np.array([len(sizes)], "<u4").tobytes() + sizes + z.compress(b"".join(own))))
        return out


def _words(body: bytes) -> list[bytes]:
    n = int(np.frombuffer(body, "<u4", 1)[0])
    sizes, text = unpack(body[4 : 4 + n])[0], zstandard.ZstdDecompressor().decompress(body[4 + n :])
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, segment: int = SEGMENT, decode: bool = True) -> DataFrame:
    """id_col, n_tokens, ids (little-endian 32-bit integers) and, if asked for, decoded (bytes)."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    total = corpus_size(docs, text)
    ranges, segments = count_of(total, RANGE), count_of(total, segment)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, id_type = TaskContext.get().partitionId() << 24, Segment(), None

        def out() -> pa.RecordBatch:
            columns = list(zip(*own.rows(number, ranges), strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_range", "_segment", "_part", "_docs", "_body"])

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.add(doc, body)
                if own.chars >= segment:
                    yield out()
                    number, own = number + 1, Segment()
        if own.docs:
            yield out()

    def once(table: pa.Table) -> pa.Table:
        table = table.select(["_segment", "_part", "_docs", "_body"])
        if table["_part"][0].as_py() < 0:  # positions wait for the ids of their words
            return table
        coder, known, bodies = _coder(path, pattern)[0], {}, []
        z = zstandard.ZstdCompressor(level=3)
        for body in table["_body"].to_pylist():
            own = _words(body)
            new = [w for w in own if w not in known]
            ids = coder.encode_ordinary_batch([w.decode("utf-8", "surrogatepass") for w in new], num_threads=1)
            known.update(zip(new, ids, strict=True))
            own = [known[w] for w in own]
            sizes = np.fromiter(map(len, own), "<u4", len(own))
            flat = np.fromiter(chain.from_iterable(own), "<u4", int(sizes.sum()))
            head = pack(sizes)
            bodies.append(np.array([len(head)], "<u4").tobytes() + head + z.compress(flat.astype("<u2" if flat.max(initial=0) < 1 << 16 else "<u4").tobytes()))
        return table.set_column(3, "_body", pa.array(bodies, pa.binary()))

    def lay(table: pa.Table) -> pa.Table:
        part = table["_part"].to_pylist()
        head, body = part.index(-1), table["_body"].to_pylist()
        places, sizes, at = unpack(body[head])
        starts, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        flats, offset = [], 0
        for k, value in zip(part, body, strict=True):
            if k < 0:
                continue
            n = int(np.frombuffer(value, "<u4", 1)[0])
            own, raw = unpack(value[4 : 4 + n])[0].astype(np.int64), zstandard.ZstdDecompressor().decompress(value[4 + n :])
            total = int(own.sum())
            flat = np.frombuffer(raw, "<u2" if len(raw) == 2 * total else "<u4").astype("<u4")
            mine = at == k
            counts[mine] = own
            starts[mine] = np.cumsum(own) - own + offset
            flats.append(flat)
            offset += total
        flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
        if decode:
            tokens = _coder(path, pattern)[1]
            pieces = tokens[flat]
            texts = [b"".join(pieces[s : s + c]) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
        n_tokens, ids, decoded, done = [], [], [], 0
        for size in sizes.tolist():
            own = places[done : done + size].astype(np.int64)
            done += size
            n = counts[own]
            total = int(n.sum())
            shift = np.repeat(starts[own] - (np.cumsum(n) - n), n)
            n_tokens.append(total)
            ids.append(flat[shift + np.arange(total)].tobytes())
            decoded.append(b"".join([texts[i] for i in own.tolist()]) if decode else None)
        docs = table["_docs"][head].values
        return pa.table([docs, pa.array(n_tokens, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["_id", "n_tokens", "ids", "decoded"])

    sent = rows.mapInArrow(explode, f"_range long, _segment long, _part long, _docs array<{kind}>, _body binary")
    seat = (F.shiftright("_segment", 24) + F.col("_segment").bitwiseAND(F.lit((1 << 24) - 1))).cast("int")  # segments side by side
    dealt = sent.withColumn("_to", F.when(F.col("_range") >= 0, F.col("_range").cast("int")).otherwise(seat)).repartitionById(ranges, "_to")
    encoded = dealt.groupBy("_to", "_range").applyInArrow(once, f"_segment long, _part long, _docs array<{kind}>, _body binary")
    out = encoded.withColumn("_seat", seat).repartitionById(segments, "_seat").groupBy("_seat", "_segment").applyInArrow(lay, f"_id {kind}, n_tokens long, ids binary, decoded binary")
    return (out if decode else out.drop("decoded")).withColumnRenamed("_id", id_col)


def token_table(spark, path: str | None = None) -> DataFrame:
    """(token_id, token_bytes) of a vocabulary, whose size bounds it."""
    own = ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return spark.createDataFrame([(k, bytearray(t)) for t, k in own.items()], "token_id int, token_bytes binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """id_col, decoded (bytes), by a join of each id with the token table, in the order of positions.

    ids: array of int. Rows are told apart by id_col."""
    tokens = F.broadcast(token_table(encoded.sparkSession, path))  # as many rows as the vocabulary has tokens
    each = encoded.select(id_col, F.posexplode(ids).alias("_at", "token_id")).join(tokens, "token_id")
    joined = each.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", F.hex("token_bytes").alias("_hex")))).alias("_all"))
    out = joined.select(id_col, F.unhex(F.array_join(F.transform("_all", lambda x: x["_hex"]), "")).alias("decoded"))
    return encoded.select(id_col).join(out, id_col, "left").withColumn("decoded", F.coalesce("decoded", F.lit(b"")))


def bpe_query(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
