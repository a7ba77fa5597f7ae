"""Harmonic packing of tokenized documents into sequences of one capacity.

A document's ids (with the end id) are cut into whole sequences, then by the reciprocal
capacities C/2, C/4, ... down to the tail size, and a tail. Lengths in (C/(k+1), C/k] are
class k, whose bins hold exactly k pieces. Each partition fills its own bins, so no row is
shuffled. What is left in bins that are not full at the end of a partition is laid end to end,
cut at the capacity, and the last stretch is cut into powers of two, which need no padding.

A text is read as the tokenizer file says, its added tokens included (a text that holds one is given to the whole tokenizer).

Null texts count as empty: their one id is the end id. Long texts give many pieces, and only pieces that wait for a bin
are kept. Pieces of one class fill bins in the order of the rows; sequence numbers depend on how the rows are partitioned. Repeated
rows, and rows with null or equal ids, are packed like others. Other columns are left out and may have any names. An empty table gives no rows."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, TAIL, END_ID = 2048, 128, 1
#: Most words and pieces of words whose ids a worker keeps; it then starts anew.
MOST_CACHED = 200_000

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sA-Za-z0-9ª²³µ¹º¼-¾À-ÖØ-öø-ɏ]+")
_PLAIN = re.compile(r"[!-~¡-¬®-įĲ-ɏ]+")


#: Settings of a tokenizer file under which words may be encoded apart: NFC, blanks to one, lower case; the cut of _CUT, bytes as letters.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def _by_words(settings: dict) -> bool:
    """If a tokenizer file has these settings; with others the whole tokenizer reads every text."""
    normal, before, model = settings.get("normalizer") or {}, (settings.get("pre_tokenizer") or {}).get("pretokenizers", []), settings["model"]
    cut = [p for p in before if p.get("type") == "Split" and p.get("pattern") == _SPLIT and p.get("behavior") == "Removed" and p.get("invert")]
    letters = [p for p in before if p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex")]
    return normal.get("normalizers") == _NORMALIZER and len(before) == 2 and before == cut + letters and model.get("type") == "BPE" and not model.get("dropout")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """Ids of a word (text without blanks) as little-endian 32-bit bytes, kept as they are met.

    Words of Latin letters are lower-cased and cut as the tokenizer's own settings say, and their parts
    go to its model; the whole tokenizer takes any other word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            settings = json.load(f)
        added = [t["content"] for t in settings.get("added_tokens", [])]
        normal = any(t["normalized"] for t in settings.get("added_tokens", []))  # such a token may be met in any case
        self.fast = _by_words(settings) and not normal
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.parts: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            text = unicodedata.normalize("NFC", word).lower()
            ids = b"".join([self.parts[x] if x in self.parts else self.part(x) for x in _CUT.findall(text)])
        else:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def part(self, text: str) -> bytes:
        mapped = text if text.isascii() else "".join(self.letters[b] for b in text.encode())
        ids = self.parts[text] = np.array([t.id for t in self.whole.model.tokenize(mapped)], "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > MOST_CACHED:
            self.clear()
            self[""] = b""
        if len(self.parts) > MOST_CACHED:
            self.parts.clear()
        if not self.fast or self.added and self.added.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Lengths of a document's pieces, in order: whole sequences, halves, quarters, ..., the tail."""
    out, rest = [capacity] * (n // capacity), n % capacity
    part = capacity // 2
    while part >= tail:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """Open bins of one partition. A piece is (document's id, start, ids as bytes, tokens of the document)."""

    def __init__(self, capacity: int, tail: int, first: int):
        self.capacity, self.tail, self.next = capacity, tail, first
        self.open: dict[int, list] = {}

    def add(self, piece: tuple) -> list[tuple]:
        """Pieces that are now placed: (piece, sequence, offset)."""
        k = self.capacity // (len(piece[2]) // 4)
        self.open.setdefault(k, []).append(piece)
        return self.close(self.open.pop(k)) if len(self.open[k]) == k else []

    def close(self, pieces: list) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((p, self.next, at))
            at += len(p[2]) // 4
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        """Place what is left, cutting at the capacity and at last at powers of two."""
        left = deque(p for k in sorted(self.open) for p in self.open[k])
        self.open = {}
        total, out = sum(len(p[2]) // 4 for p in left), []
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> b & 1]
        for size in sizes:
            own = []
            while size:
                d, start, body, tokens = left.popleft()
                n = min(len(body) // 4, size)
                own.append((d, start, body[: 4 * n], tokens))
                if len(body) > 4 * n:
                    left.appendleft((d, start + n, body[4 * n :], tokens))
                size -= n
            out += self.close(own)
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, tail: int = TAIL, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids: the piece's ids as little-endian 32-bit integers, null unless with_ids. A sequence's number has its partition in
    the upper bits, so partitions need not know of each other."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins = word_ids(path), Bins(capacity, tail, TaskContext.get().partitionId() << 36)
        out: list[tuple] = []

        def place(placed: list[tuple]) -> None:
            for (doc, start, own, tokens), seq, at in placed:
                out.append((doc, start, len(own) // 4, zlib.crc32(own), tokens, seq, at, own if with_ids else None))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        names, types = None, None
        for b in batches:
            types = [b.schema.field(0).type, *[pa.int64()] * 6, pa.binary()]
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            for own, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = words.encode(body) + end
                tokens, start = len(ids) // 4, 0
                for n in cuts(tokens, capacity, tail):
                    place(bins.add((own, start, ids[4 * start : 4 * (start + n)], tokens)))
                    start += n
                if len(out) >= 20_000:
                    yield batch()
        if types is not None:
            place(bins.rest())
            yield batch()

    return rows.mapInArrow(fill, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)


def unpack(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document's ids again: id_col, ids (array of int), from pieces with ids."""
    grouped = pieces.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("_p"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "ids": [np.frombuffer(b"".join(bytes(x["ids"]) for x in p), "<u4").astype("int32") for p in b["_p"]]})

    return grouped.mapInPandas(join, f"{id_col} {pieces.schema[id_col].dataType.simpleString()}, ids array<int>")


def packing_query(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, with_ids=False).drop("ids")
