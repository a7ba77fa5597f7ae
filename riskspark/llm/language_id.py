"""Language identification by compression.

Each language has a dictionary of raw text; a text is compressed by zstandard with each of them, and
the language whose dictionary gives the fewest bytes is the answer. A narrow margin between the best two
rejects the answer. Texts are lower-cased and compressed in stretches of a few thousand bytes, so that the
dictionary counts all along a long text; all stretches of the whole text are taken.

Dictionaries are fitted on a bounded sample of labelled rows (PIECES pieces of PIECE characters for each language, chosen
by the hash of the id and cut at a hashed place). Labels may be wrong: pieces that the dictionaries of the
other pieces give to another language are left out.

A null text or one without a letter (Unicode's; digits, fractions and circled numbers are none) is `und`, score 0, and rejected.
Empty tables give no rows; a table without any labelled text gives `und` everywhere. Ties go to the more frequent language, and
among equally frequent ones to the first by name. A very long text is compressed stretch by stretch, all of it. Repeated rows, and
rows with null or equal ids, are judged alike. Columns of the rows may have any names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Documented bounds of the training sample. Every language with a labelled text is learned; a column with more
#: distinct labels than LANGUAGES is no column of languages and is refused.
PIECES, PIECE, LANGUAGES = 160, 600, 1000
LEVEL, MARGIN, STRETCH = 9, 0.003, 4096
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: str, parts: int, part: int) -> Column:
    """If the crc32 of the id's text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", pieces: int = PIECES, piece: int = PIECE, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language, the most frequent one first."""
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.xxhash64(F.lit(7), F.col(id_col)).alias("_hash"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"{lang} has over {languages} distinct labels")
    if not counts:
        return {}
    share = F.lit(0.0)  # of each language's rows, about twice as many as are wanted
    for r in counts:
        share = F.when(F.col("_lang") == r["_lang"], F.lit(min(1.0, 2.0 * pieces / r["count"]))).otherwise(share)
    near = rows.where(F.pmod(F.col("_hash"), F.lit(1 << 20)) < share * (1 << 20))
    start = F.pmod(F.xxhash64(F.lit(8), F.col("_hash")), F.greatest(F.lit(1), F.length("_text") - piece)).cast("int")
    near = near.select("_lang", "_hash", F.substring("_text", start + 1, F.lit(piece)).alias("_piece"))
    order = Window.partitionBy("_lang").orderBy("_hash", "_piece")  # over the sample only
    out: dict[str, list[bytes]] = {r["_lang"]: [] for r in counts}  # the most frequent one first
    for r in near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= pieces).orderBy("_lang", F.desc("_n")).collect():
        out[r["_lang"]].append(r["_piece"].lower().encode())
    for _ in range(2):
        out = _agreed(out)
    return {k: b"\n".join(v) for k, v in out.items() if v}


def coders(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name, raw in dictionaries.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((name, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def best(raw: bytes, own: list, stretch: int = STRETCH) -> tuple[str, float]:
    """The language with the fewest bytes, and how much fewer they are than the next one's, as a share."""
    parts = [raw[i : i + stretch] for i in range(0, len(raw), stretch)]
    sizes = sorted((sum(len(c.compress(x)) for x in parts), k) for k, (_, c) in enumerate(own))
    return own[sizes[0][1]][0], 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def _agreed(pieces: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """The pieces of each language that the other half of the pieces gives to it."""
    out: dict[str, list[bytes]] = {k: [] for k in pieces}
    for half in (0, 1):
        own = coders({k: b"\n".join(v[1 - half :: 2]) for k, v in pieces.items() if v[1 - half :: 2]})
        for k, v in pieces.items():
            out[k] += [x for x in v[half::2] if not own or best(x, own)[0] == k]
    return {k: v or pieces[k] for k, v in out.items()}


def has_letter(text: str) -> bool:
    """If any character is a letter; the pattern finds those and other numbers than digits."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def tag(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", out: str = "_language", level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """All columns of docs, and `out`, a struct of lang_pred, score and accepted (it replaces a column of that name).
    No shuffle; the dictionaries have the bounded size of train()."""
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower()]
    inner = [f"c{k}" for k in range(len(kept))]  # the columns' own names may be ours
    rows = docs.select(*[F.col(f"`{f.name}`").alias(c) for f, c in zip(kept, inner, strict=True)], F.col(text).alias("text"))
    judged = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*[T.StructField(c, f.dataType) for f, c in zip(kept, inner, strict=True)], T.StructField("judged", judged)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coders(dictionaries, level)
        for b in batches:
            said, score = [], []
            for body in b.column(len(inner)).to_pylist():
                if not own or body is None or not has_letter(body):
                    said.append("und")
                    score.append(0.0)
                    continue
                name, share = best(body.lower().encode(), own)
                said.append(name)
                score.append(share)
            both = pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], both], [*inner, "judged"])

    accepted = (F.col("judged.lang_pred") != "und") & (F.col("judged.score") >= margin)
    said = F.struct("judged.lang_pred", "judged.score", accepted.alias("accepted")).alias(out)
    return rows.mapInArrow(judge, schema).select(*[F.col(c).alias(f.name) for f, c in zip(kept, inner, strict=True)], said)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text: str = "text", level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """id_col, lang_pred, score, accepted for each row."""
    found = tag(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), dictionaries, "_text", "_language", level, margin)
    return found.select(F.col("_id").alias(id_col), "_language.*")


def language_query(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs.where(~held_out("doc_id", 4, 2))))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")
