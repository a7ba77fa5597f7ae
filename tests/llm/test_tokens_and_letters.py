"""Added tokens as the tokenizer reads them, and letters as Unicode has them."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskspark.llm import language_id, packing

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "a", "It's", "don'T", "I'LL", "É", "é", "ß", "ǅ", "½", "²", "Ⅷ", "①", "中文", "é1", "　", "\xa0", "​", "12", "...", "#", "ﬁ", "İ", "\x1c", "ͅ", "'"]


def test_random_texts_against_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own, r = Tokenizer.from_file(path), packing.WordIds(path), random.Random(4)
    assert own.fast
    for _ in range(8000):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(9)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_another_tokenizer_file_is_read_as_a_whole(tmp_path):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    from tokenizers.normalizers import NFC

    whole.normalizer = NFC()
    whole.save(str(tmp_path / "other.json"))
    own = packing.WordIds(str(tmp_path / "other.json"))
    assert not own.fast and np.frombuffer(own.encode("Some TEXT"), "<u4").tolist() == whole.encode("Some TEXT", add_special_tokens=False).ids


@pytest.mark.parametrize(("text", "letter"), [("½ ² Ⅷ ① 12 _ -", False), ("Ⅷa", True), ("٣", False), ("é", True), ("中", True), ("ª", True), ("", False), ("😀", False)])
def test_letters(text, letter):
    assert language_id.has_letter(text) is letter


def test_texts_without_letters_are_und(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "½ Ⅷ ①", None), (None, None, None), (3, "", "en")], "doc_id long, text string, lang string")
    said = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(df, language_id.train(df)).collect() if r["lang_pred"] == "und"]
    assert sorted(said, key=str) == [(3, "und", 0.0), (3, "und", 0.0), (None, "und", 0.0)]


def test_a_column_of_other_labels_is_refused(spark):
    df = spark.createDataFrame([(k, "some text", f"label {k}") for k in range(6)], "doc_id long, text string, lang string")
    assert len(language_id.train(df)) == 6
    with pytest.raises(ValueError, match="distinct labels"):
        language_id.train(df, languages=5)


def test_packing_of_null_repeated_and_long_texts(spark):
    rows = [(None, None), (1, "word " * 30_000), (1, "word"), (1, "word"), (None, "<|endoftext|> x")]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sum(r["length"] for r in pieces) == 1 + 30_001 + 2 + 2 + 3
    used = {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
