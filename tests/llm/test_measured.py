"""What SQL cannot say, against brute force or held-out labels: languages, URL verdicts, recordings, fingerprints of any ids, the pipeline."""

import random
import re

import numpy as np
import zstandard
from pyspark.sql import functions as F

from riskspark.llm import audio_fingerprint as A
from riskspark.llm import fingerprint, language_id, packing, secret_scan, substring_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text, dictionaries):
    """The language whose dictionary compresses the text best, with a compressor of its own for each."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw, sizes = text.lower().encode(), []
    for k, (name, body) in enumerate(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
        sizes.append((sum(len(z.compress(raw[i : i + language_id.STRETCH])) for i in range(0, len(raw), language_id.STRETCH)), k, name))
    sizes.sort()
    return sizes[0][2], 1 - sizes[0][0] / sizes[1][0]


def test_languages_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = language_id.train(docs.where(~language_id.held_out("doc_id", 4, 2)))
    assert len(dictionaries) == docs.select("lang").where("lang is not null").distinct().count()
    got = {r["doc_id"]: r for r in language_id.identify(docs, dictionaries).collect()}
    for r in docs.collect():
        name, share = by_hand(r["text"], dictionaries)
        assert (got[r["doc_id"]]["lang_pred"], round(got[r["doc_id"]]["score"], 9)) == (name, round(share, 9))


def test_url_classifier_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    parts = pages.select(url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path")).distinct()
    labelled = parts.withColumn("verdict", url_filter.matched(F.col("host"), F.col("path"))["verdict"]).where("verdict is not null").withColumn("held", F.pmod(F.xxhash64("path", "host"), F.lit(3)) == 0)
    model = url_filter.train(labelled.where("not held"))
    urls = labelled.where("held").select(F.concat(F.lit("http://"), "host", "path").alias("url"), F.col("verdict").alias("want"))
    said = url_filter.judge(urls, rules=(), model=model)
    right = said.agg(F.avg((F.col("want") == F.col("verdict")).cast("int")), F.count("*")).first()
    assert right[1] > 100 and right[0] >= 0.9, right


def test_urls_of_any_length_and_columns_of_any_name(spark):
    names = ["_rule", "_grams", "_vector", "_raw", "_p", "_said", "matched", "row", "a.b"]
    urls = ["http://x.com/" + "a/" * 200_000, "http://" + "h" * 200_000, None, "", "http://x.com/en/1", "http://x.com/en/1"]
    df = spark.createDataFrame([(k, u, *[f"{n}{k}" for n in names]) for k, u in enumerate(urls)], "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names))
    labelled = spark.createDataFrame([("x.com", f"/en/{k}", "block") for k in range(20)] + [("y.org", f"/fr/{k}", "allow") for k in range(20)], "host string, path string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(df, model=url_filter.train(labelled)).collect()}
    assert len(got) == 6 and all(got[k][n] == f"{n}{k}" for k in got for n in names)
    assert got[4]["verdict"] == got[5]["verdict"] == "block" and got[4]["rule"] == "com/en/" and got[0]["path"] == "/" + "a/" * 200_000


def exhaustive(a, b, least=12, most=0.2):
    """If at any offset at least so many positions in a row differ in few bits, every one of them looked at."""
    for off in range(-len(b) + least, len(a) - least + 1):
        x, y = a[max(0, off) : off + len(b)], b[max(0, -off) :]
        n = min(len(x), len(y))
        if n >= least and np.bitwise_count(x[:n] ^ y[:n]).sum() <= most * 32 * n:
            return True
    return False


def test_recall_on_noisy_recordings_against_all_offsets(spark):
    r, g = random.Random(1), np.random.default_rng(2)
    texts = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(90)) for _ in range(12)]
    clips = [(k, np.frombuffer(A.played(t), "<i2")) for k, t in enumerate(texts)]
    for k, t in enumerate(texts):  # a noisy cut of each
        pcm = np.frombuffer(A.played(" ".join(t.split()[20:75])), "<i2")
        clips.append((100 + k, pcm + g.normal(0, 150 * (1 + k), len(pcm))))
    df = spark.createDataFrame([(k, bytearray(np.clip(x, -32768, 32767).astype("<i2").tobytes())) for k, x in clips], "id long, pcm binary")
    prints = A.fingerprint(df, ["id"], "pcm")
    found = {(x["id"], x["match_class"]["id"]) for x in A.search(prints, F.col("id") >= 100, ["id"]).collect()}
    items = {x["id"]: np.frombuffer(x["items"], "<u4") for x in prints.collect()}
    want = {(q, m) for q in items if q >= 100 for m in items if exhaustive(items[m], items[q])}
    assert len(want) > 15 and len(found & want) >= 0.9 * len(want)
    assert all(q == m or q % 100 == m % 100 for q, m in found)


def test_a_common_integer_is_counted_in_bounded_steps(monkeypatch):
    silence = np.zeros(700, np.uint32)
    block = A.pa.table({"class_id": ["a", "b"], "items": [silence.tobytes(), np.arange(50, dtype=np.uint32).tobytes()]})
    whole = A._grid(block, A.pa.table({"class_id": ["q"], "items": [silence[:300].tobytes()]}))
    monkeypatch.setattr(A, "AT_ONCE", 1000)
    assert A._grid(block, A.pa.table({"class_id": ["q"], "items": [silence[:300].tobytes()]})) == whole and whole[0][:5] == ("q", "a", 0, 300, 300)


def test_fingerprints_of_ids_of_any_type(spark):
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(1, 60))) for _ in range(40)]
    ids = sorted({f"doc-{r.randrange(10**6)}" + "x" * (k % 3) for k in range(40)})
    rows = [*zip(ids, texts, strict=False), (None, "null one"), (None, None), (None, "third")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    laid = fingerprint.with_next(df, span=300)
    order = [x["_id"] for x in laid.where("not _guest").orderBy(F.desc("_range"), F.desc("_place"), F.desc("_id")).collect()]
    assert order == sorted(ids, reverse=True) + [None] * 3
    got = {x["doc_id"]: x for x in fingerprint.edited_fingerprints(df).collect()}
    text = dict(rows)
    for own, after in zip(order, order[1:], strict=False):
        if own is not None and after is not None:
            half = len(text[own]) // 2
            edited = text[own][: len(text[own]) - half] + text[after][:half]
            assert got[own]["edited_sha256"] == fingerprint.hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprint.edited_fingerprints(df).count() == len(rows)


def test_pipeline_by_hand(spark, tmp_path):
    """All stages of a small table with nulls, ties, repeats, long texts and clashing columns, one after the other in plain Python."""
    import corpus_pipeline

    r = random.Random(21)
    vocabulary = {k: [f"{a}{b}" for a in s for b in e] for k, s, e in (("en", ["th", "wh", "str", "kn"], ["ough", "ing", "ed", "ly"]), ("fr", ["qu", "ch", "beau", "l'"], ["eaux", "ille", "oir", "ette"]))}
    make = lambda n, lang="en": " ".join(r.choice(vocabulary[lang]) + r.choice("abcdefgh") for _ in range(n))
    passage = make(70)
    texts = [make(r.randrange(60, 200), ("en", "fr")[k % 2]) for k in range(60)]
    texts += [texts[0], texts[0], texts[2] + " " + make(2), passage + " " + make(90), make(80) + " " + passage, make(60) + " token=abcdef123456 " + make(9), None, "", "12 34", make(6000), passage]
    rows = [(None if k in (5, 7) else k, t, ("en", "fr")[k % 2] if k < 60 else None, "s", len(t or ""), f"x{k}") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_text` string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))

    dictionaries = language_id.train(docs)
    kept = []
    for row in docs.collect():
        name, share = by_hand(row["text"], dictionaries)
        if name != "und" and share >= language_id.MARGIN:
            kept.append([row["doc_id"], row["text"]])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (WORD.findall(t.lower()) for _, t in kept)]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    least = {}
    for k, x in enumerate(root):
        least[x] = min([k, *([least[x]] if x in least else [])], key=lambda k: (kept[k][0] is None, kept[k][0] or 0))
    kept = [kept[k] for k in sorted(least.values())]
    assert len(kept) < len(texts) - 4
    seen, cut = set(), []
    for own, text in sorted(kept, key=lambda x: (x[0] is None, x[0] or 0)):
        w = WORD.findall(text)
        gone = set()
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            gone |= set(range(k, k + 50)) if g in seen else set()
            seen.add(g)
        if len(gone) < len(w):
            cut.append((own, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text))
    assert any(len(a) < len(b) for (_, a), (_, b) in zip(cut, sorted(kept, key=lambda x: (x[0] is None, x[0] or 0)), strict=False))
    clean = [(own, re.sub(r"token=[a-z0-9]{6,}", "[SECRET]", text)) for own, text in cut]
    words = packing.word_ids(packing.public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(own), len(words.encode(text)) // 4 + 1) for own, text in clean)
    got = out.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert sorted((str(x["doc_id"]), x["doc_tokens"]) for x in got) == sorted(set(want))
    assert sum(x["n"] for x in got) == sum(n for _, n in want)
    assert secret_scan.MORE_RULES and substring_dedup.WINDOW == 20


def test_pipeline_stages_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name
