"""Support vectors, ranked search and phrases against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskspark.llm import collocations, quality, ranked_search

SCHEMA = "doc_id long, text string, lang string, _id string, _block string, term string, rank int, score double, _row string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def make_rows():
    r = random.Random(3)
    words = [a + b for a in ("the", "of", "ra", "é", "ko") for b in ("", "n", "st", "9", "ß", "ü", "ing")]
    line = lambda n: " ".join(r.choice(words[: r.choice([4, 12, 35])]) + r.choice(["", "", "", ",", ".", "\t", "  ", ";\n"]) for _ in range(n))
    texts = [None, "", " \t\n", "...,;", "one", "The THE the", "İK ẞ É é", "a\x00b\x0bc\x0cd", line(9000)] + [line(r.randrange(1, 150)) for _ in range(120)]
    texts += ["same words in a row here, again"] * 12 + ["x " * 700, " ко те ра " * 4]
    rows = [(i, t, [None, "en", "fr", "und"][i % 4], "a", "b", "c", 1, 0.5, "d") for i, t in enumerate(texts)]
    return rows + [rows[10]] * 3 + [(None, texts[11], "en", "a", "b", "c", 1, 0.5, "d"), (None, texts[12], None, "a", "b", "c", 1, 0.5, "d")]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def brute_search(rows, items, top):
    terms = [TERM.findall((r[1] or "").translate(UPPER)) for r in rows]
    documents, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    out = []
    for item, text in items:
        found = []
        for row, t in zip(rows, terms, strict=True):
            tf, score = Counter(t), 0
            for x in set(TERM.findall((text or "").translate(UPPER))) & tf.keys():
                m = 50 + (50 * len(t) * documents) // total
                score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m))
            if score > 0:
                found.append((-score, row[0] is None, row[0] or 0, row[0]))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return out


@pytest.mark.parametrize(("block", "at_once"), [(1200, 256), (400, 3), (10**7, 256)])
def test_search_is_exact(spark, docs, rows, block, at_once):
    items = [(0, "the ofn RAst"), (1, "unknown"), (2, None), (3, ""), (4, "é; é koü the"), (5, "same words in a row here again"), (6, "9 one x THE of ra é ko the9 ofing"), (7, rows[8][1])]
    documents, terms = ranked_search.statistics(docs)
    indexed = ranked_search.index(docs, documents, terms, block=block).cache()
    got = ranked_search.search(indexed, spark.createDataFrame(items, "item_id long, text string"), documents, top=7, at_once=at_once).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_search(rows, items, 7), key=str)


def test_search_of_text_ids_and_empty_tables(spark, docs, rows):
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    documents, terms = ranked_search.statistics(named)
    items = spark.createDataFrame([("q", "the ra"), ("q", "koing"), (None, "é")], "item_id string, text string")
    got = ranked_search.search(ranked_search.index(named, documents, terms, block=900), items, documents).collect()
    own = list({r[0]: (f"d{r[0]:04d}", *r[1:]) for r in rows if r[0] is not None}.values())
    want = [(i, k, d, s) for i, k, d, s in brute_search(own, [("q", "the ra koing"), (None, "é")], 50)]
    assert sorted([(r[0], r[3]) for r in got], key=str) == sorted([(r[0], r[3]) for r in want], key=str)
    none = docs.limit(0)
    assert ranked_search.statistics(none) == (0, 0)
    assert ranked_search.search(ranked_search.index(none, 0, 0), items, 0).collect() == []
    assert ranked_search.search(ranked_search.index(docs, documents, terms), items.limit(0), documents).collect() == []


def test_treap_holds_its_grid():
    g = np.random.default_rng(2)
    for side in (1, 2, 40):
        cells = np.unique(g.integers(0, side * side, side * 2 + 1))
        row, column, value = cells // side, cells % side, g.integers(1, 10**6, len(cells))
        t = ranked_search.Treap(*ranked_search.tree(row, column, value))
        assert t.value[0] == value.max()
        for r in range(side):
            found = dict(x[::-1] for x in ranked_search.descend(t, np.array([r]), np.array([1]), [], side, opened=3))
            assert found == {int(c): int(v) for rr, c, v in zip(row, column, value, strict=True) if rr == r}


def test_few_ranges_are_opened_where_few_can_matter():
    side = 512
    row = np.repeat(np.arange(side), 8)
    column = (row * 37 + np.tile(np.arange(8), side) * 61) % side
    t = ranked_search.Treap(*ranked_search.tree(row, column, np.arange(len(row)) + 1))
    steps = []
    plain = t.step
    t.step = lambda nodes, quarter: steps.append(nodes.size) or plain(nodes, quarter)
    ranked_search.descend(t, np.array([5, 300]), np.array([1, 1]), [], 4, opened=8)
    assert sum(steps) < side * 2


def brute_phrases(rows, threshold, most, top, covered):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= threshold}
        longer = Counter()
        for p, a in often.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        found = []
        for p, a in often.items():
            if len(p) >= 2 and 100 * longer[p] < covered * a:
                score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), left, right))
        out += [(lang, k, x[3], -x[1], x[4], x[5], n[lang], -x[0]) for k, x in enumerate(sorted(found)[:top], 1)]
    return out


@pytest.mark.parametrize(("threshold", "most", "top", "block"), [(10, 3, 2000, 2000), (3, 4, 40, 700), (2, 2, 9, 10**7)])
def test_phrases(docs, rows, threshold, most, top, block):
    got = collocations.collocations(docs, threshold=threshold, most=most, top=top, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(rows, threshold, most, top, 50))
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_summary_keeps_every_frequent_key_and_its_bound():
    g = np.random.default_rng(7)
    keys = np.concatenate([np.repeat(np.arange(40), g.integers(10, 30, 40)), np.arange(100, 2600)]).astype(np.uint64)
    keys = keys[g.permutation(len(keys))]
    s = collocations.Summary(len(keys) // 10 + 1)
    for part in np.array_split(keys, 23):
        own, count = np.unique(part, return_counts=True)
        s.add(own, count)
    alive = s.reaching(10)
    assert set(range(40)) <= set(alive.tolist()) and len(s.keys) <= s.capacity and 0 < s.taken < 10


def test_scores_of_products_beyond_64_bits(spark, monkeypatch):
    big = 7_000_000_001
    counts = [("en", 0, "", 10**12), ("en", 1, "a", big + 5), ("en", 1, "b", big + 9), ("en", 2, "a b", big)]
    monkeypatch.setattr(collocations, "frequent", lambda *a: spark.createDataFrame(counts, "lang string, size int, phrase string, f long"))
    (r,) = collocations.collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert r["score"] == 10**6 * big * big // ((big + 5) * (big + 9)) and r["n"] == 10**12


def labelled(spark, n=1200):
    r = random.Random(1)
    clean = lambda: ". ".join(" ".join(r.choice(["one", "tree", "grows", "slowly", "here", "and"]) for _ in range(9)) for _ in range(r.randrange(1, 9)))
    bad = lambda: r.choice([lambda: " ".join(w + "$%" for w in clean().split()), lambda: clean().upper() + "!!", lambda: " ".join(w for w in clean().split() for _ in range(4))])()
    rows = [(i, bad() if i % 6 == 0 else clean(), 0 if i % 6 == 0 else 1) for i in range(n)]
    docs = spark.createDataFrame([(*x[:2], "en", "a", "b", "c", 1, 0.5, "d") for x in rows], SCHEMA)
    return docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")


def test_held_out_labels_are_told(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    got = quality.score(docs, model, out="p").where("doc_id % 4 = 0").join(labels, "doc_id").collect()
    assert np.mean([(r["p"] >= 0.3) == (r["quality"] == 1) for r in got]) > 0.95
    assert quality.train(docs, labels.where("doc_id % 4 <> 0"), most=100).weight.any()


def test_descent_reaches_the_optimum():
    g = np.random.default_rng(4)
    rows = [np.unique(g.integers(0, 30, 8)) for _ in range(60)]
    good = np.array([0 in x or 3 in x for x in rows])
    weight, square, bias = quality.descend(rows, good, 32, rounds=400)
    r = np.sqrt(square)
    x = np.zeros((60, 33))
    for k, row in enumerate(rows):
        x[k, row] = r[row] / np.sqrt(square[row].sum())
    x[:, 32] = 1
    y, cost = np.where(good, 1, -1), np.where(good, 30 / good.sum(), 30 / (~good).sum())
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    own = np.append(np.divide(weight, r, out=np.zeros(32), where=r > 0), bias)
    assert all(loss(own) <= loss(own + g.normal(0, s, 33)) + 1e-3 * loss(own) for s in (0.001, 0.01, 0.1, 1) for _ in range(50))


def test_indicators_are_the_distinct_grams():
    texts = ["abab", "", None, "é", "The the THE x x y y", "word"]
    got = [set(x.tolist()) for x in quality.indicators(pa.array(texts))]
    assert [len(x) for x in got[:4]] == [2 + 2 + 2 + 1, 0, 0, 3] and quality._shapes(np.array([1, 1, 1, 2, 3, 3, 4, 4])) == [7, 2, 3]
    assert all(len(a) == len(list(b)) for a, b in zip(got, quality.indicators(pa.array(texts)), strict=True))


def test_quality_without_labels_and_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) == 0.5
    assert quality.train(docs, spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (3, 1)], "doc_id long, quality int")) == 1.0
    assert quality.train(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")) == 0.5
    assert quality.train(docs, spark.createDataFrame([(20, 1), (-2, 0)], "doc_id long, quality int")) == 1.0
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 0)], "doc_id long, quality int"))
    got = quality.score(docs, model, out="p")
    assert got.columns == [*docs.columns, "p"] and got.count() == docs.count()
    p = {r["doc_id"]: r["p"] for r in got.collect()}
    assert p[0] == p[1] and all(0 <= x <= 1 for x in p.values())
    assert quality.score(docs.limit(0), model).count() == 0
