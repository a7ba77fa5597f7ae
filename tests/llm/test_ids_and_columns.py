"""Ids of any type, null and repeated ids, and columns of any name, in the operators over blocks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from riskspark.llm import blocks, context_tree, jaccard_join, language_id, substring_dedup

NAMES = ["_id", "_text", "_block", "_kept", "_key", "_judged", "_language", "_text_key", "row", "key", "one", "_0", "_more_0", "a.b", "n_words", "n_removed", "kept_text"]


def make_docs(spark, of_id=lambda k: k, kind="long"):
    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    base, shared = words(60), words(30)
    texts = [base, base + " end", f"{words(10)} {shared}", f"{shared} {words(9)}", "", None, words(400), base, "a b"]
    rows = [(of_id(k), t, *[f"{n}{k}" for n in NAMES]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, " + ", ".join(f"`{n}` string" for n in NAMES)), rows


@pytest.mark.parametrize(("of_id", "kind"), [(lambda k: f"d{k}", "string"), (lambda k: datetime.date(2020, 1, 1 + k), "date")])
def test_ids_that_are_not_numbers(spark, of_id, kind):
    plain, _ = make_docs(spark)
    other, _ = make_docs(spark, of_id, kind)
    same = lambda a, b, columns: sorted([tuple(of_id(r[c]) if c in ("doc_id", "component_id") else r[c] for c in columns) for r in a.collect()], key=str) == sorted([tuple(r[c] for c in columns) for r in b.collect()], key=str)
    assert same(jaccard_join.link_classes(plain), jaccard_join.link_classes(other), ["doc_id", "n_shingles", "component_id"])
    assert same(substring_dedup.dedup(plain), substring_dedup.dedup(other), ["doc_id", "n_words", "n_removed", "kept_text"])
    assert same(context_tree.score(plain, F.lit(True)), context_tree.score(other, F.lit(True)), ["doc_id", "n_tokens", "n_known", "score"])


def test_null_ids_are_spread_and_come_last(spark):
    df, _ = make_docs(spark)
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert blocks.deal(nulls, 10**9, block=10**7).select("_block").distinct().count() > 5
    lost = lambda d: sorted(r["n_removed"] for r in substring_dedup.dedup(d).collect())
    assert lost(nulls) == lost(df)
    both = substring_dedup.dedup(df.where("doc_id = 0").unionByName(nulls.where("text is not null")))
    assert [r["n_removed"] for r in both.where("doc_id = 0").collect()] == [0]


def test_columns_of_any_name(spark):
    df, rows = make_docs(spark)
    kept = jaccard_join.keep_one(df, jaccard_join.link_classes(df))
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in rows if r[0] not in (1, 7)], key=str)
    cut = {r["doc_id"]: r for r in substring_dedup.without_repeats(df).collect()}
    assert 7 not in cut and all(cut[k]["a.b"] == f"a.b{k}" and cut[k]["_id"] == f"_id{k}" and cut[k]["kept_text"] == f"kept_text{k}" for k in cut)
    said = language_id.tag(df, language_id.train(df.withColumn("lang", F.lit("en"))), out="_found")
    assert said.columns == [*df.columns, "_found"] and {tuple(r)[:-1] for r in said.collect()} == set(rows)
    assert context_tree.score(df, F.lit(True)).count() == len(rows)
