"""A ledger that outlives its object, and ranges of ids that are texts."""

import shutil

import pytest
from pyspark.sql import functions as F

from riskspark.llm import fingerprint, secret_scan as S


def versions(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "path long, text string")


def test_a_ledger_is_found_again(spark, tmp_path):
    path = str(tmp_path / "ledger")
    S.Ledger(spark, path).add(versions(spark, "password=abcdefgh", "plain"))
    second = S.Ledger(spark, path)
    assert second.rows().count() == 2
    second.add(versions(spark, "password=abcdefgh", "token: zzzzzzzz"))
    assert S.Ledger(spark, path).deliveries() == ["000000", "000001"]
    rows = S.Ledger(spark, path).rows()
    assert rows.count() == 3 and rows.where(F.size("spans") > 0).count() == 2  # the blob of both deliveries was scanned once
    more = (*S.RULES, S.Rule("mine", "pl[a-z]+", version=3))
    S.Ledger(spark, path).add(versions(spark, "plain", "token: zzzzzzzz"), rules=more)
    todo = {r["blob_id"]: r["todo"] for r in spark.read.parquet(f"{path}/delivery=000002").collect()}
    assert len(todo) == 2 and all(len(x) == 1 for x in todo.values())  # known blobs, for the new rule only


def test_a_delivery_that_broke_off_is_taken_again(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = S.Ledger(spark, path)
    ledger.add(versions(spark, "password=abcdefgh"), name="a/1")
    ledger.add(versions(spark, "token: zzzzzzzz", "x"), name="b")
    (tmp_path / "ledger/delivery=b/_SUCCESS").unlink()
    assert S.Ledger(spark, path).deliveries() == ["a/1"] and S.Ledger(spark, path).rows().count() == 1
    for _ in range(2):  # again, and once more after it had ended
        S.Ledger(spark, path).add(versions(spark, "token: zzzzzzzz", "x"), name="b")
        assert S.Ledger(spark, path).deliveries() == ["a/1", "b"] and S.Ledger(spark, path).rows().count() == 3
    shutil.rmtree(path)
    assert ledger.deliveries() == [] and ledger.rows() is None


@pytest.mark.parametrize("first", ["a", "https://www.example.com/000000"])
def test_text_ids_with_a_long_common_start_are_spread(spark, first):
    ids = [first] + [f"https://www.example.com/{i:06d}" for i in range(1, 2000)]
    docs = spark.createDataFrame([(x, f"word{k} and more {k}") for k, x in enumerate(ids)], "doc_id string, text string").repartition(7)
    laid = fingerprint.with_next(docs, span=4000).cache()
    sizes = [r["count"] for r in laid.where("not _guest").groupBy("_range").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 10 and max(sizes) < 600
    assert laid.where("_guest").groupBy("_range").count().where("count > 1").isEmpty()
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_fingerprints(docs).collect()}
    order, text = sorted(ids, reverse=True), {x: f"word{k} and more {k}" for k, x in enumerate(ids)}
    import hashlib

    for x, y in zip(order, order[1:] + order[:1], strict=True):
        half = len(text[x]) // 2
        assert got[x] == hashlib.sha256((text[x][: len(text[x]) - half] + text[y][:half]).encode()).hexdigest()


def test_one_id_of_most_rows_has_one_guest(spark):
    docs = spark.createDataFrame([(7, f"t{k}") for k in range(900)] + [(k, "x") for k in range(300)], "doc_id long, text string")
    laid = fingerprint.with_next(docs, span=100).cache()
    assert laid.where("_guest").count() == laid.select("_range").distinct().count() and laid.where("not _guest").count() == 1200
    assert fingerprint.edited_fingerprints(docs).count() == 1200
