"""What near duplicates send through the driver."""

from pyspark.sql import functions as F

from riskspark.llm import components, jaccard_join


def test_no_table_of_near_duplicates_is_broadcast(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:59] + ["other"]), " ".join(words), "a b c d e f g", " ".join(reversed(words)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans = []

    def seen(df, cut=components.checkpoint):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(jaccard_join, "checkpoint", seen)
    monkeypatch.setattr(components, "checkpoint", seen)
    kept = jaccard_join.keep_one(docs, jaccard_join.link_classes(docs))
    plans.append(kept._jdf.queryExecution().optimizedPlan().toString())
    joins = [line for plan in plans for line in plan.split("\n") if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)
    assert sorted(r.doc_id for r in kept.select(F.col("doc_id")).collect()) == [0, 3, 4, 5, 6]
