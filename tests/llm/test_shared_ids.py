"""Documents that share an id, null included, are documents of their own."""

import random

from riskspark.llm import jaccard_join


def test_keep_one_loses_no_text_of_a_shared_id(spark):
    r = random.Random(7)
    make = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(40))
    a, b, c, d, e, f = (make() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (8, e), (9, d.rsplit(" ", 1)[0] + " edit"), (None, f), (5, f), (None, None), (None, ""), (7, " ")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long")
    classes = jaccard_join.link_classes(df)
    assert classes.count() == len(rows)
    kept = sorted(((x["doc_id"], x["text"]) for x in jaccard_join.keep_one(df, classes).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (None, c), (7, d), (7, e), (5, f), (None, None), (None, ""), (7, " ")], key=str)
