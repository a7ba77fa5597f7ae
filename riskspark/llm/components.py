"""Connected components of an edge table, and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share. Where none is named, a session whose
    executors are in the driver's process (tests) takes a folder of its own; a cluster has to name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file:{os.path.abspath(os.environ.get('TMPDIR', '/tmp'))}/spark-{uuid.uuid4().hex}")
        folder = context.getCheckpointDir()
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input. Both sides are sorted where they lie: what is small enough to be broadcast still takes several times its size of the
    driver, and a query of many joins has many such tables at once."""
    return df.hint("merge")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (x, y); component is the smallest node reached.

    Each round gives every node the smallest label around it and then follows labels once, so the
    rounds grow with the logarithm of the longest path. A node of any degree is an aggregate's key,
    never a task's group."""
    both = checkpoint(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct())
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("component"))
    for _ in range(most_rounds):
        around = both.join(shuffled(labels), both["y"] == labels["node"]).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("_near"))
        near = labels.join(shuffled(around), "node").select("node", F.col("component").alias("_was"), F.least("component", "_near").alias("_label"))
        heads = labels.select(F.col("node").alias("_label"), F.col("component").alias("_next"))
        labels = checkpoint(near.join(shuffled(heads), "_label", "left").select("node", "_was", F.least("_label", F.coalesce("_next", "_label")).alias("component")))
        if labels.where(F.col("component") < F.col("_was")).isEmpty():
            return labels.drop("_was")
        labels = labels.drop("_was")
    raise RuntimeError("components did not settle")
