"""Scans of a database over JDBC: partitioned by ranges of a column, with columns and filters pushed to the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def bounds(spark: SparkSession, url: str, table: str, column: str, properties: dict[str, str]) -> tuple | None:
    """Least and greatest value of a column, worked out by the database; None for a table without any."""
    low, high = spark.read.jdbc(url, f"(SELECT min({column}) AS low, max({column}) AS high FROM {table}) edges", properties=properties).first()
    return None if low is None else (low, high)


def scan(spark: SparkSession, url: str, table: str, column: str, parts: int, properties: dict[str, str]) -> DataFrame:
    """A table read by `parts` tasks, each a range of a numeric, date or timestamp column between its bounds; the ends are open, so later rows and nulls
    are read too. What follows (scans.after, scans.between, scans.from_month, select) is pushed into each task's query."""
    edges = bounds(spark, url, table, column, properties)
    if edges is None:
        return spark.read.jdbc(url, table, properties=properties)
    ranges = {"partitionColumn": column, "lowerBound": str(edges[0]), "upperBound": str(edges[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **properties).load()
