"""URL filters with DataFrame functions only: prefix rules by domain, and a logistic regression
on hashed character n-grams of host and path for the rest.

A null URL, or one without ://, has an empty host and path; no rule fits it and the classifier
judges it by its bias alone. Of rules that fit, the one with the longest name (host and path) wins, and of equally long ones the last
by name. A score at the threshold blocks. Repeated rows, and rows with null or equal ids, are judged alike; a URL of any length is read in a number of steps in
proportion. Other columns are kept, of any names; those named host, path, rule, verdict and block_score are replaced. An empty table gives no
rows (and needs a model or labels, else every verdict of the classifier is allow)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits host and its subdomains where the URL's path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/en/", "block"),
    UrlRule("example.com", "/en/7", "allow"),
    UrlRule("net", "/de/", "allow"),
    UrlRule("example.net", "/de/8", "block"),
    UrlRule("org", "/es/", "block"),
)

#: Production parameters: hashed features, n-gram sizes, most labelled URLs used for training.
FEATURES, NGRAMS, MOST_LABELLED = 1 << 14, (3, 4, 5), 4000


def host(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(at_host: Column, at_path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """Longest fitting rule as a struct (name, verdict), or null. A few hundred rules at most:
    they become one expression, so no join and no shuffle is needed."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((at_host == r.host) | at_host.endswith(f".{r.host}")) & at_path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams(at_host: Column, at_path: Column, sizes: Sequence[int] = NGRAMS) -> Column:
    """Character n-grams of host and path, each marked with the part it is from."""

    def cut(framed: Column, mark: str, n: int) -> Column:
        return F.transform(F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit(mark), g))

    def part(text: Column, mark: str) -> Column:
        return F.concat(*[cut(F.concat(F.lit("^"), text, F.lit("$")), mark, n) for n in sizes])

    return F.concat(part(at_host, "h:"), part(at_path, "p:"))


def _features(df: DataFrame, features: int) -> DataFrame:
    return HashingTF(numFeatures=features, inputCol="_grams", outputCol="_vector", binary=True).transform(df.withColumn("_grams", ngrams(F.col("host"), F.col("path"))))


def train(labelled: DataFrame, features: int = FEATURES, most: int = MOST_LABELLED, iterations: int = 30) -> LogisticRegressionModel | None:
    """Fit on (host, path, verdict). Takes the `most` rows with the smallest hash of host and path,
    a bounded sample that does not depend on the order of rows. None: fewer than two verdicts."""
    sample = labelled.where(F.col("verdict").isNotNull()).select("host", "path", (F.col("verdict") == "block").cast("double").alias("label"))
    sample = sample.groupBy("host", "path").agg(F.max("label").alias("label")).orderBy(F.xxhash64("host", "path"), "host", "path").limit(most)
    sample = _features(sample, features).select("label", "_vector").coalesce(1).cache()
    if sample.select("label").distinct().count() < 2:
        sample.unpersist()
        return None
    fit = LogisticRegression(labelCol="label", featuresCol="_vector", predictionCol="_said", probabilityCol="_p", rawPredictionCol="_raw", regParam=0.002, maxIter=iterations)
    model = fit.fit(sample)
    sample.unpersist()
    return model


def judge(urls: DataFrame, url: str = "url", rules: Sequence[UrlRule] = RULES, model: LogisticRegressionModel | None = None, features: int = FEATURES, threshold: float = 0.5) -> DataFrame:
    """All rows with host, path, rule, verdict and block_score (of the classifier)."""
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict", "block_score")]
    df = urls.select(F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in kept]).alias("row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    df = df.withColumn("matched", matched(F.col("host"), F.col("path"), rules))
    score = F.lit(0.0)
    if model is not None:
        df, score = model.transform(_features(df, features)), vector_to_array("_p")[1]
    df = df.withColumn("block_score", score)
    said = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return df.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", F.col("matched.name").alias("rule"), F.coalesce("matched.verdict", said).alias("verdict"), "block_score")


def url_query(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict; the labelled URLs are those that a rule decides."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    parts = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    labelled = parts.select("host", "path", matched(F.col("host"), F.col("path"))["verdict"].alias("verdict"))
    return judge(pages, model=train(labelled)).select("page_id", "host", "path", "rule", "verdict", "block_score")
