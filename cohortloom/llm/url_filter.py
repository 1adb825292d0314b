"""URL filters: domain and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_labels import labelled

NGRAMS = (3, 4, 5)
FEATURES = 1 << 15
BLOCK_FROM = 0.5
# the labelled table is small by definition; more rows than this are refused
MOST_LABELLED = 100_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# fixed values
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a url; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), letters, letters.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (ties: the longer host), else null.

    ``rules`` is configuration: it becomes a map from host to its rules, looked up by each suffix of
    the url's host at a dot.
    """
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    entries = []
    for name, own in by_host.items():
        listed = [
            F.struct(
                F.lit(len(r.text)).alias("size"),
                F.lit(len(r.host)).alias("host_size"),
                F.lit(r.text).alias("text"),
                F.lit(r.path).alias("path"),
                F.lit(r.verdict).alias("verdict"),
            )
            for r in own
        ]
        entries += [F.lit(name), F.array(*listed)]
    table = F.create_map(*entries)
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )
    found = F.flatten(
        F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array()))
    )
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return best["text"], best["verdict"]


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and of the path, told apart by a prefix."""

    def of(text: Column, prefix: str) -> list[Column]:
        return [
            F.when(
                F.length(text) >= n,
                F.transform(
                    F.sequence(F.lit(1), F.length(text) - n + 1),
                    lambda i, n=n: F.concat(F.lit(prefix), F.substring(text, i, F.lit(n))),
                ),
            ).otherwise(F.array().cast("array<string>"))
            for n in NGRAMS
        ]

    marked = F.when(host == "", "").otherwise(F.concat(F.lit("^"), host, F.lit("$")))
    return F.concat(*of(marked, "h"), *of(path, "p"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: (url, label), 1 for urls to block."""
    return spark.createDataFrame(labelled(), "url string, label double")


def train(rows: DataFrame, features: int = FEATURES) -> PipelineModel:
    """Fit on (url, label); refuses a table that is not small or has one label only."""
    host, path = host_and_path(F.col("url"))
    rows = rows.where("label is not null").select("label", ngrams(host, path).alias("grams"))
    known = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(known) < 2 or sum(known.values()) > MOST_LABELLED:
        raise ValueError(f"needs both labels and at most {MOST_LABELLED} rows, not {known}")
    hashing = HashingTF(inputCol="grams", outputCol="hashed", numFeatures=features, binary=True)
    fit = LogisticRegression(featuresCol="hashed", regParam=0.003, maxIter=100, standardization=False)
    # every pass of the fit reads the small table again
    rows = rows.repartition(1).cache()
    try:
        return Pipeline(stages=[hashing, fit]).fit(rows)
    finally:
        rows.unpersist()


def judged(
    pages: DataFrame, model: PipelineModel, rules=RULES, block_from: float = BLOCK_FROM
) -> DataFrame:
    """Per row of ``pages`` (page_id, url, ...): host, path, rule, verdict, score.

    A fitting rule decides, else the model: block from ``block_from`` on. A null url or one without
    ``://`` has empty host and path, fits no rule and gets the model's verdict on no n-grams. Repeated
    rows get the same row each; other columns of ``pages`` are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    scored = model.transform(rows.withColumn("grams", ngrams(F.col("host"), F.col("path"))))
    score = vector_to_array("probability")[1]
    return scored.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(score >= block_from, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
