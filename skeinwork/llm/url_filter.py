"""URL filter: path rules first, then gradient-boosted trees on lexical features. JVM only.

The trees are fitted on labelled urls; what they see is length, depth, digit ratio, entropy, parameter
counts and the block rates of the host's suffixes among the labelled urls. Null urls and urls without
``://`` have an empty host and path, fit no rule and are allowed; repeated rows are judged alike; a long url is judged
whole; page ids may be of any type and null; other columns may have any name; an empty table gives an empty result; a training set without rows of both labels gives a model that allows all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import staged

#: Fixed values: (rule, verdict); a rule is a host suffix and a path prefix.
RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]

#: Host words that label a url as unwanted when no labelled urls are given.
SEED_WORDS = ["adult", "ads", "bets", "casino", "escort", "loan", "pills", "poker", "porn", "replica", "spam", "torrent", "viagra", "xxx"]

#: Labelled urls of either class that the trees are fitted on at most.
TRAIN_ROWS_PER_LABEL = 4000
FEATURES = ["length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "host_length", "query_length", "suffix1_rate", "suffix2_rate"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def add(acc: Column, ch: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, ch, F.lit("")))) / n
        return acc - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, the suffix keys and the lexical features of ``url`` added."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.col("host")
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return (
        df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        .withColumns({"suffix1": F.substring_index(host, ".", -1), "suffix2": F.substring_index(host, ".", -2)})
        .withColumns(
            {
                "length": F.length(text).cast("double"),
                "depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
                "digit_ratio": (F.length(text) - F.length(F.translate(text, "0123456789", ""))) / F.greatest(F.length(text), F.lit(1)),
                "entropy": _entropy(host),
                "n_params": F.when(query == "", 0.0).otherwise(F.length(query) - F.length(F.translate(query, "&", "")) + 1.0),
                "n_labels": (F.length(host) - F.length(F.translate(host, ".", ""))).cast("double"),
                "n_hyphens": (F.length(host) - F.length(F.translate(host, "-", ""))).cast("double"),
                "host_length": F.length(host).cast("double"),
                "query_length": F.length(query).cast("double"),
            }
        )
    )


def seed_labelled(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct urls labelled 1 where a host word is in ``SEED_WORDS``, else 0."""
    named = F.arrays_overlap(F.split(host_of(F.col(url)), r"[^a-z0-9]+"), F.array(*map(F.lit, SEED_WORDS)))
    return urls.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), named.cast("double").alias("label")).distinct()


@dataclass
class UrlModel:
    """Fitted trees and the suffixes' block rates; ``trees`` is None where one label was missing."""

    trees: PipelineModel | None
    suffixes: dict[str, DataFrame]
    base_rate: float

    def score(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """``pages`` with host, path, features and ``url_block`` (boolean)."""
        seen = lexical(pages, url)
        if self.trees is None:
            return seen.withColumn("url_block", F.lit(False))
        for key, rates in self.suffixes.items():  # Spark broadcasts them where they are small
            seen = seen.join(rates, key, "left").fillna({f"{key}_rate": self.base_rate})
        return self.trees.transform(seen).withColumn("url_block", F.col("prediction") > 0.5)


def fit(labelled: DataFrame, rows_per_label: int = TRAIN_ROWS_PER_LABEL, trees: int = 8, depth: int = 3) -> UrlModel:
    """Trees fitted on at most ``rows_per_label`` urls of each label, those with the smallest hashes.

    The base rate and the suffixes' rates are of all labelled urls; only the trees see a sample.
    """
    every = staged(labelled.select("url", "label"), "labelled")
    total = every.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    if not total["n"] or total["bad"] in (0, total["n"]):
        return UrlModel(None, {}, 0.0)
    base = total["bad"] / total["n"]
    hosts = lexical(every).select("suffix1", "suffix2", "label")
    suffixes = {k: staged(hosts.groupBy(k).agg(F.sum("label").alias("bad"), F.count("*").alias("n")), k) for k in ("suffix1", "suffix2")}
    order = F.xxhash64("url"), F.col("url")
    picked = every.where("label = 1").orderBy(*order).limit(rows_per_label).unionByName(every.where("label = 0").orderBy(*order).limit(rows_per_label))
    seen = lexical(picked)
    # each url's own label is left out of its suffixes' rates, which are shrunk to the base rate
    for key, sums in suffixes.items():
        left = (F.col("bad") - F.col("label") + 5 * base) / (F.col("n") - 1 + 5)
        seen = seen.join(sums, key).withColumn(f"{key}_rate", left).drop("bad", "n")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = staged(seen.select("url", "label", *FEATURES).coalesce(1).sortWithinPartitions(*order), "train")  # a bounded sample, in one order
    model = PipelineModel([assembler, gbt.fit(assembler.transform(rows.coalesce(1)))])
    rates = {k: staged(sums.select(k, ((F.col("bad") + 5 * base) / (F.col("n") + 5)).alias(f"{k}_rate")), f"{k}-rates") for k, sums in suffixes.items()}
    return UrlModel(model, rates, base)


def matching_rule(rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Columns (rule, verdict) for ``host`` and ``path``: the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, url_block."""
    rule, verdict = matching_rule(rules)
    scored = model.score(pages.select("page_id", "url"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("url_block"), "block").otherwise("allow")).alias("verdict"), "url_block")
