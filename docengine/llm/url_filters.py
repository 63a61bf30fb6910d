"""URL filters: block and allow rules by host suffix and path prefix, and gradient-boosted trees on lexical features for
the URLs that no rule decides. Everything stays in DataFrame and spark.ml operations on the JVM.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and is judged by the trees on
all-zero features. Repeated rows are judged alike. With no labelled URL at all, or labels of one kind, the verdict is
"allow", or that kind. Other columns of the input are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import LOWER, UPPER, hashed_sample, sample_fraction, written

FEATURES = (
    "url_length", "host_length", "path_length", "path_depth", "host_labels", "digit_ratio", "punctuation_ratio",
    "entropy", "parameters", "suffix_share", "suffix_block_rate", "label_block_rate",
)
#: Rows of labelled URLs that the trees and the suffix statistics are fitted on, about.
MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Rule:
    """verdict for a host with its subdomains, under a path prefix; text is how the rule is written."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    labels: DataFrame | None
    verdict: str


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of text and verdict: a chain of tests, longest rule first."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(set(rules), key=lambda r: (len(r.text), r.text, r.verdict)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(df: DataFrame) -> DataFrame:
    """The features that need no statistics, from columns url, host and path, and the suffixes that have some."""
    text = F.coalesce("url", F.lit(""))
    n = F.length(text)
    share = lambda pattern: F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    c_log_c = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s + c * F.log2(c.cast("double")))
    return df.select(
        "*",
        n.cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double").alias("path_depth"),
        F.when(F.col("host") == "", 0.0).otherwise(F.size(F.split("host", "\\.")).cast("double")).alias("host_labels"),
        share("[0-9]").alias("digit_ratio"),
        share("[^A-Za-z0-9]").alias("punctuation_ratio"),
        F.when(n > 0, F.log2(n.cast("double")) - c_log_c / n).otherwise(0.0).alias("entropy"),
        F.regexp_count(text, F.lit("[?&][^=&#?]*=")).cast("double").alias("parameters"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("label"),
    )


def _rates(sample: DataFrame, key: str) -> DataFrame:
    """Smoothed rate of blocked URLs and share of all for each value of key: no more rows than the sample."""
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return sample.groupBy(key).agg(
        ((F.sum("label_y") + 1) / (F.count("*") + 2)).alias(f"{key}_block_rate"), (F.count("*") / total).alias(f"{key}_share")
    )


def _assembled(df: DataFrame, suffixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Both statistics have at most MAX_LABELLED rows, so they may be broadcast at any size of df."""
    joined = df.join(F.broadcast(suffixes), "suffix", "left").join(F.broadcast(labels.drop("label_share")), "label", "left")
    filled = joined.fillna({"suffix_block_rate": 0.5, "suffix_share": 0.0, "label_block_rate": 0.5})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(filled)


def fit(labelled: DataFrame, *, max_rows: int = MAX_LABELLED, trees: int = 8, depth: int = 3) -> UrlModel:
    """Trees and suffix statistics from columns url and verdict (block or allow); null verdicts are left out.

    Fitted on a sample of about max_rows rows by hash of the URL: the one documented bound here.
    """
    rows = labelled.filter(F.col("verdict").isin("block", "allow")).select("url", "verdict")
    counts = {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}
    if len(counts) < 2:
        return UrlModel(None, None, None, next(iter(counts), "allow"))
    picked = hashed_sample(rows, sample_fraction(sum(counts.values()), max_rows), "url")
    picked = lexical(picked.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}))
    sample = written(picked.withColumn("label_y", (F.col("verdict") == "block").cast("double")), "url-sample")
    kinds = sample.select("label_y").distinct().count()
    if kinds < 2:
        return UrlModel(None, None, None, max(sorted(counts), key=counts.get))
    suffixes, labels = written(_rates(sample, "suffix"), "url-suffixes"), written(_rates(sample, "label"), "url-labels")
    gbt = GBTClassifier(featuresCol="features", labelCol="label_y", maxIter=trees, maxDepth=depth, seed=17, maxBins=64)
    return UrlModel(gbt.fit(_assembled(sample, suffixes, labels).select("features", "label_y")), suffixes, labels, "allow")


def by_rules(df: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    out = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    out = out.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return out.withColumn("rule_hit", rule_for(F.col("host"), F.col("path"), rules))


def judge(df: DataFrame, rules: Sequence[Rule], model: UrlModel, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row: the longest rule's verdict, else the trees'."""
    out = by_rules(df, rules, id_col=id_col, url_col=url_col)
    if model.trees is None:
        own = F.lit(model.verdict)
    else:
        out = model.trees.transform(_assembled(lexical(out), model.suffixes, model.labels))
        own = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("rule_hit.text").alias("rule"), F.coalesce("rule_hit.verdict", own).alias("verdict")
    )


def filter_urls(df: DataFrame, rules: Sequence[Rule], **columns: str) -> DataFrame:
    """Trains on the URLs of df that a rule decides, then judges every URL of df."""
    hits = by_rules(df, rules, **columns).select("url", F.col("rule_hit.verdict").alias("verdict"))
    return judge(df, rules, fit(hits), **columns)
