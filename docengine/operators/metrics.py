"""Costs, agreement between reviewers, accuracy, conversion progress and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine import constants as C


def price_table(spark) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in C.PRICES], "model string, input double, output double, cache_write double, cache_read double")


def call_costs(calls: DataFrame) -> DataFrame:
    """Cost of each call in micro-dollars, at the default model's prices for an unknown model. The price list is fixed."""
    p = F.broadcast(price_table(calls.sparkSession))
    default = dict(zip(("input", "output", "cache_write", "cache_read"), C.PRICES[0][1:]))
    price = lambda k: F.coalesce(k, F.lit(default[k]))
    cost = F.col("input_tokens") * price("input") + F.col("output_tokens") * price("output") + F.col("cache_creation_tokens") * price("cache_write") + F.col("cache_read_tokens") * price("cache_read")
    return calls.join(p, "model", "left").withColumn("micro_usd", F.when(F.col("cached"), 0.0).otherwise(cost)).drop("input", "output", "cache_write", "cache_read")


def cost_summary(costs: DataFrame, key: str) -> DataFrame:
    """Calls, cost, tokens and share of cached calls by key. Costs are summed in whole thousandths of a micro-dollar, so the
    order of summing does not matter."""
    return costs.groupBy(key).agg(
        F.count("*").alias("calls"), (F.sum(F.round(F.col("micro_usd") * 1000).cast("long")) / 1e9).alias("cost_usd"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), (F.count_if("cached") / F.count("*")).alias("hit_rate"),
    )


def expensive(costs: DataFrame, key: str, over_usd: float = 0.10) -> DataFrame:
    return cost_summary(costs, key).filter(F.col("cost_usd") > over_usd)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """95 % interval of a share, as a struct of low and high."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(((mid - half) / (1 + z * z / n)).alias("low"), ((mid + half) / (1 + z * z / n)).alias("high"))


def agreement(rows: DataFrame, *by: str) -> DataFrame:
    """Shares of equal, lower and higher verdicts of system against human, with the interval of the first."""
    s, h = F.col("system"), F.col("human")
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(s == h).alias("exact"), F.count_if(s < h).alias("under"), F.count_if(s > h).alias("over"))
    ci = wilson(F.col("exact"), F.col("n"))
    return counts.select(*by, "n", (F.col("exact") / F.col("n")).alias("exact_rate"), (F.col("under") / F.col("n")).alias("under_rate"), (F.col("over") / F.col("n")).alias("over_rate"), ci["low"].alias("ci_low"), ci["high"].alias("ci_high"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system", "human").agg(F.count("*").alias("n"))


def set_scores(found: DataFrame, expected: DataFrame, key: str, by: str) -> DataFrame:
    """Precision, recall and F1 of distinct keys by group."""
    a = found.select(by, key).distinct().withColumn("f", F.lit(1))
    b = expected.select(by, key).distinct().withColumn("e", F.lit(1))
    c = a.join(b, [by, key], "full").groupBy(by).agg(F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("hit"), F.count("f").alias("nf"), F.count("e").alias("ne"))
    share = lambda n: F.when(n > 0, F.col("hit") / n).otherwise(0.0)
    return c.select(by, share(F.col("nf")).alias("precision"), share(F.col("ne")).alias("recall"), F.when(F.col("nf") + F.col("ne") > 0, 2 * F.col("hit") / (F.col("nf") + F.col("ne"))).otherwise(0.0).alias("f1"))


def value_match(extracted: Column, expected: Column) -> Column:
    """Whether an extracted text agrees: both null, either within the other in any case, or numbers within 1 %."""
    from docengine.functions import text as T

    a, b, x, y = F.lower(extracted), F.lower(expected), T.number(extracted), T.number(expected)
    return F.when(extracted.isNull() | expected.isNull(), extracted.isNull() & expected.isNull()).when(x.isNotNull() & y.isNotNull() & (y != 0), F.abs(x - y) / F.abs(y) <= 0.01).otherwise(a.contains(b) | b.contains(a))


def conversion_progress(docs: DataFrame) -> DataFrame:
    """Progress of each session's PDFs: 0.3 for fast and 0.7 for high-quality text, 1 without any; minutes left; message."""
    pdf = F.lower("filename").endswith(".pdf")
    count = lambda x: F.count_if(pdf & x).cast("long")
    c = docs.groupBy("session").agg(
        F.count_if(pdf).cast("long").alias("pdfs"), count(F.col("fast_status") == "complete").alias("fast"), count(F.col("hq_status") == "complete").alias("hq"),
        count(F.col("hq_status") == "converting").alias("converting"), count(F.col("hq_status") == "queued").alias("queued"),
    )
    n, fast, hq, s = F.col("pdfs"), F.col("fast"), F.col("hq"), lambda x: x.cast("string")
    message = (
        F.when((n > 0) & (hq == n), F.concat(F.lit("All "), s(n), F.lit(" documents fully processed (high-quality)")))
        .when((n > 0) & (fast == n) & (F.col("converting") > 0), F.concat(F.lit("Fast analysis ready. High-quality processing: "), s(hq), F.lit("/"), s(n), F.lit(" complete")))
        .when((n > 0) & (fast == n) & (F.col("queued") > 0), F.concat(F.lit("Fast analysis ready. "), s(F.col("queued")), F.lit(" documents queued for high-quality conversion")))
        .when((n > 0) & (fast == n), F.concat(F.lit("Fast analysis complete for all "), s(n), F.lit(" documents. High-quality conversion available.")))
        .when(fast > 0, F.concat(F.lit("Fast: "), s(fast), F.lit("/"), s(n), F.lit(" ready. HQ: "), s(hq), F.lit("/"), s(n), F.lit(" complete")))
        .otherwise("No documents processed yet")
    )
    return c.select("*", F.when(n > 0, (3 * fast + 7 * hq) / (10 * n)).otherwise(1.0).alias("progress"), ((F.col("converting") + F.col("queued")) * 5).alias("minutes_left"), message.alias("message"))


def completion(coverage_percent: Column, missing: Column, flags: Column) -> Column:
    return F.when((coverage_percent >= 90) & (missing == 0) & (flags == 0), "READY").when((coverage_percent >= 80) & (missing <= 2), "CONDITIONAL").otherwise("MAJOR REVISIONS")


def repeated_names(definitions: DataFrame) -> DataFrame:
    """Names defined more than once."""
    return definitions.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
