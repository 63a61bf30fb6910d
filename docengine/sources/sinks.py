"""Reports written out: JSON rows, and one Markdown or HTML text for each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_reports(texts: DataFrame, path: str) -> None:
    """One folder for each session with its text. Spark's committer moves finished files into place, so a reader sees
    whole reports only."""
    texts.select("session", F.col("text").alias("value")).write.mode("overwrite").partitionBy("session").text(path)


def html_preview(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """A page for each session: its counts and a card for each requirement, in order; a page is one value."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    card: Column = F.concat(F.lit("<section><h2>"), plain(F.col("requirement_id")), F.lit("</h2><p>"), plain(F.col("status")), F.lit("</p><p>"), plain(F.coalesce("snippet", F.lit(""))), F.lit("</p></section>"))
    cards = rows.groupBy("session").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("requirement_id", card.alias("card")))), lambda x: x["card"])).alias("cards"))
    head = F.concat(F.lit("<!DOCTYPE html><meta charset=\"utf-8\"><h1>"), plain(F.col("session")), F.lit("</h1><p>"), F.col("covered").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" covered ("), F.col("percent").cast("string"), F.lit(" %)</p>\n"))
    return counts.join(cards, "session").select("session", F.concat(head, "cards").alias("text"))
