"""Streams: files discovered once by content as they arrive, and review events counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.operators import discovery


def new_documents(files: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """From a stream of path, content and ts the first file of each content, within the watermark; state older than that
    is dropped, so it does not grow without end."""
    digest = discovery.content_hash(F.col("content"))
    docs = files.filter(discovery.scannable(F.col("path"))).select("path", "ts", digest.alias("content_hash"))
    docs = docs.select("*", discovery.document_id(F.col("content_hash")).alias("document_id"), discovery.classify(F.col("path"))["label"].alias("classification"))
    return docs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def event_counts(events: DataFrame, *, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Review events by window and action; late events within the delay still count."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "action").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "action", "n")
