"""Queries of the review engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docengine.plans import casework, documents, reviews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = documents.Q | reviews.Q | casework.Q
ORACLES: dict[str, str] = documents.S | reviews.S | casework.S
