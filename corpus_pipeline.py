"""Corpus pipeline: quality rules, near-duplicate groups, repeated passages, benchmark leaks, tokens.

Each stage takes the documents that its predecessor kept, with the columns of documents; the last returns their tokens.
Between stages the documents are written as Parquet and read again, so a lost executor repeats no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bpe, decontaminate, ngram_join, quality_rules, suffix_dedup
from docengine.llm.common import table, written
from docengine.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 one stays, the smallest doc_id.
    Rows that share a doc_id, or have none, are linked by their texts alone."""
    return ngram_join.keep_one(docs, n=5, percent=80, by_row=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string of a document with a smaller doc_id go; n_chars follows the text."""
    out = suffix_dedup.dedup_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document left, with their digests."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: Whether texts are within an edit budget, and their tokens, can't be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
