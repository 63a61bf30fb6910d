"""Pluggable extractors over the chunks of long documents. An extractor is any function from a chunk to fields; each chunk's
fields arrive as rows, a chunk whose extractor fails gives one row with the error, and the other chunks go on. What overlapping
chunks both found is merged afterwards."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.operators import chunking

FIELDS = "doc_id long, chunk_no int, pos int, extractor string, field_type string, value string, source string, confidence double, raw_text string, error string"
COLUMNS = [c.split()[0] for c in FIELDS.split(", ")]


@dataclass(frozen=True)
class Chunk:
    """A piece of a document: its number from 0 and how many there are."""

    doc_id: int
    number: int
    of: int
    text: str

    @property
    def name(self) -> str:
        return f"document {self.doc_id}" + (f" (chunk {self.number + 1}/{self.of})" if self.of > 1 else "")


@dataclass(frozen=True)
class Field:
    field_type: str
    value: str | None
    confidence: float = 1.0
    raw_text: str | None = None


@dataclass(frozen=True)
class Extractor:
    """A function from a chunk to fields, tried again after the errors named, up to attempts times, after a pause that doubles."""

    name: str
    find: Callable[[Chunk], Iterable[Field]]
    attempts: int = 1
    retry_on: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)
    pause: float = 0.0

    def run(self, chunk: Chunk) -> list[Field]:
        for n in range(self.attempts):
            try:
                return list(self.find(chunk))
            except self.retry_on:
                if n + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**n)
        return []


REGISTRY: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Extractor:
    """Makes an extractor known by its name; a second one of that name is an error."""
    if extractor.name in REGISTRY:
        raise ValueError(f"an extractor named {extractor.name} is registered already")
    REGISTRY[extractor.name] = extractor
    return extractor


def extract(chunks: DataFrame, *extractors: Extractor | str) -> DataFrame:
    """Rows of FIELDS from chunks (doc_id, chunk_no, n_chunks, chunk): the fields of every extractor, and one row with an error
    for each chunk and extractor that failed. An extractor that gives something else than fields has failed."""
    found = [REGISTRY[e] if isinstance(e, str) else e for e in extractors]

    def rows(e: Extractor, c: Chunk) -> list[tuple]:
        try:
            return [(c.doc_id, c.number, i, e.name, f.field_type, f.value, c.name, float(f.confidence), f.raw_text, None) for i, f in enumerate(e.run(c))]
        except Exception as x:  # noqa: BLE001 - whatever an extractor raises is that chunk's result
            return [(c.doc_id, c.number, 0, e.name, None, None, c.name, None, None, f"{type(x).__name__}: {x}")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [Chunk(*r) for r in zip(b["doc_id"], b["chunk_no"], b["n_chunks"], b["chunk"])]
            yield pd.DataFrame([r for c in made for e in found for r in rows(e, c)], columns=COLUMNS)

    return chunks.select("doc_id", "chunk_no", "n_chunks", "chunk").mapInPandas(run, FIELDS)


def documents_chunks(docs: DataFrame, **sizes: int) -> DataFrame:
    """The chunks of texts with their number of chunks, for extract."""
    return chunking.chunk(docs, **sizes)


def merge(fields: DataFrame) -> DataFrame:
    """Each document's fields once by type and value: of equal ones the most confident, of these the first found. Null values
    are equal; rows with an error are left out."""
    order = F.struct((-F.col("confidence")).alias("c"), "chunk_no", "pos", "extractor", "source", "raw_text")
    best = fields.filter("error IS NULL").groupBy("doc_id", "field_type", "value").agg(F.min(order).alias("m"), F.count("*").alias("n_found"), F.min(F.struct("chunk_no", "pos")).alias("first"))
    return best.select("doc_id", "field_type", "value", (-F.col("m.c")).alias("confidence"), F.col("m.chunk_no").alias("chunk_no"), F.col("m.source").alias("source"), F.col("m.raw_text").alias("raw_text"), "n_found", F.col("first.chunk_no").alias("first_chunk"))


def progress(fields: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many chunks of a document there were, failed, and how many fields were found."""
    failed = fields.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("error").isNotNull(), F.col("chunk_no"))).alias("failed"), F.count(F.when(F.col("error").isNull(), 1)).alias("fields"))
    count: Column = F.count("*").alias("chunks")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return chunks.groupBy("doc_id").agg(count).join(failed, "doc_id", "left").select("doc_id", "chunks", zero("failed"), zero("fields"))
