"""Benchmark decontamination by pigeonhole edit matching: a test item with an error budget of e edits is cut into e + 1
pieces; any passage within e edits has one piece unchanged. An automaton finds the exact piece hits, and Myers'
bit-parallel distance verifies the item around each.

Texts and items are compared lower-cased, with each run of white space as one blank. Defined cases: a null or blank text
or item matches nothing; items with equal texts are reported each; repeated documents are judged alike; extra columns pass
through a filter whatever their names; an empty table on either side gives no match. Of several passages of an item in a
document the one with the least distance counts, of equal ones the first.

Items go out in blocks of bounded size, each against all documents, so neither side has to be small.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, released

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Characters of items in one block, about: what an automaton and its broadcast may hold.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 pieces of about equal length, with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """For each character the places where the item has it, as bits."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def search(where: dict[str, int], length: int, text: str, most: int) -> tuple[int, int] | None:
    """The least distance of the item to any passage of text and the place after the passage, if within most edits:
    one column of the edit matrix is held as the bits of its vertical steps."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best = full, 0, length, None
    for i, c in enumerate(text):
        eq = where.get(c, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up, right_down = (right_up << 1) & full, (right_down << 1) & full
        up, down = right_down | (full & ~(vertical | right_up)), right_up & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(i, t, budget(t, rate), masks(t)) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        for k, (_, text, errors, _) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                if piece in self.automaton:
                    self.automaton.get(piece).append((k, at, len(piece)))
                else:
                    self.automaton.add_word(piece, [(k, at, len(piece))])
        if self.items:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item found its least distance and the place where that passage ends."""
        begins: dict[int, list[int]] = defaultdict(list)
        if self.items and text:
            for end, owners in self.automaton.iter(text):
                for k, at, size in owners:
                    begins[k].append(end + 1 - size - at)
        out: dict[int, tuple[int, int]] = {}
        for k, places in begins.items():
            item, pattern, errors, where = self.items[k]
            best = None
            for first, last in windows(sorted(places), errors, len(pattern)):
                a, b = max(0, first - errors), last + len(pattern) + errors
                found = search(where, len(pattern), text[a:b], errors)
                if found and (best is None or (found[0], found[1] + a) < best):
                    best = (found[0], found[1] + a)
            if best:
                out[item] = min(best, out.get(item, best))
        return out


def windows(places: list[int], errors: int, length: int) -> Iterator[tuple[int, int]]:
    """Sorted places put together while they are close, so that a passage with many hits is verified once."""
    first = last = places[0]
    for p in places[1:]:
        if p - last > errors or p - first > length:
            yield first, last
            first = p
        last = p
    yield first, last


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of about block_chars characters; one block is on the driver at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else rows
        yield sorted({(r["item_id"], normal(r["text"])) for r in part.collect()}, key=lambda x: (x[0] is None, x))


def _found(shared, error_rate: float):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        for batch in batches:
            rows = [(d, i, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, m in matcher.find(normal(t)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "distance", "end"])

    return run


def _clean(shared, error_rate: float, at: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def find_contamination(docs: DataFrame, items: DataFrame, *, error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance and end (in the normalised text) for every document that holds an item."""
    bounded_batches(docs.sparkSession, "4m")
    schema = "doc_id long, item_id long, distance long, end long"
    parts = []
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found(shared, error_rate), schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, error_rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    bounded_batches(docs.sparkSession, "4m")
    at = docs.columns.index("text")
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_clean(shared, error_rate, at), docs.schema)
    return docs
