"""Quality rules as a short-circuit cascade: each rule's cost and selectivity are estimated on a sample, and the rules
run in order of rejections per unit of cost until one rejects.

The order changes only the time taken: a document is kept exactly if no rule rejects it. Defined cases: a null or empty
text has no words, and is rejected by the word-count rule. Repeated rows are judged alike, ties in the order go by rule
name, extra columns pass through whatever their names, an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, hashed_sample, released, sample_fraction

SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Documents, about, on which costs and selectivities are estimated.
SAMPLE_ROWS = 2_000


class View:
    """One document's measures, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACE_CHARS)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE_CHARS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that occur twice or more."""
        w = self.words
        if len(w) < 4:
            return 0
        if len(set(zip(w, w[1:], w[2:]))) == len(w) - 2:
            return 0
        seen, twice = set(), set()
        for g in zip(w, w[1:], w[2:]):
            (twice if g in seen else seen).add(g)
        n = end = 0
        for i, g in enumerate(zip(w, w[1:], w[2:])):
            if g in twice:
                n += i + 3 - max(i, end)
                end = i + 3
        return n


@dataclass(frozen=True)
class QualityRule:
    name: str
    rejects: Callable[[View], bool]


def few_words(v: View) -> bool:
    return v.n_words < 50


def repeats_itself(v: View) -> bool:
    return 100 * v.n_repeat_words > 50 * v.n_words


def many_symbols(v: View) -> bool:
    return 100 * v.n_symbols > 25 * v.n_words


def odd_word_length(v: View) -> bool:
    return not 2 * v.n_words <= v.word_chars <= 15 * v.n_words


BASE_RULES = (QualityRule("few_words", few_words), QualityRule("repeats_itself", repeats_itself))
RULES = (
    *BASE_RULES,
    QualityRule("many_symbols", many_symbols),
    QualityRule("odd_word_length", odd_word_length),
)


def _measured(rules: Sequence[QualityRule]) -> Callable:
    """Time and rejections of each rule on every text. The words, which all rules share, are split before and billed to none."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ns, rejected, n = [0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                words = View(text).words
                for i, r in enumerate(rules):
                    view = View(text)
                    view.words = words
                    began = time.perf_counter_ns()
                    rejected[i] += r.rejects(view)
                    ns[i] += time.perf_counter_ns() - began
        if n:
            yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "ns": ns, "rejected": rejected})

    return run


def plan_order(docs: DataFrame, rules: Sequence[QualityRule] = RULES, *, sample_rows: int = SAMPLE_ROWS) -> list[QualityRule]:
    """The rules by falling rejections per nanosecond on a hash sample of about sample_rows documents."""
    rules = sorted(rules, key=lambda r: r.name)
    sample = hashed_sample(docs.select("doc_id", "text"), sample_fraction(docs.count(), sample_rows), "doc_id").select("text")
    sums = sample.mapInArrow(_measured(rules), "rule long, ns long, rejected long").groupBy("rule")
    found = {r["rule"]: r["rejected"] / max(r["ns"], 1) for r in sums.agg(F.sum("ns").alias("ns"), F.sum("rejected").alias("rejected")).collect()}
    return [r for _, _, r in sorted((-found.get(i, 0.0), r.name, r) for i, r in enumerate(rules))]


def passes(view: View, ordered: Sequence[QualityRule]) -> bool:
    return not any(r.rejects(view) for r in ordered)


def filter_documents(docs: DataFrame, rules: Sequence[QualityRule] = RULES, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    bounded_batches(docs.sparkSession, "4m")
    ordered, at = plan_order(docs, rules, sample_rows=sample_rows), docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([passes(View(x), ordered) for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, rules: Sequence[QualityRule] = RULES, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    bounded_batches(docs.sparkSession, "4m")
    ordered = plan_order(docs, rules, sample_rows=sample_rows)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
            for text in batch.column(1).to_pylist():
                v = View(text)
                failed = any(r.rejects(v) for r in BASE_RULES)
                for k, x in zip(out, (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, failed, not failed and passes(v, ordered))):
                    out[k].append(x)
            arrays = [pa.array(x, pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, x in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *out])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
