"""Substring deduplication over a log-structured fingerprint index.

A window is a run of consecutive words of one document. Every window has a fingerprint: the least hash of the short word
runs in it, at its first place. Neighbouring windows share fingerprints, and equal windows have equal ones, so an index of
fingerprints needs about one entry for fourteen windows and misses no repeated window.

The index holds sorted immutable runs of (fingerprint, count), bucketed by fingerprint. A new batch makes a run; its
fingerprints that occur twice, or in an earlier run, are found by merge joins of the sorted runs and kept as hits; when a
level has several runs they are merged into one of the next level. Hits are then verified by cryptographic digests: of the
whole word sequence of all windows that share a fingerprint, and where such a sequence occurs once only, of its windows.
FingerprintIndex.add_documents does all that for one batch, in this session or a later one; dedup adds the documents of one
table in batches and verifies once, as there earlier batches lose the words that later ones repeat.

Defined cases: a null or empty text has no words; a document shorter than a window keeps all its words; every row is a
document of its own, so rows that repeat are copies of each other and lose their common windows; a null doc_id is a value
like others; extra columns are ignored, whatever their names; an empty table gives no rows. Counts of hot fingerprints and
sequences are summed before they are dealt out, so no task gathers all copies.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import (
    Rolling, bounded_batches, buffers, chunks, covered, digest_column, digests, first_least, mix, new_path, partitions, present, ranges, released, remove, signed, spaced, word_hashes, words_of, written,
)

WINDOW = 35
#: Words of the short runs whose least hash is a window's fingerprint.
SHINGLE = 8
#: Batches that the documents of one call are added in, and runs of a level that are merged into one.
BATCHES, FAN_OUT = 3, 2

KEYS = ["doc_id", "text_key"]


def key_columns() -> list[Column]:
    """doc_id, a null one as the smallest, and text_key: a row is told from others by its id and a hash of its text, so
    that spans find their rows again even if ids repeat. Rows alike in both are copies with the same result."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("text_key")]


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.select(*key_columns(), "text")


class Windows:
    """The word windows of some rows: start places of windows, what their words hash to, and digests of word sequences."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, window: int = WINDOW, shingle: int = SHINGLE):
        start, end, self.first = words_of(body, offsets)
        self.hashes = word_hashes(body, start, end)
        self.text, self.at = spaced(body, start, end)
        self.rolling = Rolling(self.hashes)
        counts = np.diff(self.first)
        self.n_windows = np.maximum(counts - window + 1, 0)
        self.starts = ranges(self.first[:-1], self.n_windows)
        self.rows = np.repeat(np.arange(len(counts)), self.n_windows)
        self.window, self.shingle = window, shingle

    def sequences(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digests of the words from first to before end, for each pair of places."""
        return digests(self.text, self.at[first], self.at[end])

    def groups(self) -> tuple[np.ndarray, ...]:
        """Row, first and last window (by place in the row), fingerprint and digest of the word sequence of each run of
        neighbouring windows with one fingerprint."""
        w, k = self.window, self.shingle
        if not len(self.starts):
            z = np.zeros(0, np.int64)
            return z, z, z, z, np.zeros(0, np.uint8)
        at = np.arange(len(self.hashes) - k + 1)
        short = mix(self.rolling.slices(at, at + k))
        place = first_least(short, w - k + 1)[self.starts]
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (self.rows[1:] != self.rows[:-1])))
        begin = np.flatnonzero(new)
        last = np.concatenate((begin[1:], [len(new)])) - 1
        a, b, p = self.starts[begin], self.starts[last], place[begin]
        base = self.first[:-1][self.rows[begin]]
        return self.rows[begin], a - base, b - base, signed(short[p]), self.sequences(a, b + w)


FINGERPRINTS = "doc_id long, text_key long, first int, last int, fingerprint long, sequence binary"


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each run of neighbouring windows with one fingerprint, from rows with keys."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            body, offsets = buffers(batch.column(2))
            for a, b in chunks(offsets):
                row, first, last, mark, sequence = Windows(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).groups()
                columns = (ids[a + row], keys[a + row], first.astype(np.int32), last.astype(np.int32), mark)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), digest_column(sequence)], names=["doc_id", "text_key", "first", "last", "fingerprint", "sequence"])

    return docs.mapInArrow(run, FINGERPRINTS)


class FingerprintIndex:
    """Sorted immutable runs of (fingerprint, n), by level, in a folder. Runs are bucketed tables, so merge joins deal
    nothing out. What the index consists of is in a manifest that only grows, so a later session opens the index by its
    folder and adds to it; the newest line counts. Merged runs are dropped only after the line that does without them is
    written, so a session that is lost half way leaves the index as it was, or as it would have become; what it left over is
    never read."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, fan_out: int = FAN_OUT):
        self.spark, self.path, self.fan_out = spark, path or new_path(spark, "fingerprint-index"), fan_out
        self.buckets, self.version, self.batches = partitions(spark), 0, 0
        self.levels: list[list[tuple[str, str]]] = []
        self.hits: list[DataFrame] = []
        self.stale: list[tuple[str, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, fan_out: int = FAN_OUT) -> FingerprintIndex:
        """The index in a folder, as its last session left it; a run that is not there is an error."""
        out = cls(spark, path, fan_out=fan_out)
        last = spark.read.schema("version long, buckets int, batches int, runs string").json(f"{path}/manifest").orderBy(F.desc("version")).first()
        out.version, out.buckets, out.batches = last["version"], last["buckets"], last["batches"]
        out.levels = [[tuple(r) for r in level] for level in json.loads(last["runs"])]
        for name, at in out.runs():
            if not present(spark, f"{at}/_SUCCESS"):
                raise FileNotFoundError(f"the index lacks its run {at}")
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} (fingerprint BIGINT, n BIGINT) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {out.buckets} BUCKETS LOCATION '{at}'")
        return out

    def _save(self) -> None:
        self.version += 1
        line = self.spark.createDataFrame([(self.version, self.buckets, self.batches, json.dumps(self.levels))], "version long, buckets int, batches int, runs string")
        line.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def add_documents(self, batch: DataFrame) -> DataFrame:
        """Adds documents (doc_id, text) and returns what remove_spans returns for them: a word goes if a window over it also
        starts anywhere else in this batch or an earlier one. Hits are verified against the texts of all batches, which the
        index keeps for that."""
        bounded_batches(self.spark, "4m")
        at = lambda kind, k: f"{self.path}/{kind}-{k}"
        read = lambda kind, n: self.spark.read.parquet(*(at(kind, k) for k in range(n)))
        k = self.batches
        with_keys(batch).write.mode("overwrite").option("compression", "zstd").parquet(at("texts", k))
        own = self.spark.read.parquet(at("texts", k))
        fingerprints(own).write.mode("overwrite").option("compression", "zstd").parquet(at("marks", k))
        hits = self.add(self.spark.read.parquet(at("marks", k)))
        self.batches = k + 1
        self._save()
        self.sweep()
        candidates = written(read("marks", k + 1).join(hits.distinct(), "fingerprint", "left_semi"), "candidates")
        spans = verified_spans(read("texts", k + 1), candidates)
        return remove_spans(own, spans.join(own.select(*KEYS).distinct(), KEYS, "left_semi"))

    def _run(self, counts: DataFrame) -> tuple[str, str]:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}"
        counts.write.bucketBy(self.buckets, "fingerprint").sortBy("fingerprint").option("path", path).option("compression", "zstd").saveAsTable(name)
        return name, path

    def runs(self) -> list[tuple[str, str]]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of fingerprints and returns the hits that it brings: those that now occur twice or more."""
        run = self._run(batch.groupBy("fingerprint").agg(F.count("*").alias("n")))
        new = self.spark.table(run[0])
        hits = new.filter("n > 1").select("fingerprint")
        for name, _ in self.runs():
            hits = hits.union(new.join(self.spark.table(name).select("fingerprint"), "fingerprint").select("fingerprint"))
        hits = written(hits, "fingerprint-hits")
        self.hits.append(hits)
        self._push(run, 0)
        return hits

    def _push(self, run: tuple[str, str], level: int) -> None:
        """Puts a run in a level; a full level becomes one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            old = self.levels[level]
            tables = [self.spark.table(name) for name, _ in old]
            merged = tables[0]
            for t in tables[1:]:
                merged = merged.union(t)
            self.levels[level] = []
            self._push(self._run(merged.groupBy("fingerprint").agg(F.sum("n").alias("n"))), level + 1)
            self.stale += old

    def sweep(self) -> None:
        """Drops the runs that others have replaced."""
        for name, path in self.stale:
            self._drop(name, path)
        self.stale = []

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, path)

    def repeated(self) -> DataFrame:
        """All fingerprints that occur twice or more."""
        out = self.hits[0]
        for h in self.hits[1:]:
            out = out.union(h)
        return out.distinct()

    def close(self) -> None:
        """Drops the index and its folder."""
        self.sweep()
        for name, path in self.runs():
            self._drop(name, path)
        self.levels = []
        remove(self.spark, self.path)


def verified_spans(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, text_key, first and end (words) of every run of windows whose word sequence occurs twice or more."""
    same = ["fingerprint", "sequence"]
    sequences = candidates.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "first", "last")).alias("one"))
    sequences = written(sequences, "window-sequences")
    spans = candidates.join(sequences.filter("n > 1").select(*same), same, "left_semi").select(*KEYS, "first", (F.col("last") + WINDOW).alias("end"))
    # a fingerprint with one sequence alone has nothing left to compare; of the others one place for each sequence is hashed
    mixed = sequences.groupBy("fingerprint").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("fingerprint")
    places = sequences.join(mixed, "fingerprint", "left_semi").select("fingerprint", *(F.col("one")[c].alias(c) for c in (*KEYS, "first", "last")), (F.col("n") == 1).alias("single"))
    lists = places.groupBy(*KEYS).agg(F.collect_list(F.struct("first", "last", "single", "fingerprint")).alias("places"))
    joined = docs.join(lists, KEYS)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, listed = batch.column(0), batch.column(1), batch.column(3)
            body, offsets = buffers(batch.column(2))
            for i in range(len(batch)):
                text = body[offsets[i] : offsets[i + 1]]
                w = Windows(text, np.array([0, len(text)]))
                p = listed[i].values.flatten()
                first, last, single, mark = (x.to_numpy(zero_copy_only=False) for x in p)
                at = ranges(first, last - first + 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ids[i].as_py())), pa.array(np.full(n, keys[i].as_py())), pa.array(at.astype(np.int32)), *(pa.array(np.repeat(x, last - first + 1)) for x in (single, mark)), digest_column(w.sequences(at, at + WINDOW))],
                    names=[*KEYS, "first", "single", "fingerprint", "words"],
                )

    windows = written(joined.mapInArrow(run, "doc_id long, text_key long, first int, single boolean, fingerprint long, words binary").distinct(), "windows")
    again = windows.groupBy("fingerprint", "words").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint", "words")
    singles = windows.filter("single").join(again, ["fingerprint", "words"], "left_semi").select(*KEYS, "first", (F.col("first") + WINDOW).alias("end"))
    return spans.union(singles)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by blanks) of every row of docs."""
    lists = spans.groupBy(*KEYS).agg(F.collect_set(F.struct("first", "end")).alias("spans"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed = batch.column(2), batch.column(3)
            n_words, n_removed, kept = [], [], []
            for i in range(len(batch)):
                words = (texts[i].as_py() or "").encode().split()
                gone = np.zeros(len(words), bool)
                if listed[i].is_valid:
                    first, end = (x.to_numpy() for x in listed[i].values.flatten())
                    gone = covered(len(words), first, end)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "text_key", "n_words", "n_removed", "kept"])

    out = docs.join(lists, KEYS, "left").mapInArrow(run, "doc_id long, text_key long, n_words long, n_removed long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def dedup(docs: DataFrame, *, batches: int = BATCHES) -> DataFrame:
    """Adds docs to a new index batch by batch, and removes every word that a repeated window covers."""
    bounded_batches(docs.sparkSession, "4m")
    keyed = with_keys(docs)
    at = new_path(docs.sparkSession, "fingerprints")
    marks = written(fingerprints(keyed), "fingerprints", at)
    index = FingerprintIndex(docs.sparkSession)
    for b in range(batches):
        index.add(marks.filter(F.pmod("doc_id", F.lit(batches)) == b))
        index.sweep()
    # written first, so that the join below stands alone and the partition of a hot fingerprint can be split
    repeated = written(index.repeated(), "repeated-fingerprints")
    candidates = written(marks.join(repeated, "fingerprint", "left_semi"), "candidates")
    index.close()
    remove(docs.sparkSession, at)  # the candidates have replaced it
    return remove_spans(keyed, verified_spans(keyed, candidates))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
