"""Language id by hyperdimensional profiles: every letter has a random vector of +1 and -1, an n-gram's vector binds its
letters' vectors, each permuted by its place, a text's vector bundles its n-grams' vectors, and a text gets the language
whose prototype, the bundle of its training texts, has the largest cosine with it.

Defined cases: a null text or one without a letter is "und" with score 0; so is every text when there is nothing to learn
from. Equal cosines go to the first language by name. The score is the cosine, at least 0. Repeated rows count each time,
extra columns are ignored, an empty table gives no rows. Long texts are bundled whole, in pieces of bounded size that give
the same n-grams as the text in one. What the driver holds grows with the number of languages, 512 numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import sample_fraction

DIMENSIONS = 512
NGRAM = 3
#: Slots of the letter vectors; letters beyond share them by code point.
LETTERS = 1024
#: Training texts of a language, about.
MAX_TEXTS = 4_000
#: Characters bundled at once.
PIECE = 1 << 18
#: Prototypes are summed as whole numbers of this fraction, so that the order of summing does not matter.
UNIT = 1 << 20


class Encoder:
    """Text vectors; the letter vectors come from a fixed seed, so every worker has the same."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        letters = np.random.default_rng(seed).integers(0, 2, (LETTERS, dimensions), dtype=np.int8) * np.int8(2) - np.int8(1)
        self.dimensions = dimensions
        self.placed = [np.roll(letters, NGRAM - 1 - k, axis=1) for k in range(NGRAM)]
        self.slots = np.zeros(0x110000, np.int64)
        known = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
        self.slots[known] = np.where(known < LETTERS, known, known % (LETTERS - 1) + 1)

    def grams(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The n-grams of letters, with one blank for each run of other characters and at both ends, and how often each
        occurs, by pieces of the text; a piece begins with the last slots of the one before, so none is lost or made."""
        text, before = text.lower(), np.zeros(1, np.int64)
        for i in range(0, len(text), PIECE):
            codes = np.concatenate((before, self.slots[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]))
            if i + PIECE >= len(text):
                codes = np.append(codes, 0)
            codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
            before = codes[1 - NGRAM :]
            found = np.zeros(max(0, len(codes) - NGRAM + 1), np.int64)
            for k in range(NGRAM):
                found = found * LETTERS + codes[k : len(codes) - NGRAM + 1 + k]
            if len(found):
                yield np.unique(found, return_counts=True)

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundle scaled to length 1; None without letters."""
        total, letters = np.zeros(self.dimensions), False
        for grams, n in self.grams(text or ""):
            letters = letters or bool(grams.any())
            for j in range(0, len(grams), 4096):
                g = grams[j : j + 4096]
                bound = self.placed[NGRAM - 1][g % LETTERS]
                for k in range(NGRAM - 2, -1, -1):
                    g = g // LETTERS
                    bound *= self.placed[k][g % LETTERS]
                total += n[j : j + 4096].astype(np.float32) @ bound.astype(np.float32)
        if not letters:
            return None
        size = np.linalg.norm(total)
        return total / size if size else total


_ENCODER: list[Encoder] = []


def encoder() -> Encoder:
    """One for each Python worker."""
    if not _ENCODER:
        _ENCODER.append(Encoder())
    return _ENCODER[0]


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language of a partition's texts the sum of their vectors: no more rows than languages."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            v = encoder().vector(text)
            if v is not None:
                sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                sums[lang] += np.rint(v * UNIT).astype(np.int64)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * DIMENSIONS, "place": list(range(DIMENSIONS)), "v": v})


def train(docs: DataFrame, *, max_texts: int = MAX_TEXTS) -> dict[str, np.ndarray]:
    """Prototypes by language from columns text and lang (null: left out). Each language has about max_texts of its
    texts bundled, picked by hash of the text: the one documented bound here. The result has DIMENSIONS numbers for each
    language, whatever the size of docs."""
    labelled = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not rows:
        return {}
    share = F.create_map(*(F.lit(x) for lang in rows for x in (lang, int(sample_fraction(rows[lang], max_texts) * (1 << 30)))))
    sample = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    found: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(_bundles, "lang string, place long, v long").groupBy("lang", "place").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["place"]] = r["v"]
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(found.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score from columns doc_id, held_out and text."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names]) if names else np.zeros((0, DIMENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(2).to_pylist():
                v = encoder().vector(text) if names else None
                if v is None:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    cosines = matrix @ v
                    best = int(np.argmax(cosines))
                    langs.append(names[best])
                    scores.append(float(np.clip(cosines[best], 0.0, 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """One document in five, by CRC-32 of its id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, *, max_texts: int = MAX_TEXTS) -> DataFrame:
    """Learns from the documents that are not held out, then predicts every document."""
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(marked, train(marked.filter(~F.col("held_out")), max_texts=max_texts))
