"""Long texts in overlapping pieces that end at a boundary, Markdown tables and sections, as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

WHOLE, SIZE, OVERLAP, LOOK_BACK = 100_000, 80_000, 2_000, 500


def boundary(text: str, start: int, end: int, size: int, look_back: int = LOOK_BACK) -> int:
    """Where to end a piece: behind a paragraph, else behind a sentence and its blank, else before a blank, within the last
    characters; else at end. A piece has a fifth of size at least, 10,000 characters at most of that."""
    least = min(size // 5, 10_000)
    if end - start < least:
        return end
    low = max(start + least, end - look_back)
    region = text[low:end]
    paragraph, sentences, blank = region.rfind("\n\n"), [m.end() for m in re.finditer(r"[.!?][ \n]", region)], region.rfind(" ")
    if paragraph >= 0:
        return low + paragraph + 2
    if sentences:
        return low + sentences[-1]
    return low + blank if blank >= 0 else end


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, whole: int = WHOLE) -> list[tuple[int, str]]:
    """(start, piece) of a text; a text of no more than whole characters is one piece. A piece that a boundary would leave
    shorter than half of size ends at size. The next begins overlap before its end; where that is less than a tenth of size
    on, it begins size less overlap on. So the last piece may be no more than the overlap with the one before."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    if len(text) <= whole:
        return [(0, text)]
    out, start = [], 0
    while start < len(text):
        end = full = min(start + size, len(text))
        if end < len(text):
            end = boundary(text, start, end, size)
            end = full if end < start + size // 2 else end
        out.append((start, text[start:end]))
        step = end - start - overlap
        start += step if step >= size // 10 else size - overlap
    return out


def chunk(docs: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP, whole: int = WHOLE) -> DataFrame:
    """doc_id, chunk_no, n_chunks, start and chunk of every text; a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = ((d, split_text(t, size, overlap, whole)) for d, t in zip(b["doc_id"], b["text"]) if t is not None)
            yield pd.DataFrame([(d, i, len(p), s, c) for d, p in parts for i, (s, c) in enumerate(p)], columns=["doc_id", "chunk_no", "n_chunks", "start", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_no int, n_chunks int, start long, chunk string")


def tables_of(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """Header and rows of the Markdown tables of a text."""
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    out = []
    for block in re.findall(r"(?:^\|.*\|[ \t]*(?:\n|$))+", text, re.M):
        lines = [x for x in block.split("\n") if x.strip()]
        if len(lines) >= 2 and re.fullmatch(r"[-:| ]+", lines[1].strip()):
            out.append((cells(lines[0]), [cells(x) for x in lines[2:] if not re.fullmatch(r"[-:| ]+", x.strip())]))
    return out


def sections_of(text: str) -> list[tuple[int, str, int, int, int]]:
    """Level, title, line, offset and parent (place in the list, -1 at the top) of the headings of a text."""
    out, open_ = [], []
    offset = 0
    for n, line in enumerate(text.split("\n")):
        m = re.match(r"(#{1,6})\s+(.+?)\s*$", line)
        if m:
            level = len(m[1])
            while open_ and out[open_[-1]][0] >= level:
                open_.pop()
            out.append((level, m[2], n, offset, open_[-1] if open_ else -1))
            open_.append(len(out) - 1)
        offset += len(line) + 1
    return out


def sections(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, *s) for d, t in zip(b["doc_id"], b["text"]) if t is not None for i, s in enumerate(sections_of(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "level", "title", "line", "offset", "parent"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, pos int, level int, title string, line long, offset long, parent int")


def tables(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, h, r, len(r)) for d, t in zip(b["doc_id"], b["text"]) if t is not None for i, (h, r) in enumerate(tables_of(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "table_no", "header", "rows", "n_rows"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, table_no int, header array<string>, rows array<array<string>>, n_rows long")
