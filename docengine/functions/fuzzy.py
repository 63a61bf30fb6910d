"""Text similarity that has no built-in: ratio of matching blocks, edit ratios of token sets and of the best part. Pandas UDFs
over Arrow."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over both lengths."""
    return SequenceMatcher(None, a, b).ratio()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of its table is the bits of one number, of which each character of
    the shared sequence clears one."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        met = row & where.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def edit_ratio(a: str, b: str) -> float:
    """1 less the insertions and deletions that turn a into b over both lengths; 0 to 100."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best edit ratio among the common words, and these with either text's other words; 0 to 100."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (not x - y or not y - x):
        return 100.0
    left, right = (" ".join([common, *sorted(s)]).strip() for s in (x - y, y - x))
    pairs = [(left, right)] + ([(common, left), (common, right)] if common else [])
    return max(edit_ratio(p, q) for p, q in pairs)


def partial_ratio(a: str, b: str) -> float:
    """The best edit ratio of the shorter text to a piece of the longer: as long, or cut short by an end; 0 to 100."""
    short, long = sorted((a.lower(), b.lower()), key=len)
    if not short:
        return 0.0 if long else 100.0
    pieces = lambda n, text: (text[max(0, i) : i + n] for i in range(1 - n, len(text)))
    best = max(edit_ratio(short, p) for p in pieces(len(short), long))
    return best if len(short) < len(long) else max(best, *(edit_ratio(long, p) for p in pieces(len(long), short)))


def owner_similarity(a: str, b: str) -> float:
    return max(partial_ratio(a, b), token_set_ratio(a, b)) / 100


class OwnerNames:
    """Names by number, for the best match of one among others. A similarity is at most what the names' characters allow:
    they share no more than both have, in BINS kinds of characters. Names with a common word are exempt, as few other words can
    make theirs higher. Others are compared in order of what they allow, until that is less than the best."""

    BINS = 64

    def __init__(self, names: list[str]):
        self.names = [n.lower() for n in names]
        self.bags = np.zeros((len(names), self.BINS), np.int32)
        self.sizes, self.words = np.zeros((2, len(names)), np.int64), {}
        for i, name in enumerate(self.names):
            letters = [0 if c.isspace() else 1 + ord(c) % (self.BINS - 1) for c in name]
            self.bags[i] = np.bincount(np.array(letters, np.int64), minlength=self.BINS)
            own = set(name.split())
            self.sizes[:, i] = len(name), len(" ".join(own))
            for w in own:
                self.words.setdefault(w, set()).add(i)

    def most(self, i: int, others: np.ndarray) -> np.ndarray:
        """The highest similarity that each of the others may have."""
        shared = np.minimum(self.bags[i], self.bags[others]).sum(axis=1)
        (a, p), (b, q) = self.sizes[:, i], self.sizes[:, others]
        least = np.minimum(a, b)
        within = np.minimum(shared, least)
        part = np.where(least > 0, 2 * within / np.maximum(least + within, 1), 1.0)
        sets = 2 * np.minimum(shared, np.minimum(p, q)) / np.maximum(p + q, 1)
        met = set().union(*(self.words[w] for w in self.names[i].split()))
        return np.where(np.isin(others, list(met)), 1.0, np.maximum(part, sets))

    def best(self, i: int, others: list[int], threshold: float) -> int | None:
        """The most similar of the others, the first of equal ones, if any has the threshold."""
        at = np.array(others, np.int64)
        most = self.most(i, at)
        found, place = threshold, None
        for k in np.argsort(-most, kind="stable").tolist():
            if most[k] < found - 1e-9 or found == 1.0 and place is not None and k > place:
                break
            score = owner_similarity(self.names[others[k]], self.names[i])
            if score > found or score == found and (place is None or k < place):
                found, place = score, k
        return None if place is None else others[place]


def surname_similarity(a: str, b: str) -> float:
    """The ratio, raised to 0.85 for names that share their last word."""
    x, y = a.lower().strip(), b.lower().strip()
    out = ratio(x, y)
    if out < 0.8 and x.split() and y.split() and x.split()[-1] == y.split()[-1]:
        out = max(out, 0.85)
    return out


def _pairwise(fn):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def ratio_column(a, b):
    return _pairwise(ratio)(a, b)


def surname_column(a, b):
    return _pairwise(surname_similarity)(a, b)


def best_window(quote: str, source: str) -> tuple[float, str]:
    """The best token-set ratio of a quote to the windows of its source, and the first such window without white space at its
    ends. Windows have one and a half of the quote's length and begin a quarter of it apart; a source shorter than a window
    has none.

    A window's ratio is at most what its characters allow: it shares no more of them with the quote than both have. Windows
    that may hold one of the quote's words are exempt, as few other words can make their ratio higher. Windows are tried in
    order of what they allow, until that is less than the best."""
    size, step = int(len(quote) * 1.5), max(1, len(quote) // 4)
    q, low = quote.strip().lower(), source.lower()
    words = set(q.split())
    starts = np.arange(0, len(source) - size + 1, step)
    if not len(starts) or not words:
        return 0.0, ""
    own = " ".join(sorted(words))
    letters = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.minimum(starts + size, len(letters))
    within = np.minimum(starts, len(letters))
    shared = np.full(len(starts), len(words) - 1)
    for c, n in Counter(own.replace(" ", "")).items():
        count = np.concatenate(([0], np.cumsum(letters == ord(c))))
        shared += np.minimum(count[ends] - count[within], n)
    shared = np.minimum(shared, len(own))
    most = 200.0 * shared / (len(own) + shared)
    for w in words:
        at = [m.start() for m in re.finditer(f"(?={re.escape(w)})", low)]
        if at:
            first = np.searchsorted(at, starts)
            most[(first < len(at)) & (np.take(at, np.minimum(first, len(at) - 1)) + len(w) <= starts + size)] = 100.0
    best, place = 0.0, -1
    for k in np.argsort(-most, kind="stable").tolist():
        if most[k] < best - 1e-9 or best == 100.0 and k > place:
            break
        i = int(starts[k])
        score = token_set_ratio(q, low[i : i + size])
        if score > best or (score == best and 0 <= k < place):
            best, place = score, k
    return best, source[starts[place] : starts[place] + size].strip() if place >= 0 else ""


def citation_score(quote: str | None, source: str | None) -> float:
    """100 for a quote found in its source; else that of its best window."""
    if not quote or not source:
        return 0.0
    return 100.0 if quote.strip().lower() in source.lower() else best_window(quote, source)[0]


def best_windows(df: DataFrame, quote: str, source: str) -> DataFrame:
    """df with score and snippet of each row's best window."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [best_window(q, s) for q, s in zip(b[quote], b[source])]
            yield b.assign(score=[float(x) for x, _ in found], snippet=[x for _, x in found])

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("snippet", StringType())]))
