"""Similarity join on word n-grams by adaptive multi-match prefixes.

Documents whose words are equal, by a cryptographic digest, are one class, and only its smallest document takes part. Its
n-grams are put in one order for all documents, rare ones first; two sets similar enough share at least l of their first
n - needed + l n-grams, for every l. Each document picks the l for which its prefix costs least, by the known frequencies: a
longer prefix has more n-grams to look up but asks more shared ones of a candidate before it is verified. Verification
compares whole sets, word by word; hashes of n-grams only find candidates.

Frequencies are counted over all documents. They can be left out for a fixed share of the n-grams by hash, which the order
then puts last: that is as valid, exchanges less, and forms more candidates. Candidates are verified
first against one central document of each n-gram's group; components of those links then need no pairs among themselves, so
a large group of near copies is settled by stars, and only pairs across components are listed, by an n-gram that can be the
first that both share.

Defined cases: a null or blank text has no n-grams and is linked with nothing; a text with fewer words than n has its whole
word sequence as its only n-gram; rows that repeat are copies of each other; rows of one doc_id are one document as far
as components go, except in keep_one by row; a null doc_id counts as smallest; extra columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm import packs
from docengine.llm.common import (
    GROUP_BYTES, SPACES, Rolling, bounded_batches, buffers, chunks, digests, fold_case, groups_for, mix, ranges, released, signed, spaced, word_hashes, words_of, written,
)
from docengine.llm.components import components
from docengine.llm.substring_dedup import KEYS, key_columns, with_keys

#: The longest lead over the least prefix that a document may choose.
MOST_MATCHES = 4
#: The share of all n-grams, by hash, whose frequencies are counted. In large groups of near copies the rare n-grams that
#: tell copies apart must come first, or nearly all pairs of a group are candidates.
BAND = 1.0

U64 = np.uint64


class Grams:
    """The n-grams of some rows with what they hash to, in order of row and hash; words are numbered through all rows."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, n: int):
        self.body = fold_case(body)
        self.start, self.end, self.first = words_of(self.body, offsets)
        rolling = Rolling(word_hashes(self.body, self.start, self.end))
        words = np.diff(self.first)
        grams = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
        at = ranges(self.first[:-1], grams)
        row = np.repeat(np.arange(len(words)), grams)
        size = np.minimum(words, n)[row]
        value = mix(rolling.slices(at, at + size) ^ mix(size.astype(U64)))
        order = np.lexsort((value, row))
        self.row, self.value, self.at, self.size = row[order], value[order], at[order], size[order]

    def __len__(self) -> int:
        return len(self.first) - 1

    def words(self) -> pa.Array:
        """All words, as bytes."""
        text, at = spaced(self.body, self.start, self.end)
        edges = at - np.arange(len(at))
        letters = np.delete(text, at[1:] - 1)
        return pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(letters)])


def word_numbers(*sides: Grams) -> list[np.ndarray]:
    """For each side a number of each of its words; equal numbers are equal words, on all sides."""
    numbers = pa.concat_arrays([g.words() for g in sides]).dictionary_encode().indices.to_numpy()
    return np.split(numbers, np.cumsum([len(g.start) for g in sides])[:-1])


def equal_grams(x: np.ndarray, at: np.ndarray, size: np.ndarray, y: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether the n-grams that begin at the words at of x are those that begin at other of y, word by word."""
    out = size == other_size
    for k in range(int(size.max(initial=0))):
        i = np.flatnonzero(out & (size > k))
        out[i] = x[at[i] + k] == y[other[i] + k]
    return out


def distinct(g: Grams, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which n-grams are the first of their hash in their row, how many distinct ones each row has, and the rows where
    different n-grams have one hash, whose number is counted by the words themselves."""
    keep = packs.runs_of(g.row, g.value)
    sizes = np.bincount(g.row[keep], minlength=len(g))
    again = np.ones(len(g.row), bool)
    again[keep] = False
    i = np.flatnonzero(again)
    if not len(i):
        return keep, sizes, i
    numbers = word_numbers(g)[0] if numbers is None else numbers
    apart = np.unique(g.row[i[~equal_grams(numbers, g.at[i], g.size[i], numbers, g.at[i - 1], g.size[i - 1])]])
    for r in apart.tolist():
        sizes[r] = len(gram_set(g, numbers, r))
    return keep, sizes, apart


def gram_set(g: Grams, numbers: np.ndarray, row: int) -> set[tuple[int, ...]]:
    a, b = np.searchsorted(g.row, [row, row + 1])
    return {tuple(numbers[i : i + k].tolist()) for i, k in zip(g.at[a:b].tolist(), g.size[a:b].tolist())}


def common_grams(left: Grams, right: Grams) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct n-grams the two sides share in each row, and how many they have in all, counted on each side."""
    x, y = word_numbers(left, right)
    (i, n, odd), (j, m, odder) = distinct(left, x), distinct(right, y)
    row, value, place = (np.concatenate(z) for z in ((left.row[i], right.row[j]), (left.value[i], right.value[j]), (i, j)))
    order = np.lexsort((value, row))
    row, value, place = row[order], value[order], place[order]
    # lexsort is stable, so of two equal ones the left side's comes first
    both = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
    i, j = place[both], place[both + 1]
    alike = equal_grams(x, left.at[i], left.size[i], y, right.at[j], right.size[j])
    common = np.bincount(row[both], minlength=len(left))
    for r in np.unique(np.concatenate((odd, odder, row[both[~alike]]))).tolist():
        common[r] = len(gram_set(left, x, r) & gram_set(right, y, r))
    return common, n + m


def sets_of(body: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and value of every distinct n-gram's hash, in order of both, and the number of each row."""
    g = Grams(body, offsets, n)
    keep = packs.runs_of(g.row, g.value)
    return g.row[keep], g.value[keep], np.bincount(g.row[keep], minlength=len(g))


def in_band(values: np.ndarray, share: float) -> np.ndarray:
    """A fixed share of all values, by hash."""
    return (values & U64(0xFFFF)) < U64(int(share * 65536))


def needed(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n with any set similar enough."""
    return -(-percent * n // 100)


#: s1 and s2 are the halves of a digest of a text's words.
INFO = "doc_id long, text_key long, n_shingles long, s1 long, s2 long"


def _info(n: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = buffers(batch.column(2))
            sizes, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
            for a, b in chunks(offsets):
                g = Grams(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                sizes.append(distinct(g)[1])
                text, at = spaced(g.body, g.start, g.end)
                marks.append(digests(text, at[g.first[:-1]], at[g.first[1:]]))
            halves = np.concatenate(marks).view(np.int64).reshape(-1, 2)
            columns = [pa.array(np.concatenate(sizes), pa.int64()), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[*KEYS, "n_shingles", "s1", "s2"])

    return run


def _send(groups: int, n: int, share: float):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packs.Packer(groups)
        for batch in batches:
            g = batch.column(0).to_numpy()
            body, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                row, value, _ = sets_of(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                keep = in_band(value, share)
                yield from packer.add(g[a + row[keep]].astype(np.int64), value[keep])
        yield from packer.flush()

    return run


PREFIXES = "token long, doc_id long, text_key long, n_shingles long, place int, level int, matches int, text string"


def matches_for(frequency: np.ndarray, n: int, base: int) -> int:
    """How many shared n-grams a document asks for, from the frequencies of its n-grams in order: looking up a prefix
    costs its n-grams' frequencies, and at most their sum over l documents share l of them and are verified."""
    best, choice = None, 1
    for l in range(1, MOST_MATCHES + 1):  # noqa: E741
        length = base + l - 1
        if length > n:
            break
        looked_up = int(frequency[:length].sum() - length)
        cost = looked_up + looked_up / l * n
        if best is None or cost < best:
            best, choice = cost, l
    return choice


def _prefixes(n: int, percent: int, share: float):
    @released
    def run(docs: pa.Table, other: pa.Table) -> pa.Table:
        known, counts = packs.unpack_values(other.column("fps")), packs.unpack(other.column("counts"), np.uint32)
        order = np.argsort(known)
        known, counts = known[order], counts[order].astype(np.int64)
        rep = {(a, b): c for a, b, c in zip(*(other.column(c).to_pylist() for c in (*KEYS, "n_shingles"))) if b is not None}
        out: dict[str, list] = {k: [] for k in ("token", "doc_id", "text_key", "n_shingles", "place", "level", "matches")}
        texts: dict[str, list] = {k: [] for k in ("doc_id", "text_key", "n_shingles", "text")}
        for batch in docs.to_batches():
            ids, keys, column = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text")
            body, offsets = buffers(column)
            for a, b in chunks(offsets):
                _, values, sizes = sets_of(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                at = 0
                for i, size in enumerate(sizes.tolist(), a):
                    value = values[at : at + size]
                    at += size
                    key = (ids[i], keys[i])
                    if not size or key not in rep:
                        continue
                    hashed, size = size, rep.pop(key)
                    band = in_band(value, share)
                    frequency = np.where(band, 1, 2)
                    if len(known):
                        short = packs.sent(value)
                        place = np.minimum(np.searchsorted(known, short), len(known) - 1)
                        found = band & (known[place] == short)
                        frequency[found] = counts[place[found]]
                    base = size - int(needed(size, percent)) + 1
                    put = np.lexsort((value, frequency, ~band))[: base + MOST_MATCHES - 1]
                    # a set that has fewer hashes than n-grams may share fewer of them: then one is enough
                    matches = matches_for(frequency[put], size, base) if hashed == size else 1
                    put = put[: base + matches - 1]
                    level = np.maximum(np.arange(len(put)) - base + 2, 1)
                    shared = frequency[put] > 1
                    if shared.any():
                        m = int(shared.sum())
                        out["token"].append(signed(value[put][shared]))
                        out["doc_id"].append(np.full(m, key[0]))
                        out["text_key"].append(np.full(m, key[1]))
                        out["n_shingles"].append(np.full(m, size))
                        out["place"].append(np.flatnonzero(shared))
                        out["level"].append(level[shared])
                        out["matches"].append(np.full(m, matches))
                        for k, x in zip(texts, (*key, size, column[i].as_py())):
                            texts[k].append(x)
        types = dict(zip(("token", "doc_id", "text_key", "n_shingles", "place", "level", "matches", "text"), (*[pa.int64()] * 4, *[pa.int32()] * 3, pa.string())))
        rows = {k: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), types[k]) for k, x in out.items()}
        first = pa.table(rows | {"text": pa.nulls(len(rows["token"]), pa.string())})
        m = len(texts["doc_id"])
        second = pa.table({k: pa.array(texts[k], t) if k in texts else pa.nulls(m, t) for k, t in types.items()})
        return pa.concat_tables([first, second])

    return run


def _verified(n: int, percent: int):
    """Keeps the pairs whose sets are similar enough; columns u, v and the two texts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            left, right = buffers(batch.column(2)), buffers(batch.column(3))
            for a, b in chunks(left[1] + right[1]):
                common, sizes = common_grams(*(Grams(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n) for body, offsets in (left, right)))
                good[a:b] = 100 * common >= percent * (sizes - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

    return run


def member(by_row: bool, doc_id: str = "doc_id", text_key: str = "text_key") -> Column:
    """What components link: documents by doc_id, or rows by doc_id and text_key, so that rows of one id are told apart."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.col(text_key).alias("text_key")) if by_row else F.col(doc_id)


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, by_row: bool = False) -> DataFrame:
    """The pairs (u, u_key, v, v_key) that are similar enough, as members u and v."""
    side = lambda p: texts.select(F.col("doc_id").alias(p), F.col("text_key").alias(f"{p}_key"), F.col("text").alias(f"{p}_text"))
    joined = pairs.join(side("u"), ["u", "u_key"]).join(side("v"), ["v", "v_key"])
    ends = joined.select(member(by_row, "u", "u_key").alias("u"), member(by_row, "v", "v_key").alias("v"), "u_text", "v_text")
    kind = "struct<doc_id: long, text_key: long>" if by_row else "long"
    return ends.mapInArrow(_verified(n, percent), f"u {kind}, v {kind}")


def _may_link(a: tuple[str, str], b: tuple[str, str], percent: int):
    """Whether two sets whose first shared n-gram has these places may be similar enough: no more n-grams are shared than
    both have from there on. Each of a and b names a size and a place."""
    (n, p), (m, q) = ((F.col(x), F.col(y)) for x, y in (a, b))
    overlap = F.ceil(percent * (n + m) / (100 + percent))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - p, m - q) >= overlap)


def star_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Each document of an n-gram's group with the group's head: the one that has the n-gram first in its order. In a group
    of near copies that is one with few changes of its own, so most of the others are similar to it."""
    first = prefixes.filter("level = 1")
    heads = first.groupBy("token").agg(F.min(F.struct("place", *KEYS, "n_shingles")).alias("h"), F.count("*").alias("c")).filter("c > 1")
    heads = heads.select("token", F.col("h.doc_id").alias("v"), F.col("h.text_key").alias("v_key"), F.col("h.n_shingles").alias("v_n"), F.col("h.place").alias("v_place"))
    met = first.join(heads, "token").filter(((F.col("doc_id") != F.col("v")) | (F.col("text_key") != F.col("v_key"))) & _may_link(("n_shingles", "place"), ("v_n", "v_place"), percent))
    return met.select(F.col("doc_id").alias("u"), F.col("text_key").alias("u_key"), "v", "v_key").distinct()


def cross_pairs(prefixes: DataFrame, roots: DataFrame, percent: int, by_row: bool = False) -> DataFrame:
    """Pairs of different components that share as many prefix n-grams as both ask for. They meet at an n-gram that may be
    the first they share, which lies in the shortest prefix of both; then the shared ones of the longer prefixes are
    counted. In each n-gram's group the pairs within its largest component are never formed."""
    first = prefixes.filter("level = 1").drop("level")
    rows = first.withColumn("id", member(by_row)).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).drop("id")
    per_root = rows.groupBy("token", "root").agg(F.count("*").alias("c"))
    groups = per_root.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds")
    mixed = written(rows.join(groups, "token"), "mixed-prefixes")
    left = mixed.filter("root <> major").select("token", *(F.col(c).alias(f"a_{c}") for c in (*KEYS, "n_shingles", "place", "matches", "root")))
    right = mixed.select("token", "major", *(F.col(c).alias(f"b_{c}") for c in (*KEYS, "n_shingles", "place", "matches", "root")))
    met = left.join(right, "token").filter(
        (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("major")) | (F.col("a_root") < F.col("b_root")))
        & _may_link(("a_n_shingles", "a_place"), ("b_n_shingles", "b_place"), percent)
    )
    a, b = F.struct(F.col("a_doc_id").alias("id"), F.col("a_text_key").alias("key")), F.struct(F.col("b_doc_id").alias("id"), F.col("b_text_key").alias("key"))
    met = met.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"), F.least("a_matches", "b_matches").alias("asked")).distinct()
    pairs = written(met.select(F.col("x.id").alias("u"), F.col("x.key").alias("u_key"), F.col("y.id").alias("v"), F.col("y.key").alias("v_key"), "asked"), "cross-candidates")
    side = lambda p: prefixes.select(F.col("doc_id").alias(p), F.col("text_key").alias(f"{p}_key"), "token", F.col("level").alias(f"{p}_level"))
    both = pairs.filter("asked > 1").join(side("u"), ["u", "u_key"]).filter("u_level <= asked").join(side("v"), ["v", "v_key", "token"]).filter("v_level <= asked")
    several = both.groupBy("u", "u_key", "v", "v_key", "asked").agg(F.count("*").alias("c")).filter("c >= asked")
    ends = ("u", "u_key", "v", "v_key")
    return pairs.filter("asked = 1").select(*ends).union(several.select(*ends))


def similar_groups(docs: DataFrame, *, n: int, percent: int, by_row: bool = False) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of every row of docs with keys: the least member of its component."""
    (p,), share = groups_for(docs, GROUP_BYTES), BAND
    bounded_batches(docs.sparkSession)
    info = written(docs.mapInArrow(_info(n), INFO), "ngram-sets")
    same = ["n_shingles", "s1", "s2"]
    classes = info.filter("n_shingles > 0").groupBy(*same).agg(F.min(F.struct(*KEYS)).alias("rep"), F.count("*").alias("members"))
    group = F.pmod(F.xxhash64(*KEYS), F.lit(p)).cast("int").alias("g")
    grouped = docs.select(group, *KEYS, "text")
    wanted = packs.repeated_by_group(grouped.select("g", "text").mapInArrow(_send(p, n, share), packs.SCHEMA))
    reps = classes.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"), "n_shingles").select(group, *KEYS, "n_shingles")
    other = wanted.unionByName(reps, allowMissingColumns=True)
    both = written(grouped.groupBy("g").cogroup(other.groupBy("g")).applyInArrow(_prefixes(n, percent, share), PREFIXES), "ngram-prefixes")
    prefixes, texts = both.filter("token IS NOT NULL").drop("text"), both.filter("token IS NULL").select(*KEYS, "text")
    stars = written(verify(star_pairs(prefixes, percent), texts, n, percent, by_row), "star-links")
    cross = written(verify(cross_pairs(prefixes, components(stars), percent, by_row), texts, n, percent, by_row), "cross-links")
    copies = info.join(classes.filter("members > 1").drop("members"), same).select(member(by_row).alias("u"), member(by_row, "rep.doc_id", "rep.text_key").alias("v"))
    roots = components(stars.union(cross).union(copies))
    return info.withColumn("id", member(by_row)).join(roots, "id", "left").select(*KEYS, "n_shingles", F.coalesce("root", "id").alias("component_id"))


def join(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: components of links of at least percent Jaccard similarity."""
    out = similar_groups(with_keys(docs), n=n, percent=percent)
    back = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    return out.select(back("doc_id"), "n_shingles", back("component_id"))


def keep_one(docs: DataFrame, *, n: int = 5, percent: int = 80, by_row: bool = False) -> DataFrame:
    """The rows of docs without those that are not the first of their group, with all their columns. Rows without n-grams
    are in no group and stay. By row, only texts link rows: unrelated texts of one doc_id, or of none, all stay."""
    keyed = docs.select(F.struct("*").alias("row"), *key_columns())
    groups = similar_groups(with_keys(docs), n=n, percent=percent, by_row=by_row)
    first = groups.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(*KEYS)).alias("k")).select("k.*")
    has_words = F.coalesce(F.col("row.text").rlike(f"[^{SPACES}]"), F.lit(False))
    kept = keyed.filter(has_words).join(first, KEYS, "left_semi").dropDuplicates(KEYS)
    return kept.select("row.*").union(keyed.filter(~has_words).select("row.*"))
