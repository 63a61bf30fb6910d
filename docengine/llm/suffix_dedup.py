"""Suffix-array deduplication: bytes covered by a string of fixed length that also starts in a document with a smaller id
are removed.

Only text that may repeat is sorted. Every window of the string's length has a fingerprint, the hash of the least short
byte run in it, so equal windows have equal ones; the groups of documents learn which of their fingerprints occur twice or
more. The text around those goes, by fingerprint, to shards, so that equal windows meet in one shard, and each shard's
suffixes are sorted by external induced sorting (see suffix_array), which carries the common prefixes of neighbours along.
Neighbours that have the string's length in common are the repeats, and of those the smallest doc_id keeps its bytes.
Regions alike are one; those that differ are sorted if they have enough around their least byte run in common, as else no
window of theirs can be equal. A group sends a region of text once, whether one of its documents has it or a third of all: a shard gets no more copies than
there are groups, and sorts a region once. At the edge of a shared passage regions reach into each document's own text and
nearly all differ. So where a fingerprint occurs more than HOT times its windows are compared one by one, by 128 bits of
hash, and dealt out by that hash: of one fingerprint a shard gets no more than HOT regions to sort.

Groups and shards follow the input's size. A shard's text, its sort and what the sort finds are in files of the task; in
memory are some fifty bytes for each region.

Defined cases: a null or empty text has no bytes; a text shorter than the string keeps all; a null doc_id counts as
smaller than all others; rows with one doc_id take nothing from each other, rows that repeat get the same result; extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm import packs
from docengine.llm.common import BYTE_VALUES, GROUP_BYTES, Rolling, bounded_batches, buffers, chunks, covered, first_least, groups_for, mix, ranges, release_memory, released, whole
from docengine.llm.substring_dedup import key_columns
from docengine.llm.suffix_array import MEMORY, Column, padded, scratch, suffixes

LENGTH = 50
#: Bytes of the short runs whose least hash is a window's fingerprint.
SHINGLE = 20
#: Bytes of the input for each shard, about.
SHARD_BYTES = 4 << 20
#: Occurrences of a fingerprint beyond which its windows are dealt out one by one.
HOT = 4096

U64 = np.uint64


def window_groups(body: np.ndarray, offsets: np.ndarray, length: int = LENGTH, shingle: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """Row, first and last window (by place in the row), fingerprint and least short run (by place from the first window) of
    each run of neighbouring windows that share their least short run."""
    n_windows = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = ranges(offsets[:-1], n_windows)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(U64), z
    rows = np.repeat(np.arange(len(n_windows)), n_windows)
    at = np.arange(len(body) - shingle + 1)
    short = mix(Rolling(BYTE_VALUES[0][body]).slices(at, at + shingle))
    place = first_least(short, length - shingle + 1)[starts]
    begin = packs.runs_of(place, rows)
    last = np.concatenate((begin[1:], [len(place)])) - 1
    base = offsets[:-1][rows[begin]]
    return rows[begin], starts[begin] - base, starts[last] - base, short[place[begin]], place[begin] - starts[begin]


def _send(groups: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packs.Packer(groups)
        for batch in batches:
            g = batch.column(0).to_numpy()
            body, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                row, _, _, marks, _ = window_groups(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield from packer.add(g[a + row].astype(np.int64), marks)
        yield from packer.flush()

    return run


def region_keys(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each region's bytes, 128 bits in all: regions alike in them count as equal."""
    size = mix((end - start).astype(U64))
    return tuple(mix(Rolling(BYTE_VALUES[lane][body], lane).slices(start, end) ^ size) for lane in (0, 1))


def _hits(table: pa.Table, known):
    """By pieces of a group's text: row, first place, size and keys of the regions, their marks and least runs, where known says so."""
    body, offsets = buffers(whole(table.column("text")))
    for a, b in chunks(offsets):
        part, at = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        row, first, last, marks, least_run = window_groups(part, at)
        begin = at[row] + first
        yield from known(a, part, row, first, begin, begin + last - first + LENGTH, marks, least_run)


def single_windows(hot: np.ndarray, row: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, marks: np.ndarray, least_run: np.ndarray) -> tuple[np.ndarray, ...]:
    """The regions with each hot one replaced by its windows, which have no least run of their own."""
    n = np.where(hot, end - begin - LENGTH + 1, 1)
    of, step = np.repeat(np.arange(len(row)), n), ranges(np.zeros(len(row), np.int64), n)
    begin, hot = begin[of] + step, hot[of]
    return hot, row[of], first[of] + step, begin, np.where(hot, begin + LENGTH, end[of]), marks[of], np.where(hot, 0, least_run[of])


#: runs: where each region's least short run begins in it. hot: keys and fingerprints of the windows of hot fingerprints,
#: which come last and have no bytes in body.
REGIONS = "shard int, g int, least binary, most binary, sizes binary, runs binary, body binary, hot binary"
FORMS = {"least": np.int64, "most": np.int64, "sizes": np.uint8, "runs": np.uint8, "body": np.uint8, "hot": U64}


def _regions(shards: int, most_alike: int = HOT):
    """The text around a group's repeated fingerprints, packed by shard and compressed. However many of the group's
    documents have a region, or a window of a fingerprint with more than most_alike occurrences, it is sent once, with
    their least and greatest ids."""

    @released
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        known, counts = packs.unpack_values(wanted.column("fps")), packs.unpack(wanted.column("counts"), np.uint32)
        order = np.argsort(known)
        known, counts = known[order], counts[order]
        found: list[tuple] = []

        def repeated(a, part, row, first, begin, end, marks, least_run):
            marks = packs.sent(marks)
            at = np.minimum(np.searchsorted(known, marks), len(known) - 1)
            hit = known[at] == marks
            row, first, begin, end, marks, least_run, hot = row[hit], first[hit], begin[hit], end[hit], marks[hit], least_run[hit], counts[at[hit]] > most_alike
            if len(row):
                if hot.any():
                    hot, row, first, begin, end, marks, least_run = single_windows(hot, row, first, begin, end, marks, least_run)
                k0, k1 = region_keys(part, begin, end)
                shard = np.where(hot, packs.bucket_of(k0, shards) * U64(2) + U64(1), packs.bucket_of(marks, shards) * U64(2))
                yield a + row, first, (end - begin).astype(np.int32), k0, k1, shard.astype(np.int32), marks, least_run.astype(np.uint8)

        if len(known) and docs.num_rows:
            found = list(_hits(docs, repeated))
        out: dict[str, list] = {k: [] for k in ("shard", "g", *FORMS)}
        if found:
            ids, g = docs.column("__doc_id").to_numpy(), docs.column("__g")[0].as_py()
            body, offsets = buffers(whole(docs.column("text")))
            row, first, sizes, k0, k1, shard, marks, runs = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((k1, k0, shard))
            one = packs.runs_of(shard[order], k0[order], k1[order])
            owners = ids[row[order]]
            least, most = np.minimum.reduceat(owners, one), np.maximum.reduceat(owners, one)
            order = order[one]
            start, sizes, shard, k0, k1, marks, runs = (offsets[row] + first)[order], sizes[order], shard[order], k0[order], k1[order], marks[order], runs[order]
            cut = packs.runs_of(shard // 2).tolist()
            press = zstandard.ZstdCompressor(level=3)
            for i, j in zip(cut, [*cut[1:], len(shard)]):
                hot = i + int(np.searchsorted(shard[i:j] % 2, 1))
                out["shard"].append(int(shard[i]) // 2)
                out["g"].append(g)
                bytes_of, keys_of = body[ranges(start[i:hot], sizes[i:hot])], np.concatenate((k0[hot:j], k1[hot:j], marks[hot:j]))
                for (k, form), x in zip(FORMS.items(), (least[i:j], most[i:j], sizes[i:j], runs[i:hot], bytes_of, keys_of)):
                    out[k].append(press.compress(x.astype(form).tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(out.values(), (pa.int32(), pa.int32(), *[pa.binary()] * 6))], names=list(out))

    return run


def _parts(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of regions of about most bytes each."""
    yield from chunks(np.concatenate(([0], np.cumsum(sizes))), most)


def least_owners(body: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = LENGTH, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each region begins in the sorted text, a group for each place there that begins a window, and for each group
    of equal windows the least id of the regions that have it. The last two are in files."""
    # each region ends with a symbol that sorts before all bytes
    ends = np.cumsum(sizes.astype(np.int64) + 1)
    starts, n = ends - sizes - 1, int(ends[-1]) if len(ends) else 0
    # by place the region, until the suffix there is visited; then its group
    text, region, least = padded(n, np.uint8, length), scratch(n, np.uint32), Column(np.int64)
    done = 0
    for a, b in _parts(sizes):
        text[starts[a] : ends[b - 1]] = 1
        at = ranges(starts[a:b], sizes[a:b])
        text[at] = body[done : done + len(at)] + np.uint8(2)
        region[starts[a] : ends[b - 1]] = np.repeat(np.arange(a, b), sizes[a:b].astype(np.int64) + 1)
        done += len(at)
    open_least = None
    for places, common in suffixes(text, n, 250, cap=length, memory=memory):
        new = np.cumsum(common < length)
        own = region[places]
        window = places + length < ends[own]
        kind, owners = new[window], ids[own[window]]
        if len(kind):
            first = packs.runs_of(kind)
            lows = np.minimum.reduceat(owners, first)
            if open_least is not None:
                if kind[0] == 0:
                    lows[0] = min(lows[0], open_least)
                else:
                    least.append(np.array([open_least]))
            region[places[window]] = least.n + np.repeat(np.arange(len(first)), np.diff(np.append(first, len(kind))))
            least.append(lows[:-1])
            open_least = lows[-1]
        if open_least is not None and new[-1] > (kind[-1] if len(kind) else 0):
            least.append(np.array([open_least]))
            open_least = None
    if open_least is not None:
        least.append(np.array([open_least]))
    return starts, region, least.array()


SPANS = "__g int, keys0 binary, keys1 binary, counts binary, firsts binary, ends binary, owners binary, hot binary"
RUNS = {"keys0": U64, "keys1": U64, "counts": np.int32, "firsts": np.int32, "ends": np.int32, "owners": np.int64, "hot": U64}


def _unpack(column: pa.ChunkedArray, form) -> list[np.ndarray]:
    open_up = zstandard.ZstdDecompressor()
    return [np.frombuffer(open_up.decompress(x.as_buffer()), form) for x in column]


def _joined(parts: list[np.ndarray], form) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, form)


def may_meet(body: np.ndarray, sizes: np.ndarray, runs: np.ndarray, length: int = LENGTH, shingle: int = SHINGLE) -> np.ndarray:
    """Which of some regions that all differ may have a window in common with another. Equal windows have their least short
    run at one place, with half of the window's other bytes or more on one side of it: the run and that half are then in both
    regions, before the run or behind it."""
    half, shared = (length - shingle) // 2, np.zeros(len(sizes), bool)
    sides = [np.zeros(len(sizes), U64), np.zeros(len(sizes), U64)]
    runs, sizes, done = runs.astype(np.int64), sizes.astype(np.int64), 0
    for a, b in _parts(sizes):
        ends = np.cumsum(sizes[a:b])
        part, place = body[done : done + ends[-1]], ends - sizes[a:b] + runs[a:b]
        rolling, done = Rolling(BYTE_VALUES[0][part]), done + int(ends[-1])
        for side, first in zip(sides, (place - half, place)):
            first = np.clip(first, 0, len(part) - shingle - half)
            side[a:b] = mix(rolling.slices(first, first + shingle + half))
    for side, on in zip(sides, (runs >= half, runs + shingle + half <= sizes)):
        own = np.flatnonzero(on)
        _, kind, counts = np.unique(side[own], return_inverse=True, return_counts=True)
        shared[own] |= counts[kind] > 1
    return shared


def _gathered(source: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> Column:
    """The bytes of some regions of a text, one after the other."""
    body = Column(np.uint8)
    for a, b in _parts(sizes):
        body.append(source[ranges(at[a:b], sizes[a:b])])
    return body


def runs_of_owners(body: np.ndarray, sizes: np.ndarray, runs: np.ndarray, owner: np.ndarray, most: np.ndarray, length: int = LENGTH, memory: int = MEMORY) -> tuple[np.ndarray, ...]:
    """Region, first place, end and least id of the runs of windows, in each of some regions that all differ, that belong to
    a smaller id than most. Regions that have no window in common with another belong to their own least id."""
    meets = may_meet(body, sizes, runs, length)
    alone, of = np.flatnonzero(~meets & (owner < most)), np.flatnonzero(meets)
    found = [(alone, np.zeros(len(alone), np.int32), sizes[alone].astype(np.int32), owner[alone])]
    text = _gathered(body, (np.cumsum(sizes, dtype=np.int64) - sizes)[of], sizes[of])
    sizes, most = sizes[of], most[of]
    starts, group, least = least_owners(text.array(), sizes, owner[of], length, memory)
    windows = sizes.astype(np.int64) - length + 1
    for a, b in _parts(sizes):
        region, place = np.repeat(np.arange(a, b), windows[a:b]), ranges(np.zeros(b - a, np.int64), windows[a:b])
        below = least[group[starts[region] + place]]
        new = packs.runs_of(region, below)
        last = np.concatenate((new[1:], [len(place)])) - 1
        on = below[new] < most[region[new]]
        new, last = new[on], last[on]
        found.append((of[region[new]], place[new].astype(np.int32), (place[last] + length).astype(np.int32), below[new]))
    region, *rest = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(region, kind="stable")
    return region[order], *(x[order] for x in rest)


def match_windows(least: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """For single windows the least id of those with equal keys."""
    order = np.lexsort((k1, k0))
    one = packs.runs_of(k0[order], k1[order])
    owner = np.empty(len(order), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(least[order], one), np.diff(np.concatenate((one, [len(order)]))))
    return owner


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a shard's regions and matches its windows of hot fingerprints; the runs that documents may lose go back by
    group of documents, with the hot fingerprints that they are of."""
    texts, held, hot = Column(np.uint8), [], []
    for batch in batches:
        columns = {k: _unpack(batch.column(k), form) for k, form in FORMS.items()}
        for g, least, most, sizes, runs, body, keys in zip(batch.column("g").to_pylist(), *columns.values()):
            keys = keys.reshape(3, -1)
            m = len(sizes) - keys.shape[1]
            ends = np.cumsum(sizes[:m], dtype=np.int64)
            held.append((np.full(m, g, np.int32), least[:m], most[:m], sizes[:m], runs, texts.n + ends - sizes[:m], *region_keys(body, ends - sizes[:m], ends)))
            hot.append((np.full(len(sizes) - m, g, np.int32), least[m:], most[m:], *keys))
            texts.append(body)
    g, least, most, sizes, least_runs, at, k0, k1 = (np.concatenate(x) for x in zip(*held))
    del held
    # regions alike are sorted once, under their least id, in the order in which they came
    order = np.lexsort((k1, k0))
    one = packs.runs_of(k0[order], k1[order])
    kind, kept = np.empty(len(g), np.int64), order[one]
    rank = np.argsort(kept)
    place_of = np.empty(len(kept), np.int64)
    place_of[rank] = np.arange(len(kept))
    kind[order] = np.repeat(place_of, np.diff(np.append(one, len(g))))
    owner, top = (np.minimum.reduceat(least[order], one)[rank], np.maximum.reduceat(most[order], one)[rank]) if len(one) else (least, most)
    kept = kept[rank]
    body = _gathered(texts.array(), at[kept], sizes[kept])
    texts.close()
    region, first, end, below = runs_of_owners(body.array(), sizes[kept], least_runs[kept], owner, top)
    edge = np.searchsorted(region, np.arange(len(kept) + 1))
    hot_g, hot_least, hot_most, *hot_keys = (np.concatenate(x) for x in zip(*hot))
    hot_owner = match_windows(hot_least, *hot_keys[:2]) if len(hot_g) else hot_least
    by_g, hot_by_g = np.argsort(g, kind="stable"), np.argsort(hot_g, kind="stable")
    press = zstandard.ZstdCompressor(level=3)
    for group in np.union1d(g, hot_g).tolist():
        own = by_g[slice(*np.searchsorted(g[by_g], (group, group + 1)))]
        counts = edge[kind[own] + 1] - edge[kind[own]]
        runs, sent = ranges(edge[kind[own]], counts), np.repeat(own, counts)
        on = below[runs] < most[sent]
        runs, sent = runs[on], sent[on]
        begin = packs.runs_of(sent)
        regions, counts = sent[begin], np.diff(np.append(begin, len(sent)))
        own = hot_by_g[slice(*np.searchsorted(hot_g[hot_by_g], (group, group + 1)))]
        own = own[hot_owner[own] < hot_most[own]]
        m = len(own)
        parts = (
            np.concatenate((k0[regions], hot_keys[0][own])), np.concatenate((k1[regions], hot_keys[1][own])), np.concatenate((counts, np.ones(m))),
            np.concatenate((first[runs], np.zeros(m))), np.concatenate((end[runs], np.full(m, LENGTH))), np.concatenate((below[runs], hot_owner[own])), np.unique(hot_keys[2][own]),
        )
        if len(parts[0]):
            packed = [pa.array([press.compress(x.astype(form).tobytes())], pa.binary()) for x, form in zip(parts, RUNS.values())]
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *packed], names=["__g", *RUNS])
    release_memory()


def _gone(docs: pa.Table, spans: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of a group's texts go, and where each row's begin: every row finds the regions of its own text among
    those that lose bytes, and takes the runs of a smaller id than its own."""
    _, offsets = buffers(whole(docs.column("text")))
    if not docs.num_rows or not spans.num_rows:
        return np.zeros(int(offsets[-1]), bool), offsets
    keys0, keys1, counts, firsts, ends, owners, hot_marks = (_joined(_unpack(spans.column(k), form), form) for k, form in RUNS.items())
    hot_marks = np.unique(hot_marks)
    run_at = np.cumsum(counts) - counts
    order = np.lexsort((keys1, keys0))
    keys0, keys1, counts, run_at = keys0[order], keys1[order], counts[order], run_at[order]
    ids = docs.column("__doc_id").to_numpy()

    def mine(a, part, row, first, begin, end, marks, least_run):
        if len(hot_marks):
            hot = np.isin(packs.sent(marks), hot_marks)
            if hot.any():
                _, row, first, begin, end, *_ = single_windows(hot, row, first, begin, end, marks, least_run)
        k0, k1 = region_keys(part, begin, end)
        at = np.searchsorted(keys0, k0)
        while True:
            near = np.minimum(at, len(keys0) - 1)
            same = (at < len(keys0)) & (keys0[near] == k0)
            other = same & (keys1[near] != k1)
            if not other.any():
                break
            at = at + other
        at, row, first = at[same], a + row[same], first[same]
        runs = ranges(run_at[at], counts[at])
        row, first = np.repeat(row, counts[at]), np.repeat(first, counts[at])
        on = owners[runs] < ids[row]
        begin = (offsets[row] + first)[on]
        yield begin + firsts[runs[on]], begin + ends[runs[on]]

    found = list(_hits(docs, mine))
    begin, end = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return covered(int(offsets[-1]), begin, end), offsets


def _group(docs: DataFrame, n: int) -> DataFrame:
    """The columns of docs by place (c0, c1 and so on, but text), with id and one of n groups."""
    own = [F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(*own, key_columns()[0].alias("__doc_id"))
    return keyed.withColumn("__g", F.pmod(F.xxhash64("__doc_id", "text"), F.lit(n)).cast("int"))


def _with_spans(docs: DataFrame, then, schema, hot: int = HOT) -> DataFrame:
    """Applies then(docs, spans) to each group of docs and the runs that it may lose. The documents are dealt out by group
    once; both steps that need a group's texts read that same exchange."""
    n, shards = groups_for(docs, GROUP_BYTES, SHARD_BYTES)
    bounded_batches(docs.sparkSession)
    grouped = _group(docs, n)
    sent = grouped.select("__g", "text").mapInArrow(_send(n), packs.SCHEMA)
    wanted = packs.repeated_by_group(sent).withColumnRenamed("g", "__g")
    regions = grouped.groupBy("__g").cogroup(wanted.groupBy("__g")).applyInArrow(_regions(shards, hot), REGIONS)
    spans = regions.groupBy("shard").applyInArrow(_sort_shard, SPANS)
    return grouped.groupBy("__g").cogroup(spans.groupBy("__g")).applyInArrow(then, schema)


def dedup(docs: DataFrame, *, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every row."""

    @released
    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        body = buffers(whole(table.column("text")))[0]
        gone, offsets = _gone(table, spans)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edges = offsets[:-1][offsets[:-1] < len(gone)]
        begins[edges] = gone[edges]
        removed, runs = (np.diff(np.concatenate(([0], np.cumsum(x)))[offsets]) for x in (gone, begins))
        kept = [body[a:b][~gone[a:b]].tobytes() if lost else body[a:b].tobytes() for a, b, lost in zip(offsets[:-1], offsets[1:], removed)]
        return pa.table({"doc_id": table.column("c0").cast(pa.int64()), "n_bytes": np.diff(offsets), "n_removed": removed.astype(np.int64), "n_spans": runs.astype(np.int64), "kept": pa.array(kept, pa.binary())})

    return _with_spans(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", hot)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text, all other columns as they are; what is left of a character cut in
    two goes too. A null text stays null. Documents stay even if nothing of their text is left."""
    columns = docs.columns

    @released
    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        gone, offsets = _gone(table, spans)
        lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets])
        for row in np.flatnonzero(lost):
            own = gone[offsets[row] : offsets[row + 1]]
            texts[row] = np.frombuffer(texts[row].encode(), np.uint8)[~own].tobytes().decode("utf-8", "ignore")
        out = table.select(range(len(columns))).rename_columns(columns)
        return out.set_column(columns.index("text"), "text", pa.array(texts, pa.string()))

    return _with_spans(docs, run, docs.schema)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
