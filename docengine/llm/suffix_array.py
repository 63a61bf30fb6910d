"""Suffixes in order, with the common prefix of each two neighbours, by external induced sorting.

A level of the recursion has a text of symbols. The suffixes at local minima are sorted first: the pieces from one minimum
to the next are sorted and named, and unless all names differ, the text of names is the next level. Two sweeps then induce
the order of all suffixes from those: a sweep visits suffixes in order and puts the suffix one place before each into a
priority queue, as a tuple of symbol, place and common prefix with the tuple that came before it under that symbol. That
prefix is the symbol's own length and the least common prefix of all suffixes visited in between. It is read from the text
only where two symbols, or the two kinds of suffixes of one symbol, meet, and for suffixes that come into the queue and out
of it within one part of a sweep.

Memory is bounded by a parameter, whatever the text's length. Texts, pieces, queue tuples and sorted suffixes are in
files: pieces are distributed over files until a part fits, tuples wait in blocks by range of symbols and are written out
beyond the bound, and texts are mapped. The files are unnamed ones in the task's own temporary folder, like Spark's spill
files: only the task that sorts reads them, they end with it, and a task that is run again makes its own.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
#: Bytes that the tuples and blocks of one sort may take in memory, about.
MEMORY = 48 << 20
#: Values into which a part of the pieces that doesn't fit is distributed.
SPLITTERS = 32
#: Levels of the recursion; the minima of the last are sorted by their first cap symbols of the text itself.
LEVELS = 2
#: Parts of about equal size in which a sweep visits the suffixes; a symbol is not divided.
PARTS = 64

#: Rows of an array of tuples.
KEY, PLACE, COMMON = range(3)
PIECE = np.dtype([("index", np.uint32), ("place", np.uint32), ("size", np.uint8)])


def scratch(n: int, dtype) -> np.ndarray:
    """An array of zeros in an unnamed file."""
    if not n:
        return np.zeros(0, dtype)
    with tempfile.TemporaryFile(prefix="docengine-sort-") as file:
        file.truncate(n * np.dtype(dtype).itemsize)
        return np.asarray(np.memmap(file, dtype, "r+", shape=(n,)))


def tuples(n: int) -> np.ndarray:
    return np.zeros((3, n), np.uint32)


class Column:
    """An array in an unnamed file that is written from front to back, then mapped."""

    def __init__(self, dtype):
        self.dtype, self.n = np.dtype(dtype), 0
        self.file = tempfile.TemporaryFile(prefix="docengine-sort-")

    def append(self, x: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(x, self.dtype).view(np.uint8).data)
        self.n += len(x)

    def array(self) -> np.ndarray:
        self.file.flush()
        return np.asarray(np.memmap(self.file, self.dtype, "r", shape=(self.n,))) if self.n else np.zeros(0, self.dtype)

    def close(self) -> None:
        self.file.close()


@dataclass
class Level:
    """text: symbols from 1 on, with zeros behind its n; at: the first level's place of each, and its length; weight: by
    symbol, how many of the first level's symbols it takes, cap at most; one for the first level."""

    text: np.ndarray
    n: int
    kinds: int
    cap: int
    depth: int = 0
    at: np.ndarray | None = None
    weight: np.ndarray | None = None
    first: Level | None = None

    def __post_init__(self) -> None:
        self.first = self.first or self
        self.each = 8 // self.text.itemsize
        self.words = np.ndarray((len(self.text) - self.each + 1,), ">u8" if self.each == 8 else "<u8", self.text, 0, (self.text.itemsize,))

    def word(self, places: np.ndarray) -> np.ndarray:
        """The symbols from a place on as one number, the first the highest."""
        w = self.words[places].astype(U64)
        return w if self.each == 8 else (w << U64(32)) | (w >> U64(32))

    def places(self, x: np.ndarray) -> np.ndarray:
        return x if self.at is None else self.at[x]

    def weights(self, symbols: np.ndarray) -> np.ndarray | int:
        return 1 if self.weight is None else self.weight[symbols].astype(np.int64)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The common prefix of suffixes of the first level, cap at most, read from its text."""
        out, left = np.full(len(x), self.cap, np.int64), np.arange(len(x))
        for d in range(0, self.cap, self.each):
            differ = self.word(x[left] + d) ^ self.word(y[left] + d)
            some = differ != 0
            if some.any():
                symbols = differ[some].astype(">u8").view(f">u{8 // self.each}").reshape(-1, self.each)
                out[left[some]] = d + (symbols != 0).argmax(1)
                left = left[~some]
            if not len(left):
                break
        return np.minimum(out, self.cap)


def padded(n: int, dtype, cap: int) -> np.ndarray:
    """Room for a text of n symbols with zeros behind it."""
    return scratch(n + cap + 16, dtype)


def kinds_of(level: Level, block: int) -> tuple[Column, np.ndarray, np.ndarray]:
    """The places of local minima, falling; how many suffixes of each symbol are greater than the next and smaller."""
    minima, counts = Column(np.uint32), (scratch(level.kinds + 1, np.int64), scratch(level.kinds + 1, np.int64))
    end, after = level.n, False
    while end > 0:
        begin = max(0, end - block)
        first = max(0, begin - 1)
        x = level.text[first : min(end + 1, level.n)]
        smaller = np.full(end - first, after)
        differ = np.flatnonzero(x[:-1] != x[1:])
        if len(differ):
            upto = int(differ[-1]) + 1
            smaller[:upto] = np.repeat(x[differ] < x[differ + 1], np.diff(np.concatenate(([-1], differ))))
        at = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1 + first
        minima.append(at[at >= begin][::-1])
        own = smaller[begin - first :]
        for count, on in zip(counts, (~own, own)):
            symbols, n = np.unique(x[begin - first : end - first][on], return_counts=True)
            count[symbols] += n
        end, after = begin, bool(own[0])
    return minima, *counts


def piece_word(level: Level, pieces: np.ndarray, d: int) -> np.ndarray:
    """The d-th word of each piece; behind a piece's end are the greatest symbols, as a piece sorts after those that it
    begins."""
    w = level.word(pieces["place"].astype(np.int64) + d * level.each)
    rest = np.clip(pieces["size"].astype(np.int64) - d * level.each, 0, level.each)
    bits = (64 // level.each * (level.each - rest)).astype(U64)
    return np.where(rest == 0, ~U64(0), w | ((U64(1) << np.minimum(bits, U64(63))) - U64(1)))


def _sort_in_memory(level: Level, pieces: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in order, and which differ from the one before: ties are sorted by word after word."""
    w = piece_word(level, pieces, d)
    order = np.argsort(w)
    pieces, w = pieces[order], w[order]
    new = np.ones(len(pieces), bool)
    new[1:] = w[1:] != w[:-1]
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(tied):
        d += 1
        begins = np.flatnonzero(new[tied])
        goes_on = np.maximum.reduceat(pieces["size"][tied], begins) > d * level.each
        tied = tied[np.repeat(goes_on, np.diff(np.append(begins, len(tied))))]
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        w = piece_word(level, pieces[tied], d)
        order = np.lexsort((w, group))
        pieces[tied], w = pieces[tied[order]], w[order]
        first = np.ones(len(tied), bool)
        first[1:] = (group[1:] != group[:-1]) | (w[1:] != w[:-1])
        new[tied] = first
        tied = tied[~first | np.append(~first[1:], False)]
    return pieces, new


def sorted_pieces(level: Level, column: Column, most: int, d: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pieces in order, with which differ from the one before. A part of more than most pieces is distributed
    over files by its d-th word; pieces that are alike to their end need no sorting."""
    pieces = column.array()
    if len(pieces) <= most or pieces["size"].max() <= d * level.each:
        for a in range(0, len(pieces), most):
            part = np.array(pieces[a : a + most])
            yield _sort_in_memory(level, part, d) if len(pieces) <= most else (part, np.arange(a, a + len(part)) == 0)
        column.close()
        return
    cuts = np.unique(piece_word(level, np.array(pieces[:: max(1, len(pieces) // (SPLITTERS * 16))]), d))
    cuts = np.unique(cuts[np.linspace(0, len(cuts) - 1, SPLITTERS).astype(int)])
    parts = [Column(PIECE) for _ in range(2 * len(cuts) + 1)]
    for a in range(0, len(pieces), most):
        block = np.array(pieces[a : a + most])
        w = piece_word(level, block, d)
        at = np.searchsorted(cuts, w)
        part = 2 * at + (cuts[np.minimum(at, len(cuts) - 1)] == w)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(len(parts) + 1))
        for p, i, j in zip(parts, edges, edges[1:]):
            if j > i:
                p.append(block[order[i:j]])
    column.close()
    for k, part in enumerate(parts):
        yield from sorted_pieces(level, part, most, d + k % 2) if part.n else ()
        part.close()


class Queue:
    """Tuples by group of keys, each group's in the order they came; beyond the memory bound they are in a file."""

    def __init__(self, edges: np.ndarray, memory: int):
        self.edges, self.memory, self.held, self.spilled = edges, memory, 0, 0
        self.blocks: list[list] = [[] for _ in range(len(edges) - 1)]
        self.file = None

    def push(self, sent: np.ndarray) -> None:
        """Tuples sorted by key."""
        group = np.searchsorted(self.edges, sent[KEY], "right") - 1
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for g, a, b in zip(group[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(group)]):
            self.blocks[g].append(sent[:, a:b])
        self.held += sent.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="docengine-queue-")
        self.file.seek(0, 2)
        for blocks in self.blocks:
            own = [b for b in blocks if isinstance(b, np.ndarray)]
            if own:
                x = np.concatenate(own, axis=1)
                blocks[:] = [*(b for b in blocks if not isinstance(b, np.ndarray)), (self.file.tell(), x.shape[1])]
                self.file.write(x.data)
                self.spilled += x.shape[1]
        self.held = 0

    def pop(self, group: int, most: int) -> Iterator[np.ndarray]:
        """A group's tuples by key, and those of a key in the order they came; a single key's in blocks of about most."""
        single, parts, n = self.edges[group + 1] - self.edges[group] == 1, [], 0
        for b in self.blocks[group]:
            if isinstance(b, tuple):
                self.file.seek(b[0])
                b = np.frombuffer(self.file.read(b[1] * 12), np.uint32).reshape(3, -1)
            else:
                self.held -= b.nbytes
            if single and n + b.shape[1] > most and n:
                yield np.concatenate(parts, axis=1)
                parts, n = [], 0
            parts.append(b)
            n += b.shape[1]
        self.blocks[group] = []
        x = np.concatenate(parts, axis=1) if parts else tuples(0)
        yield x if single else x[:, np.argsort(x[KEY], kind="stable")]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Source:
    """Suffixes that are sorted already, with common prefixes, read in blocks; backward: from an array in falling order."""

    def __init__(self, places: np.ndarray, common: np.ndarray, text: np.ndarray, key, block: int, backward: bool):
        self.places, self.common, self.text, self.key, self.block, self.backward = places, common, text, key, block, backward
        self.next, self.held = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def _load(self) -> None:
        a, b, n = self.next, min(self.next + self.block, len(self.places)), len(self.places)
        if self.backward:
            places = self.places[n - b : n - a][::-1].astype(np.int64)
            common = np.zeros(b - a, np.uint8)
            common[(a == 0) :] = self.common[n - b + 1 : n - a + (a > 0)][::-1]
        else:
            places, common = self.places[a:b].astype(np.int64), self.common[a:b]
        self.next = b
        self.held = tuple(np.concatenate(x) for x in zip(self.held, (places, self.key(self.text[places]), common)))

    def peek(self, limit: int) -> tuple[tuple[np.ndarray, ...], bool]:
        """Suffixes with keys below limit, about two blocks at most, and whether there may be more of them."""
        while self.next < len(self.places) and len(self.held[0]) < self.block and not (len(self.held[1]) and self.held[1][-1] >= limit):
            self._load()
        n = int(np.searchsorted(self.held[1], limit))
        return tuple(x[:n] for x in self.held), n == len(self.held[1]) and self.next < len(self.places)

    def advance(self, n: int) -> None:
        self.held = tuple(x[n:] for x in self.held)


def least_between(values: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The least of values[after + 1 .. to] for each pair."""
    length = to - after
    step = np.frexp(length.astype(float))[1] - 1
    rows = [values]
    for k in range(int(step.max())):
        rows.append(np.minimum(rows[-1][: -(1 << k)], rows[-1][1 << k :]))
    if len(rows) == 1:
        return values[to]
    table = np.zeros((len(rows), len(values)), values.dtype)
    for row, r in zip(table, rows):
        row[: len(r)] = r
    return np.minimum(table[step, after + 1], table[step, to - (1 << step) + 1])


class Sweep:
    """Visits all suffixes of one kind, and the given sorted ones of the other kind between them, in rising or in falling
    order, and yields blocks of places, common prefixes with the suffix visited before, and which are of the own kind."""

    def __init__(self, level: Level, rising: bool, source: Source, counts: np.ndarray, memory: int):
        self.level, self.rising, self.source = level, rising, source
        keys = np.asarray(counts[1:] if rising else counts[:0:-1])
        total = np.cumsum(keys)
        n = int(total[-1]) if len(total) else 0
        self.most = max(16, memory // 192)
        group = max(1, min(self.most, n // PARTS + 1))
        cuts = np.unique(np.searchsorted(total, np.arange(group, n, group)) + 1)
        self.edges = np.concatenate(([0], cuts[(cuts > 0) & (cuts < level.kinds)], [level.kinds])).astype(np.int64)
        self.queue = Queue(self.edges, memory // 2)
        #: By key the number of the last visit that put a tuple there, plus one.
        self.last = scratch(level.kinds, np.int64)
        self.visits = 0
        #: Falling back from now, where the least common prefix of all visits since is reached: places and values, rising.
        self.minimum_at, self.minimum = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.before: tuple[int, int] | None = None

    def key(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64)
        return s - 1 if self.rising else self.level.kinds - s

    def put(self, place: int) -> None:
        """Begins a rising sweep: the last suffix, which comes from the empty one."""
        key = self.key(self.level.text[place : place + 1])
        self.queue.push(np.array([[key[0]], [place], [0]], np.uint32))
        self.last[key] = 1
        self.visits, self.minimum_at, self.minimum = 1, np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _ahead(self, places: np.ndarray, keys: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """The key of the suffix before each, and whether that is of the own kind."""
        ahead = self.key(self.level.text[places - (places > 0)])
        return ahead, (places > 0) & ((ahead >= keys) if own else (ahead > keys))

    def _visit(self, places: np.ndarray, kind: np.ndarray, common: np.ndarray, unknown: np.ndarray, ahead: np.ndarray, takes: np.ndarray) -> np.ndarray:
        """Fills in the missing common prefixes of a block in order; returns the tuples of the suffixes before them."""
        level, meets = self.level, unknown.copy()
        meets[1:] |= kind[1:] != kind[:-1]
        meets[0] |= self.before is None or kind[0] != self.before[1]
        at = np.flatnonzero(meets)
        if len(at):
            earlier = np.concatenate(([places[0] if self.before is None else self.before[0]], places[:-1]))[at]
            common[at] = level.first.common(level.places(earlier).astype(np.int64), level.places(places[at]).astype(np.int64))
            if self.before is None:
                common[0] = 0
        self.before = (int(places[-1]), int(kind[-1]))
        on = np.flatnonzero(takes)
        out = tuples(len(on))
        if len(on):
            to = ahead[on]
            order = np.argsort(to.astype(np.uint8) if level.kinds <= 256 else to, kind="stable")
            on, to = on[order], to[order]
            first = np.ones(len(to), bool)
            first[1:] = to[1:] != to[:-1]
            least = np.empty(len(on), np.int64)
            if not first.all():
                rest = np.flatnonzero(~first)
                least[rest] = least_between(common.astype(np.uint8), on[rest - 1], on[rest])
            since = np.asarray(self.last[to[first]])
            at = np.searchsorted(self.minimum_at, since)
            least[first] = np.minimum(np.append(self.minimum, level.cap)[at], np.minimum.accumulate(common)[on[first]])
            places_before = places[on] - 1
            out[KEY], out[PLACE] = to, places_before
            out[COMMON] = np.minimum(least + level.weights(level.text[places_before]), level.cap)
            ends = np.append(first[1:], True)
            self.last[to[ends]] = self.visits + on[ends] + 1
        # the least values from each place to now that are less than all later ones
        low = np.minimum.accumulate(common[::-1])[::-1]
        at = np.flatnonzero(np.append(low[1:] > low[:-1], True))
        stays = self.minimum < low[0]
        self.minimum_at = np.concatenate((self.minimum_at[stays], self.visits + at))
        self.minimum = np.concatenate((self.minimum[stays], low[at]))
        self.visits += len(places)
        self.common = common.astype(np.uint8)
        return out

    def _parts(self, group: int, high: int) -> Iterator[tuple[np.ndarray, int]]:
        """A group's tuples, each part with a limit: what is below it comes in that part or an earlier one."""
        before = None
        for part in self.queue.pop(group, self.most):
            if before is not None:
                yield before, high - 1
            before = part
        yield before, high

    def _closure(self, keys: np.ndarray, places: np.ndarray, n_own: int, bound: int) -> tuple[np.ndarray, ...]:
        """Adds what a part's suffixes put below its own bound, and those in turn, and gives the order of all. A suffix
        comes in its key's order of those that put it there; the first n_own are of the own kind."""
        ahead, takes = (np.concatenate(x) for x in zip(self._ahead(places[:n_own], keys[:n_own], True), self._ahead(places[n_own:], keys[n_own:], False)))
        n, size = len(keys), len(keys)
        parts = [(places, keys * 2 + (np.arange(n) >= n_own), ahead, takes, np.full(n, -1))]
        while True:
            places, _, ahead, takes, _ = parts[-1]
            inside = np.flatnonzero(takes & (ahead < bound))
            if not len(inside):
                break
            new_places, new_keys = places[inside] - 1, ahead[inside]
            parts.append((new_places, new_keys * 2, *self._ahead(new_places, new_keys, True), size - len(places) + inside))
            size += len(inside)
        rounds = len(parts) - 1
        places, kinds, ahead, takes, comes_from = (np.concatenate(x) for x in zip(*parts)) if rounds else parts[0]
        if n_own == len(kinds):
            return places, kinds, ahead, takes, np.arange(n), n
        if rounds:
            # of the added ones those of one key follow the suffixes that put them there
            rank = np.empty(size, np.int64)
            rank[np.argsort(kinds[:n], kind="stable")] = np.arange(n)
            rank[n:] = 0
            put_by, put_at = comes_from[n:], kinds[comes_from[n:]] * (2 * size) + np.where(comes_from[n:] < n, 0, size)
            for _ in range(rounds):
                added = np.lexsort((put_at + rank[put_by], kinds[n:]))
                rank[n + added] = np.arange(size - n)
            added = np.concatenate((np.arange(n), n + added))
            order = added[np.argsort(kinds[added], kind="stable")]
        else:
            order = np.argsort(kinds, kind="stable")
        return places[order], kinds[order], ahead[order], takes[order], order, n

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for g, high in enumerate(self.edges[1:].tolist()):
            later = tuples(0)
            for active, limit in self._parts(g, high):
                more = True
                while more:
                    if later.shape[1]:
                        due = later[KEY] < limit
                        active, later = np.concatenate((active, later[:, due]), axis=1), later[:, ~due]
                        active = active[:, np.argsort(active[KEY], kind="stable")]
                    (o_places, o_keys, o_common), more = self.source.peek(limit)
                    bound = int(o_keys[-1]) + 1 if more else limit
                    now = active[:, : np.searchsorted(active[KEY], bound)] if more else active
                    active, n_own = active[:, now.shape[1] :], now.shape[1]
                    if not n_own and not len(o_places):
                        continue
                    keys, places = (np.concatenate((x.astype(np.int64), o)) for x, o in ((now[KEY], o_keys), (now[PLACE], o_places)))
                    places, kinds, ahead, takes, order, n = self._closure(keys, places, n_own, bound)
                    common = np.zeros(len(order), np.int64)
                    known = order < n
                    common[known] = np.concatenate((now[COMMON], o_common))[order[known]]
                    new = self._visit(places, kinds, common, ~known, ahead, takes)
                    yield places, self.common, kinds % 2 == 0
                    self.source.advance(len(o_places))
                    first, inside = np.searchsorted(new[KEY], (bound, high)).tolist()
                    if inside < new.shape[1]:
                        self.queue.push(new[:, inside:])
                    if first < inside:
                        later = np.concatenate((later, new[:, first:inside]), axis=1)
        self.queue.close()


def _read_common(level: Level, places: np.ndarray, block: int) -> np.ndarray:
    """The common prefix of each of some suffixes with the one before, read from the text."""
    common = Column(np.uint8)
    for a in range(0, len(places), block):
        at = level.places(places[max(0, a - 1) : a + block].astype(np.int64)).astype(np.int64)
        at = np.concatenate((at[:1], at)) if a == 0 else at
        common.append(level.first.common(at[:-1], at[1:]))
    return common.array()


def _minima_in_order(level: Level, falling: Column, memory: int, levels: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The places of local minima in order with common prefixes, and whether the arrays are in falling order."""
    block = max(64, memory // 64)
    minima, n = falling.array()[::-1], falling.n
    pieces, most = Column(PIECE), level.cap // (1 << level.depth) + 2
    for a in range(0, n, block):
        at = np.append(minima[a : a + block + 1], level.n if a + block >= n else 0).astype(np.int64)[: min(block, n - a) + 1]
        part = np.zeros(len(at) - 1, PIECE)
        part["index"], part["place"], part["size"] = np.arange(a, a + len(part)), at[:-1], np.minimum(np.diff(at) + 1, most)
        pieces.append(part)
    first = level.first
    if level.depth + 1 >= levels:
        # what is alike in cap symbols of the first level need not be told apart, so no names are needed
        whole = pieces.array()
        long, order = Column(PIECE), Column(np.uint32)
        for a in range(0, n, block):
            part = np.array(whole[a : a + block])
            part["place"], part["size"] = level.places(part["place"]), level.cap
            long.append(part)
        pieces.close()
        for part, _ in sorted_pieces(first, long, block):
            order.append(minima[part["index"]])
        return order.array(), _read_common(level, order.array(), block), False
    names, weight, order, kinds = padded(n, np.uint32, level.cap), Column(np.uint8), Column(np.uint32), 0
    weight.append(np.zeros(1))
    for part, new in sorted_pieces(level, pieces, block):
        own = kinds + np.cumsum(new)
        names[part["index"]] = own
        begin = part["place"][new].astype(np.int64)
        length = level.places(np.minimum(begin + part["size"][new] - 1, level.n)).astype(np.int64) - level.places(begin).astype(np.int64)
        weight.append(np.where(part["size"][new] == most, level.cap, np.minimum(length, level.cap)))
        order.append(part["place"])
        kinds = int(own[-1])
    if kinds == n or (2 << level.depth) >= level.cap:
        return order.array(), _read_common(level, order.array(), block), False
    common = Column(np.uint8)
    at = scratch(n + 1, np.uint32)
    for a in range(0, n, block):
        at[a : min(a + block, n)] = level.places(minima[a : a + block])
    at[n] = first.n
    below = Level(names, n, kinds, level.cap, level.depth + 1, at, weight.array(), first)
    places = Column(np.uint32)
    for index, shared in _suffixes(below, memory, levels):
        places.append(minima[index])
        common.append(shared)
    return places.array(), common.array(), True


def _suffixes(level: Level, memory: int, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    block = max(64, memory // 64)
    minima, greater, smaller = kinds_of(level, block)
    places, common, falling = _minima_in_order(level, minima, memory, levels)
    minima.close()
    rising = Sweep(level, True, None, greater, memory)
    rising.source = Source(places, common, level.text, rising.key, block, falling)
    rising.put(level.n - 1)
    greater_places, greater_common = Column(np.uint32), Column(np.uint8)
    for at, shared, own in rising.run():
        greater_places.append(at[own])
        greater_common.append(shared[own])
    down = Sweep(level, False, None, smaller, memory)
    down.source = Source(greater_places.array(), greater_common.array(), level.text, down.key, block, True)
    for at, shared, _ in down.run():
        yield at, shared


def suffixes(text: np.ndarray, n: int, kinds: int, *, cap: int, memory: int = MEMORY, levels: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All n suffixes of a padded text of bytes or 32-bit symbols from 1 to kinds, in falling order: blocks of places and
    of common prefixes, cap at most, with the suffix before. Suffixes alike in cap symbols may come in any order."""
    if not 0 < cap <= 250 or n >= 2**32:
        raise ValueError("the common prefix is counted up to 250, and a text has fewer than 2**32 symbols")
    if n:
        yield from _suffixes(Level(text, n, kinds, cap), memory, levels)
