"""Byte-level BPE by dynamic programming over prefixes: for every prefix of a piece of text the one token that ends its
encoding is found among the tokens that are suffixes of the prefix, which an automaton lists; a token fits if it and the
last token of what precedes it stay apart when merged together. Back-pointers then give the ids, the same as from merging.
The table of a prefix serves all pieces that begin with it: new pieces of some texts are encoded in order, each from where
it departs from the one before.

Pieces are split off by the tokenizer file's pattern, and special tokens' strings are cut out first, as the tokenizers
library does. Defined cases: a null text is empty and has no tokens. Repeated rows are encoded alike, extra columns are
ignored, an empty table gives no rows. Long texts are encoded whole, in time proportional to their length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, released

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters alone.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters of the texts whose new pieces are encoded together, about.
TOGETHER = 2 << 20
#: Pieces of text that a worker remembers, about; it forgets the older half beyond that. Longer ones than SHORT are not kept.
REMEMBERED, SHORT = 200_000, 64
#: Steps of the automaton that a worker remembers, besides those along a token.
STEPS = 500_000
#: Pairs of tokens whose fit a worker remembers; it forgets them all beyond that.
PAIRS = 200_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in the tokenizer file: printable bytes stand for themselves, the others follow
    from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.ids = {b: i for i, b in self.bytes_of.items()}
        #: For each pair of ids that merges, the merge's place; for each merged id, its place and parts.
        self.place: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.place.setdefault((left, right), n)
            if whole not in self.parts:
                self.parts[whole], self.made_at[whole] = (left, right), n
        self.special_text = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pieces = regex.compile(PATTERN)
        #: By left id and right id, in one number, whether the two stay apart.
        self.apart: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @cached_property
    def automaton(self) -> tuple[dict[int, int], list[tuple[tuple[int, int], ...]], list[int]]:
        """By state and byte, in one number, the state behind it; by state the length and id of each token that ends a text
        there, the longest first, and the state of the longest shorter suffix. State 0 is the empty text's."""
        steps, token_at, made = {}, [-1], []
        for token, i in self.ids.items():
            state = 0
            for depth, byte in enumerate(token):
                key = state << 8 | byte
                after = steps.get(key)
                if after is None:
                    after = steps[key] = len(token_at)
                    token_at.append(-1)
                    made.append((depth, key, after))
                state = after
            token_at[state] = i
        shorter, ends = [0] * len(token_at), [()] * len(token_at)
        for depth, key, state in sorted(made):
            byte, before = key & 255, key >> 8
            if depth:
                at = shorter[before]
                while at and at << 8 | byte not in steps:
                    at = shorter[at]
                shorter[state] = steps.get(at << 8 | byte, 0)
            own = ((depth + 1, token_at[state]),) if token_at[state] >= 0 else ()
            ends[state] = own + ends[shorter[state]]
        return steps, ends, shorter

    def step(self, state: int, byte: int) -> int:
        """The state behind a byte that goes along no token from a state on."""
        steps, _, shorter = self.automaton
        key = state << 8 | byte
        while (after := steps.get(state << 8 | byte)) is None and state:
            state = shorter[state]
        if len(steps) < len(shorter) + STEPS:
            steps[key] = after or 0
        return after or 0

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the text of two neighbouring tokens is encoded as just these two: no merge across their border may
        come before the merges that built the parts next to it. Undoes the latest merge beside the border, again and
        again, and looks up the pair at the border each time."""
        key = left << 24 | right
        at, parts, place, none = self.made_at, self.parts, self.place, -1
        until = len(self.place) + 1
        fits = True
        while True:
            across = place.get((left, right))
            if across is not None and across < until:
                fits = False
                break
            l_at, r_at = at.get(left, none), at.get(right, none)
            if l_at == none and r_at == none:
                break
            if l_at > r_at:
                until, left = l_at, parts[left][1]
            else:
                # of equal merges the left one goes first, so one across the border beats the right token's own
                until, right = r_at + 1, parts[right][0]
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[key] = fits
        return fits

    def encode_sorted(self, pieces: Iterable[str]) -> Iterator[tuple[int, ...]]:
        """The ids of pieces, by the table of last tokens over their prefixes. What a piece begins with in common with the
        one before it is in the table already."""
        steps, ends, _ = self.automaton
        step, apart, lengths = steps.get, self.apart.get, self.lengths
        earlier, last, states = b"", [], []
        for piece in pieces:
            data, same = piece.encode(), 0
            for a, b in zip(data, earlier):
                if a != b:
                    break
                same += 1
            del last[same:], states[same:]
            earlier, state = data, states[-1] if same else 0
            for at in range(same, len(data)):
                after = step(state << 8 | data[at])
                state = self.step(state, data[at]) if after is None else after
                states.append(state)
                fitting = -1
                for length, token in ends[state]:
                    if length > at:
                        fitting = token
                        break
                    before = last[at - length]
                    if before >= 0:
                        fits = apart(before << 24 | token)
                        if fits or (fits is None and self.stay_apart(before, token)):
                            fitting = token
                            break
                last.append(fitting)
            out, end = [], len(data) - 1
            while end >= 0:
                token = last[end]
                out.append(token)
                end -= lengths[token]
            out.reverse()
            yield tuple(out)

    def pieces_of(self, text: str) -> list[str]:
        """The pieces of a text, special tokens' strings among them."""
        split = ASCII_PIECES.findall if text.isascii() else self.pieces.findall
        out, at = [], 0
        for m in self.special_text.finditer(text) if self.special_text else ():
            out += split(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + split(text[at:]) if at else split(text)

    def encode_texts(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each of some texts; a piece is looked up or encoded once for all of them."""
        pieces = [self.pieces_of(t) if t else [] for t in texts]
        ids: dict[str, tuple[int, ...]] = {}
        new = []
        for p in set(chain.from_iterable(pieces)).difference(self.specials):
            found = self.known.get(p) or self.older.get(p)
            if found is None:
                new.append(p)
            else:
                ids[p] = found
        new.sort()
        ids.update(zip(new, self.encode_sorted(new)))
        self.known.update((p, x) for p, x in ids.items() if len(p) <= SHORT)
        if len(self.known) >= REMEMBERED // 2:
            self.known, self.older = {}, self.known
        ids.update((t, (i,)) for t, i in self.specials.items())
        for own in pieces:
            yield list(chain.from_iterable(map(ids.__getitem__, own)))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The ids of each text, some texts at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                yield from self.encode_texts(held)
                held, size = [], 0
        yield from self.encode_texts(held)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_texts([text]))

    @cached_property
    def all_bytes(self) -> dict[int, bytes]:
        return self.bytes_of | {i: t.encode() for t, i in self.specials.items()}

    @cached_property
    def lengths(self) -> dict[int, int]:
        return {i: len(b) for i, b in self.bytes_of.items()}

    @cached_property
    def decimals(self) -> dict[int, str]:
        return {i: str(i) for i in self.all_bytes}

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters. Special tokens become their strings."""
        return b"".join(map(self.all_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(spec_json: str) -> Codec:
    return Codec(json.loads(spec_json))


def load_spec(path: str) -> str:
    """The tokenizer file's text; the file is read where the driver runs and its content goes out with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, and the ids themselves if asked for."""
    bounded_batches(docs.sparkSession, "4m")
    shared = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))  # of a fixed size
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        decimals = c.decimals
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for ids in c.encode_all(batch.column(1).to_pylist()):
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(",".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                rows[2].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                if with_ids:
                    rows[3].append(ids)
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, *([pa.array(rows[3], pa.list_(pa.int32()))] if with_ids else [])], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
