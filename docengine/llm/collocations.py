"""Phrase collocations by vertical positional inverted lists.

Documents are cut into shards. A shard holds, for the frequent phrases of one length, the sorted positions at which they
occur; positions count words and skip one at the end of a piece, so that neighbours in a piece are neighbours in number. To
extend phrases by a word, a shard merge-joins the positions of its occurrences with the postings of adjacent words: of the
places where a frequent phrase of that length starts one later, with its last word. What the join yields for a phrase and a
word is the longer phrase's list in the shard, and the lengths of its lists over all shards are its exact frequency: shards
send phrase, word and length to buckets, and a bucket sends back the frequent ones to the shards that have them. Both parts
of a frequent phrase are frequent, so nothing is lost by extending frequent phrases alone.

Words are numbered for each language, so phrases of different languages never meet. Words and phrases are compared by their
letters and numbers, never by hashes. A phrase is one entry of each shard that has it, however often it occurs there; a
document longer than a shard is a shard of its own.

Defined cases: a null text counts as empty, a null lang as "und"; texts without words add nothing; rows that repeat count each
time; doc_id plays no part; extra columns are ignored, whatever their names; an empty table gives no rows; scores are exact,
as decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.llm.common import arrow_batches, buffers, chunks, fold_case, new_path, partitions, ranges, released, remove, word_hashes, written

#: Bytes of text of a shard, bytes of text for each bucket of words, and pairs of phrase and word that a bucket gets, about.
SHARD_BYTES, BUCKET_BYTES, BUCKET_PAIRS = 4 << 20, 32 << 20, 1 << 20

U64 = np.uint64
LOW = U64(0xFFFFFFFF)
#: Bytes that end a piece: . , ; : ! ? and the line ends from line feed to carriage return. Fixed values.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: Bytes that end a word besides.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09]] = True


def words_at(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and position of every word of some rows; positions skip one between pieces and between rows."""
    ends_piece = PIECE_ENDS[body]
    row_starts = np.zeros(len(body) + 1, bool)
    row_starts[offsets[:-1]] = True
    word = ~(ends_piece | BLANKS[body])
    before = np.concatenate(([False], word[:-1])) & ~row_starts[:-1]
    after = np.concatenate((word[1:], [False])) & ~row_starts[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    breaks = np.cumsum(ends_piece | row_starts[:-1])
    piece = breaks[start]
    skips = np.cumsum(np.concatenate(([0], (piece[1:] != piece[:-1]).astype(np.int64)))) if len(start) else start
    return start, end, np.searchsorted(offsets, start, "right") - 1, np.arange(len(start)) + skips


def _distinct(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of every word among the distinct ones, and these; compared by their bytes."""
    length = end - start
    letters = body[ranges(start, length)]
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes, as high bytes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: pa.Scalar, dtype=np.uint32) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def gaps(rising: np.ndarray, dtype=np.uint32) -> bytes:
    """A sorted array by its differences."""
    return packed(np.diff(rising, prepend=rising[:1] * 0).astype(dtype))


def from_gaps(data: pa.Scalar, dtype=np.uint32) -> np.ndarray:
    return np.cumsum(unpacked(data, dtype), dtype=dtype)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts buckets together and keeps what is inside, and each bucket with its range in that order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return order, list(zip(bucket[cut].tolist(), cut, [*cut[1:], len(bucket)]))


#: A shard's words in order: their positions and codes in its vocabulary, and the distinct words of each lang by bucket, a
#: blank between words and compressed, with codes and counts. One row has the positions, the others the vocabulary.
SHARDS = "shard long, n long, at binary, code binary, bucket int, lang string, words binary, codes binary, counts binary"


def _shards(buckets: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        fields = dict(zip(("shard", "n", "at", "code", "bucket", "lang", "words", "codes", "counts"), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), *[pa.binary()] * 3)))
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang_of, names = langs.indices.to_numpy().astype(np.int64), langs.dictionary.to_pylist()
            body, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets, SHARD_BYTES):
                part = fold_case(body[offsets[a] : offsets[b]])
                start, end, row, at = words_at(part, offsets[a : b + 1] - offsets[a])
                if not len(start):
                    continue
                word, distinct = _distinct(part, start, end)
                pairs, code, count = np.unique(word * len(names) + lang_of[a + row], return_inverse=True, return_counts=True)
                made = {c: [None] for c in fields} | {"shard": [shard], "n": [len(at)], "at": [gaps(at)], "code": [packed(code.astype(np.uint32))]}
                letters, edges = buffers(distinct)
                hashes = word_hashes(letters, edges[:-1], edges[1:])[pairs // len(names)]
                for number, lang in enumerate(names):
                    mine = np.flatnonzero(pairs % len(names) == number)
                    order, parts = by_bucket(bucket_of(hashes[mine], buckets))
                    mine = mine[order]
                    for bucket, i, j in parts:
                        some = distinct.take(pa.array(pairs[mine[i:j]] // len(names)))
                        entry = {"shard": shard, "n": int(count[mine[i:j]].sum()), "bucket": bucket, "lang": lang, "words": packed(np.frombuffer(" ".join(some.to_pylist()).encode(), np.uint8)), "codes": packed(mine[i:j].astype(np.uint32)), "counts": packed(count[mine[i:j]].astype(np.uint32))}
                        for c in fields:
                            made[c].append(entry.get(c))
                yield pa.RecordBatch.from_arrays([pa.array(made[c], t) for c, t in fields.items()], names=list(fields))
                shard += 1

    return run


#: For a shard the codes of its frequent words and their numbers; without a shard the frequent words.
WORDS = "shard long, codes binary, ids binary, lang string, word string, id long, f long"


def numbered(many: int, bucket: int, buckets: int) -> np.ndarray:
    """Numbers from 1 on that no other bucket gives."""
    ids = np.arange(many) * buckets + bucket + 1
    if many and ids[-1] >= 1 << 32:
        raise OverflowError("more frequent words, or phrases of one length, than can be numbered")
    return ids


def _frequent_words(buckets: int, least: int):
    @released
    def run(table: pa.Table) -> pa.Table:
        langs = table.column("lang").combine_chunks().dictionary_encode()
        texts = pc.split_pattern(pa.array([unpacked(x, np.uint8).tobytes() for x in table.column("words")], pa.large_binary()).cast(pa.large_string()), " ")
        lengths = pc.list_value_length(texts).to_numpy()
        words = pc.list_flatten(texts).dictionary_encode()
        key = words.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + np.repeat(langs.indices.to_numpy(), lengths)
        codes, counts = ([unpacked(x) for x in table.column(c)] for c in ("codes", "counts"))
        known, inverse = np.unique(key, return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, inverse, np.concatenate(counts).astype(np.int64))
        often = np.flatnonzero(total >= least)
        ids = np.zeros(len(known), np.int64)
        ids[often] = numbered(len(often), table.column("bucket")[0].as_py(), buckets)
        mine = np.split(ids[inverse], np.cumsum(lengths)[:-1])
        back = [(s, packed(c[i > 0]), packed(i[i > 0].astype(np.uint32))) for s, c, i in zip(table.column("shard").to_pylist(), codes, mine) if i.any()]
        m, k = len(back), len(often)
        to_shards = {"shard": pa.array([x[0] for x in back], pa.int64()), "codes": pa.array([x[1] for x in back], pa.binary()), "ids": pa.array([x[2] for x in back], pa.binary())}
        found = {"lang": langs.dictionary.take(pa.array(known[often] % len(langs.dictionary))), "word": words.dictionary.take(pa.array(known[often] // len(langs.dictionary))).cast(pa.string()), "id": pa.array(ids[often]), "f": pa.array(total[often])}
        return pa.table({c: pa.chunked_array([x, pa.nulls(k, x.type)]) for c, x in to_shards.items()} | {c: pa.chunked_array([pa.nulls(m, x.type), x]) for c, x in found.items()})

    return run


#: The lists of a shard for one length: sorted positions, the phrase that starts at each, and its last word, which for words
#: is the phrase itself and left out.
LISTS = "shard long, n long, at binary, phrase binary, word binary"


def _lists(shard: int, at: np.ndarray, phrase: np.ndarray, word: np.ndarray | None) -> pa.Table:
    values = {"at": gaps(at), "phrase": packed(phrase.astype(np.uint32)), "word": None if word is None else packed(word.astype(np.uint32))}
    return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(at)], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in values.items()}})


NO_LISTS = _lists(-1, *[np.zeros(0, np.uint32)] * 3)[:0]


def _read_lists(table: pa.Table | pa.RecordBatch, row: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, phrase = from_gaps(table.column("at")[row]), unpacked(table.column("phrase")[row])
    word = table.column("word")[row]
    return at, phrase, unpacked(word) if word.is_valid else phrase


def _all(table: pa.Table, column: str, dtype=np.uint32, read=unpacked) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(read(x, dtype) for x in table.column(column))])


@released
def _word_lists(shards: pa.Table, replies: pa.Table) -> pa.Table:
    """The postings of a shard's frequent words."""
    if not len(shards) or not len(replies):
        return NO_LISTS
    at, code = from_gaps(shards.column("at")[0]), unpacked(shards.column("code")[0])
    number = np.zeros(int(code.max()) + 1, np.uint32)
    number[_all(replies, "codes")] = _all(replies, "ids")
    word = number[code]
    keep = word > 0
    return _lists(shards.column("shard")[0].as_py(), at[keep], word[keep], None)


def extended(at: np.ndarray, phrase: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of the lists with the adjacent words' postings: where an occurrence has one that starts a place later, and
    the pair of its phrase and that one's last word."""
    met = np.flatnonzero(at[1:] == at[:-1] + 1)
    return met, (phrase[met].astype(U64) << U64(32)) | word[met + 1]


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (values ^ (values >> U64(29))) * U64(0x9E3779B97F4A7C15)
    return ((mixed >> U64(33)) * U64(buckets) >> U64(31)).astype(np.int64)


PACKS = "bucket int, shard long, pairs binary, counts binary"


def _send(buckets: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                _, pairs = extended(*_read_lists(batch, i))
                pairs, counts = np.unique(pairs, return_counts=True)
                if not len(pairs):
                    continue
                order, parts = by_bucket(bucket_of(pairs, buckets))
                pairs, counts = pairs[order], counts[order].astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in parts], pa.int32()), pa.array([batch.column("shard")[i].as_py()] * len(parts), pa.int64()), pa.array([gaps(pairs[a:b], U64) for _, a, b in parts], pa.binary()), pa.array([packed(counts[a:b]) for _, a, b in parts], pa.binary())],
                    names=["bucket", "shard", "pairs", "counts"],
                )

    return run


#: For a shard its frequent pairs and the numbers of the phrases they make; without a shard the frequent phrases.
REPLIES = "shard long, pairs binary, ids binary, phrase long, first long, word long, a long"


def _frequent(buckets: int, least: int):
    @released
    def run(table: pa.Table) -> pa.Table:
        parts = [from_gaps(x, U64) for x in table.column("pairs")]
        pairs, counts = np.concatenate(parts), _all(table, "counts").astype(np.int64)
        order = np.argsort(pairs, kind="stable")
        known = pairs[order]
        first = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1])))
        total = np.add.reduceat(counts[order], first)
        often = total >= least
        known, total = known[first[often]], total[often]
        ids = numbered(len(known), table.column("bucket")[0].as_py(), buckets)
        back = []
        for shard, part in zip(table.column("shard").to_pylist(), parts):
            at = np.searchsorted(known, part)
            mine = at[known[np.minimum(at, len(known) - 1)] == part] if len(known) else at[:0]
            if len(mine):
                back.append((shard, gaps(known[mine], U64), packed(ids[mine].astype(np.uint32))))
        m, k = len(back), len(known)
        to_shards = {"shard": pa.array([x[0] for x in back], pa.int64()), "pairs": pa.array([x[1] for x in back], pa.binary()), "ids": pa.array([x[2] for x in back], pa.binary())}
        found = {"phrase": pa.array(ids), "first": pa.array((known >> U64(32)).astype(np.int64)), "word": pa.array((known & LOW).astype(np.int64)), "a": pa.array(total)}
        return pa.table({c: pa.chunked_array([x, pa.nulls(k, x.type)]) for c, x in to_shards.items()} | {c: pa.chunked_array([pa.nulls(m, x.type), x]) for c, x in found.items()})

    return run


@released
def _kept(lists: pa.Table, replies: pa.Table) -> pa.Table:
    """The lists of the longer phrases of a shard that are frequent."""
    if not len(lists) or not len(replies):
        return NO_LISTS
    at, phrase, word = _read_lists(lists)
    known, ids = _all(replies, "pairs", U64, from_gaps), _all(replies, "ids")
    order = np.argsort(known)
    known, ids = known[order], ids[order]
    met, pairs = extended(at, phrase, word)
    place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    good = known[place] == pairs
    return _lists(lists.column("shard")[0].as_py(), at[met[good]], ids[place[good]], (pairs[good] & LOW).astype(np.uint32))


def _next(spark: SparkSession, lists: DataFrame, held: str) -> tuple[DataFrame, str]:
    """Writes the lists of the next length and removes what they were made from, which nothing else reads."""
    path = new_path(spark, "phrase-lists")
    out = written(lists, "phrase-lists", path)
    remove(spark, held)
    return out, path


def frequent_phrases(docs: DataFrame, most_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k (its number of words) and f of every phrase of up to most_words words that occurs least times or more,
    and lang and n, the number of words."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))
    with arrow_batches(spark, f"{SHARD_BYTES}b"):
        held = new_path(spark, "phrase-shards")
        shards = written(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(_shards(buckets), SHARDS), "phrase-shards", held)
        vocabulary = shards.filter("bucket IS NOT NULL").select("shard", "bucket", "lang", "words", "codes", "counts")
        words = written(vocabulary.groupBy("bucket").applyInArrow(_frequent_words(buckets, least), WORDS), "phrase-words")
        totals = written(shards.filter("bucket IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        back = words.filter("shard IS NOT NULL").select("shard", "codes", "ids")
        texts = shards.filter("bucket IS NULL").select("shard", "at", "code")
        lists, held = _next(spark, texts.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_word_lists, LISTS), held)
        now = words.filter("shard IS NULL").select("lang", F.col("word").alias("phrase"), "id", "f")
        last = now.select(F.col("id").alias("w"), F.col("phrase").alias("word"))
        out = [now.select("lang", "phrase", F.lit(1).alias("k"), "f")]
        for k in range(2, most_words + 1):
            occurrences = lists.agg(F.sum("n")).first()[0] or 0
            if not occurrences:
                break
            buckets = max(partitions(spark), -(-occurrences // BUCKET_PAIRS))
            replies = written(lists.mapInArrow(_send(buckets), PACKS).groupBy("bucket").applyInArrow(_frequent(buckets, least), REPLIES), "phrase-replies")
            if k < most_words:
                back = replies.filter("shard IS NOT NULL").select("shard", "pairs", "ids")
                lists, held = _next(spark, lists.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_kept, LISTS), held)
            found = replies.filter("shard IS NULL").select(F.col("phrase").alias("new"), F.col("first").alias("id"), F.col("word").alias("w"), F.col("a").alias("f"))
            made = found.join(now.drop("f"), "id").join(last, "w").select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.col("new").alias("id"), "f")
            now = written(made, "phrase-found")
            out.append(now.select("lang", "phrase", F.lit(k).alias("k"), "f"))
    remove(spark, held)
    return reduce(DataFrame.unionByName, out), totals


def mine(docs: DataFrame, *, most_words: int = 5, least: int = 100, closure: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each lang. A phrase is left out if a longer one of at most
    most_words words holds it and has at least closure percent of its frequency. Its score is that of its lowest cut."""
    known, totals = frequent_phrases(docs, most_words, least)
    known = written(known, "phrase-frequencies")
    candidates = known.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    joined = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    parts = candidates.filter("k > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("k") - 1), joined(F.lit(2), F.col("k") - 1))).alias("phrase"))
    held = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = candidates.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < closure * F.col("a")))
    cuts = open_.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    side = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(17,0)")
    scored = scored.withColumn("num", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("den", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("CAST(num div den AS BIGINT)"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
