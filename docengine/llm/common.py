"""Helpers that the training-data operators share: shared storage, word and byte hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, as a Java character class; bytes.split() without arguments splits at the same six.
SPACES = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text that one vectorised step handles at once; a longer document makes a step of its own.
CHUNK_BYTES = 1 << 18
#: Bytes of text of a group of documents that one Python worker gets at once, about: the number of groups follows the
#: input's size.
GROUP_BYTES = 8 << 20

#: Bytes of a word up to which its hash is a rolling sum.
SHORT_WORD = 24

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
#: Two independent rolling hashes: a random 64-bit value for each byte and an odd base with its inverse modulo 2**64.
BYTE_VALUES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * U64(2) + U64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 2**64) for b in BASES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset in a local session, as in tests, a temporary one is set.
    A cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="docengine-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docengine/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, at path if its caller wants to remove it: the lineage ends there, so a lost
    executor costs no earlier stage."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that a later one has replaced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def present(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches of at most size from now on in this session, so that a few long rows do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of at most size for what is run inside, and what was set before again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(fn: Callable) -> Callable:
    """fn, a function of one or two tables or of a stream of batches, with freed memory given back at its end."""

    def after(out):
        if isinstance(out, Iterator):
            return _to_end(out)
        release_memory()
        return out

    if fn.__code__.co_argcount == 2:
        return wraps(fn)(lambda left, right: after(fn(left, right)))
    return wraps(fn)(lambda data: after(fn(data)))


def _to_end(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        release_memory()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(docs: DataFrame, *most: int) -> list[int]:
    """As many groups as shuffle partitions, or more where a group would have more text than the given bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return [max(partitions(docs.sparkSession), -(-size // m)) for m in most]


def sample_fraction(rows: int, bound: int) -> float:
    return min(1.0, bound / max(rows, 1))


def hashed_sample(df: DataFrame, fraction: float, *columns: str) -> DataFrame:
    """The rows whose columns hash below the fraction: the same rows on every run and however they are dealt out."""
    return df if fraction >= 1 else df.filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 1 << 19:
            _POWERS[base] = have
    return have[:n]


class Rolling:
    """Hashes of any slices of a sequence of 64-bit values, from prefix sums: a slice's hash depends on its values alone."""

    def __init__(self, values: np.ndarray, lane: int = 0):
        self.back = powers(INVERSES[lane], len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * powers(BASES[lane], len(values)), out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins and the last ends; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def whole(column: pa.ChunkedArray) -> pa.Array:
    """All chunks of a text column as one array; large_string, as string can't hold more than 2 GiB."""
    return pa.chunked_array([*column.cast(pa.large_string()).chunks, pa.array([], pa.large_string())]).combine_chunks()


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of rows of about size bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of some rows, and the index of each row's first word (one more than rows)."""
    space = np.ones(len(body) + 2, bool)
    space[1:-1] = _SPACE[body]
    word = ~space[1:-1]
    begins = word & space[:-2]
    ends = word & space[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(body))]
    begins[edges] |= word[edges]
    ends[edges - 1] |= word[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def spaced(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of words_of, each followed by one blank, and where each begins and the last ends."""
    at = np.concatenate(([0], np.cumsum(end - start + 1)))
    out = np.full(at[-1], 0x20, np.uint8)
    letter = np.ones(at[-1], bool)
    letter[at[1:] - 1] = False
    out[letter] = body[~_SPACE[body]]
    return out, at


#: Bytes of the cryptographic digests that stand for whole texts or word sequences.
DIGEST = 16


def digests(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A cryptographic digest of every slice of some bytes, one after the other."""
    view = memoryview(np.ascontiguousarray(body))
    each = [hashlib.blake2b(view[a:b], digest_size=DIGEST).digest() for a, b in zip(start.tolist(), end.tolist())]
    return np.frombuffer(bytearray().join(each), np.uint8) if each else np.zeros(0, np.uint8)


def digest_column(data: np.ndarray) -> pa.Array:
    """What digests returns, as a column."""
    n = len(data) // DIGEST
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * DIGEST, DIGEST, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by pieces of the text of bounded size (or one word). Sums modulo 2**64 can be
    equal for long words made to that end, so words beyond SHORT_WORD bytes have a cryptographic hash."""
    out, a = np.zeros(len(start), U64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + CHUNK_BYTES, "right")))
        piece = body[start[a] : end[b - 1]]
        out[a:b] = Rolling(BYTE_VALUES[lane][piece], lane).slices(start[a:b] - start[a], end[a:b] - start[a])
        a = b
    for i in np.flatnonzero(end - start > SHORT_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(body[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return mix(out)


def fold_case(body: np.ndarray) -> np.ndarray:
    """A to Z lower-cased, other bytes as they are."""
    return np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of width values, by doubling."""
    if len(x) < width:
        return x[:0]
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x if step == width else np.minimum(x[: len(x) - (width - step)], x[width - step :])


#: Low bits of a hash that give way to a place when the least is looked for; the same for texts of every length.
PLACE_BITS = 20


def first_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least hash of every run of width, the first of equal ones. Long sequences go by overlapping pieces, so
    that what is compared of a hash does not depend on how long they are."""
    bits, size = U64(PLACE_BITS), 1 << PLACE_BITS
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(hashes) - width + 1, size - width + 1):
        part = hashes[a : a + size]
        least = sliding_min(((part >> bits) << bits) | np.arange(len(part), dtype=U64), width)
        out.append((least & U64(size - 1)).astype(np.int64) + a)
    return np.concatenate(out)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The integers of every range start..start+length-1, one range after the other."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(np.asarray(start, np.int64) - (np.cumsum(length) - length), length)
    return first + np.arange(total)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any range start..end-1."""
    edge = np.bincount(start, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
