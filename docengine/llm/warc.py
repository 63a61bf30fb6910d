"""WARC archives whose records are single Zstandard frames under one dictionary, which a leading skippable frame holds.

Each partition writes archives of up to ARCHIVE_FRAMES frames, so that no file grows with the input. For each archive a
dictionary is trained on its first records; the archive is the dictionary in a skippable frame, then a frame for each
record, with empty skippable frames between them. Any Zstandard reader that is given the
dictionary reads the file as one WARC stream. Spark's own writer commits the files, so lost tasks leave nothing behind.
Equal payloads are stored once: the record of the largest page_id is a response, the others are revisits of it.

A response's block is an HTTP response whose body is the page; a revisit's is that response's head alone. Pages come
without a time, so the date is a parameter.

Defined cases: null html is an empty payload; a null page_id counts as the smallest, and its record id says "null"; rows
that repeat the largest page_id with the same payload are responses too. Extra columns are ignored, an empty table gives
no rows. An archive with too few records for training has their bytes as its dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import new_path

#: First bytes of the skippable frame that holds a dictionary, as in the published .warc.zst format.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
#: An empty skippable frame; it is plain text to Spark's text writer, which puts it between records.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DICTIONARY_BYTES = 32 << 10
#: Frames of an archive, its dictionary included.
ARCHIVE_FRAMES = 10_000
#: The date of all records, unless another is given.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records, and bytes of them, that a dictionary is trained on.
TRAIN_RECORDS, TRAIN_BYTES = 400, 4 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response carries its payload; a revisit names the record that has it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, urn = head if revisit else head + payload, lambda i: f"<urn:page:{'null' if i is None else i}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _frames(records: Iterator[bytes]) -> Iterator[bytes]:
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if len(first) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
            break
    if not first:
        return
    known = _dictionary(first)
    body = known.as_bytes()
    yield DICTIONARY_MAGIC + struct.pack("<I", len(body)) + body
    press = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
    for r in first:
        yield press.compress(r)
    for r in records:
        yield press.compress(r)


def _archive(date: str, frames: int):
    """The frames of a partition's archives; each has as many but the last, so that Spark's writer cuts files between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = html or b""
                    yield record(page_id, url, payload, payload_digest(payload), refers_to, revisit, date)

        held, size, all_records, before = [], 0, records(), -1
        made = 0
        while made != before:
            before = made
            for frame in _frames(islice(all_records, frames - 1)):
                made += 1
                held.append(frame)
                size += len(frame)
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to and revisit. The groups of equal payloads are counted by digest, with partial sums;
    only digests that occur twice or more are joined back, so most pages take no part in the join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    keyed = rows.select("*", F.sha1("html").alias("digest"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("rank"))
    groups = keyed.groupBy("digest").agg(F.max("rank").alias("first_rank"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = keyed.join(groups, "digest", "left")
    revisit = F.coalesce(F.col("rank") < F.col("first_rank"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first_rank")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, *, date: str = DATE, archive_frames: int = ARCHIVE_FRAMES) -> None:
    """Archives of up to archive_frames frames from each partition of the planned records."""
    frames = plan_records(pages).mapInArrow(_archive(date, archive_frames), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", archive_frames).text(path)


def parse(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and block of every record of an archive."""
    content = memoryview(content)
    if not len(content):
        return
    if content[:4] != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with its dictionary")
    size = struct.unpack_from("<I", content, 4)[0]
    body = bytes(content[8 : 8 + size])
    kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    open_up = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
    at = 8 + size
    while at < len(content):
        if 0x50 <= content[at] <= 0x5F and content[at + 1 : at + 4] == b"\x2a\x4d\x18":
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        frame, parts = open_up.decompressobj(), []
        while not frame.eof:
            piece = content[at : at + (1 << 14)]
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _id(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail not in ("", "null") else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A response's length and digest are taken from its block as read; a revisit has those of the payload it names."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for h, block in parse(content.as_buffer()):
                kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                head, _, payload = block.partition(b"\r\n\r\n")
                length = int(head.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (length != len(payload) or digest != payload_digest(payload)):
                    raise ValueError(f"record {h['WARC-Record-ID']} does not match its digest")
                rows.append((_id(h["WARC-Record-ID"]), length, digest, kind, _id(h.get("WARC-Refers-To"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=list(names))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the archives under path."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
