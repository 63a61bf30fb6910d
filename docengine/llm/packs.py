"""Exchange of fingerprints between groups of documents, in packs: sorted arrays of 64-bit values in binary columns.

Each group of documents sends every value once, with its count there, to the bucket of the value; a bucket sends back to
each group those of its values that occur twice or more over all groups, with their total. A value that a third of all
documents have is one entry for each group and task, so no task gathers its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docengine.llm.common import released

U64 = np.uint64
SCHEMA = "bucket int, groups binary, fps binary, counts binary"
#: Values that a task holds before it sends them.
HELD = 400_000
#: Bytes of a value that are sent: equal ends are taken for equal values, which here only costs needless candidates.
SENT = 6


def sent(values: np.ndarray) -> np.ndarray:
    """The part of each value that is compared."""
    return values & ((U64(1) << U64(8 * SENT)) - U64(1))


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket of a value that is sent, by 32 of its bits."""
    return ((values >> U64(8 * SENT - 32)) & U64(0xFFFFFFFF)) * U64(buckets) >> U64(32)


def to_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def from_bytes(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // SENT, 8), np.uint8)
    out[:, :SENT] = data.reshape(-1, SENT)
    return out.view(U64).ravel()


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def pack(groups: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: by group its values, sorted and once each, and how often each came."""
    values = sent(values)
    order = np.lexsort((values, groups))
    groups, values = groups[order], values[order]
    first = runs_of(groups, values)
    counts = np.diff(np.concatenate((first, [len(values)]))).astype(np.uint32)
    groups, values = groups[first].astype(np.int32), values[first]
    bucket = bucket_of(values, buckets).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket, groups, values, counts = bucket[order], groups[order], values[order], counts[order]
    cut = runs_of(bucket).tolist()
    ends = [*cut[1:], len(values)]
    parts = ([form(x[a:b]) for a, b in zip(cut, ends)] for x, form in ((groups, np.ndarray.tobytes), (values, to_bytes), (counts, np.ndarray.tobytes)))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), *(pa.array(x, pa.binary()) for x in parts)], names=["bucket", "groups", "fps", "counts"])


class Packer:
    """Collects values of a task and packs them when many are held."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, groups: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((groups, values))
        self.n += len(values)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            groups, values = (np.concatenate(x) for x in zip(*self.held))
            yield pack(groups, values, self.buckets)
        self.held, self.n = [], 0


def unpack(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The values of a binary column's rows, one row after the other; null counts as empty."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def unpack_values(column: pa.ChunkedArray) -> np.ndarray:
    return from_bytes(unpack(column, np.uint8))


@released
def _repeated(table: pa.Table) -> pa.Table:
    values = unpack_values(table.column("fps"))
    counts, groups = unpack(table.column("counts"), np.uint32), unpack(table.column("groups"), np.int32)
    order = np.argsort(values, kind="stable")
    values, counts, groups = values[order], counts[order].astype(np.int64), groups[order]
    first = runs_of(values)
    if len(first):
        total = np.repeat(np.add.reduceat(counts, first), np.diff([*first, len(values)]))
        keep = total >= 2
        values, groups, total = values[keep], groups[keep], total[keep]
        order = np.argsort(groups, kind="stable")
        values, groups, total = values[order], groups[order], np.minimum(total[order], 2**32 - 1).astype(np.uint32)
    else:
        total = counts.astype(np.uint32)
    cut = runs_of(groups).tolist()
    ends = [*cut[1:], len(values)]
    return pa.table(
        {
            "g": pa.array(groups[cut].astype(np.int32)),
            "fps": pa.array([to_bytes(values[a:b]) for a, b in zip(cut, ends)], pa.binary()),
            "counts": pa.array([total[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        }
    )


def repeated_by_group(packs: DataFrame) -> DataFrame:
    """g, fps, counts: for each group and bucket the group's values that occur twice or more over all groups."""
    return packs.groupBy("bucket").applyInArrow(_repeated, "g int, fps binary, counts binary")
