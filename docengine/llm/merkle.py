"""Merkle manifest of a data set. Every row is a leaf, the rows of a group (here a language) form a tree in order of their id,
and the trees' roots form one more tree, whose root stands for the whole table.

Trees are built by combineByKey over spans of 4,096 consecutive nodes. The arrival of a digest is an event: it joins its
partial parent, and a parent that has as many children as its place and the size of the level demand is hashed and becomes an
event itself. Partial parents that a task can't complete travel to the span's reducer with their children; the tops of all
spans are the nodes of the next round, so a tree of n leaves takes log(n) / 12 rounds. A complete span follows its links back
from the top and gives every node below its siblings; a leaf's proof is its siblings in its span, then its span's in the next
round, and so on up to the root.

Leaves are numbered by range partitions and places within a partition, and written before they are combined; a tree's leaves,
however many, are dealt out by spans. A span's digests, some 4,096 by 2, are all that a task holds of a tree at once.

Defined cases: null values count as a dash, which no other value can give; a null group or id comes first; rows of one id are
in order of their leaves; rows that repeat are leaves of their own; extra columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import partitions, written

#: Children of a parent, and levels that one round builds.
ARITY, DEPTH = 2, 12
#: Rows of a range partition, and nodes that a reducer of spans gets, about.
PART_ROWS, TASK_NODES = 1 << 20, 1 << 17


def parent_of(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def level_sizes(size: int) -> list[int]:
    """The number of nodes of every level of a tree, leaves first."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Span:
    """Nodes of one span as far as they are known: partial parents with their children by index, links of complete ones."""

    def __init__(self, size: int, depth: int = DEPTH):
        self.sizes = level_sizes(size)[: depth + 1]
        self.partial: dict[tuple[int, int], dict[int, bytes]] = {}
        self.links: dict[tuple[int, int], list[bytes]] = {}
        self.top: tuple[int, int, bytes] | None = None

    def arrive(self, level: int, index: int, digest: bytes) -> Span:
        while level < len(self.sizes) - 1:
            parent = index // ARITY
            children = self.partial.setdefault((level, parent), {})
            children[index] = digest
            if len(children) < min(ARITY, self.sizes[level] - ARITY * parent):
                return self
            links = [children[i] for i in sorted(self.partial.pop((level, parent)))]
            self.links[level, parent] = links
            level, index, digest = level + 1, parent, parent_of(links)
        self.top = (level, index, digest)
        return self

    def absorb(self, other: Span) -> Span:
        self.links.update(other.links)
        self.top = self.top or other.top
        for (level, _), children in other.partial.items():
            for index, digest in children.items():
                self.arrive(level, index, digest)
        return self

    def paths(self) -> Iterator[tuple[int, bytes]]:
        """The index of every node that came in, and its siblings from below to the top, left to right within a run."""
        if self.partial or self.top is None:
            raise ValueError("a span lacks nodes")
        level, index, _ = self.top
        known = {index: b""}
        while level:
            level -= 1
            known = {
                ARITY * parent + k: b"".join(links[:k] + links[k + 1 :]) + path
                for parent, path in known.items()
                for links in (self.links[level, parent],)
                for k in range(len(links))
            }
        yield from known.items()


def fold(digest: bytes, index: int, size: int, siblings: bytes) -> tuple[bytes, bytes]:
    """The root that a node and its siblings give, and the siblings that are left over."""
    at = 0
    for n in level_sizes(size)[:-1]:
        first = index - index % ARITY
        count = min(ARITY, n - first)
        run = [siblings[at + 32 * k : at + 32 * k + 32] for k in range(count - 1)]
        at += 32 * len(run)
        digest = parent_of([*run[: index - first], digest, *run[index - first :]])
        index //= ARITY
    return digest, siblings[at:]


def _combined(nodes: RDD, reducers: int, depth: int) -> RDD:
    """(tree, index, path, null) of every node (tree, index, size, digest), and (tree, span, null, top) of every span."""
    keyed = nodes.map(lambda r: ((r[0], r[1] // ARITY**depth), (r[1], r[2], bytes(r[3]))))
    first = lambda v: Span(v[1], depth).arrive(0, v[0], v[2])
    spans = keyed.combineByKey(first, lambda span, v: span.arrive(0, v[0], v[2]), Span.absorb, reducers)

    def rows(entry):
        (tree, span), found = entry
        yield tree, span, None, bytearray(found.top[2])
        for index, path in found.paths():
            yield tree, index, bytearray(path), None

    return spans.flatMap(rows)


def build(nodes: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """From tree, index, size and digest of all nodes: tree and digest of every root, and for every round the paths (tree,
    index, path) within its spans; index counts the round's nodes."""
    most, count = nodes.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    rounds, now = [], nodes
    while most > 1 or not rounds:
        spark = nodes.sparkSession
        reducers = max(partitions(spark), -(-count // TASK_NODES))
        made = spark.createDataFrame(_combined(now.select("tree", "index", "size", "digest").rdd, reducers, depth), "tree long, index long, path binary, top binary", verifySchema=False)
        made = written(made, "merkle-round")
        rounds.append(made.filter("path IS NOT NULL").select("tree", "index", "path"))
        sizes = now.select("tree", F.ceil(F.col("size") / ARITY**depth).alias("size")).distinct()
        now = made.filter("top IS NOT NULL").select("tree", "index", F.col("top").alias("digest")).join(sizes, "tree")
        most, count = -(-most // ARITY**depth), -(-count // ARITY**depth)
    return now.select("tree", "digest"), rounds


def encoded(c: str | Column) -> Column:
    """A value that can't be taken for another: a dash for null, else its number of bytes, a colon and itself."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: str | Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(c) for c in columns)).cast("binary"), 256))


def number_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves (group, id, leaf and more) with tree, index and size, and the trees: group, tree, size. One row a group is all
    that a single task sees."""
    spark = leaves.sparkSession
    rows = leaves.count()
    p = max(partitions(spark), -(-rows // PART_ROWS))
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(p, "group", "id", "leaf", "tie").withColumn("part", F.spark_partition_id()).drop("tie")
    dealt = written(dealt, "merkle-dealt")
    parts = dealt.groupBy("group", "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("group").orderBy("part")) - F.col("c")
    sizes = parts.groupBy("group").agg(F.sum("c").alias("size"))
    trees = written(sizes.select("group", (F.row_number().over(Window.orderBy(F.asc_nulls_first("group"))) - 1).cast("long").alias("tree"), "size"), "merkle-trees")
    same = lambda a, b: F.col(f"{a}.group").eqNullSafe(F.col(f"{b}.group"))
    offsets = parts.select("group", "part", before.alias("before")).alias("p").join(trees.alias("t"), same("p", "t")).select("p.group", "part", "before", "tree", "size")
    offsets = written(offsets, "merkle-offsets")
    place = F.row_number().over(Window.partitionBy("group", "part").orderBy(F.asc_nulls_first("id"), "leaf")) - 1
    at = dealt.withColumn("place", place).alias("d").join(offsets.alias("o"), same("d", "o") & (F.col("d.part") == F.col("o.part")))
    rest = [f"d.{c}" for c in leaves.columns]
    return written(at.select(*rest, "o.tree", (F.col("o.before") + F.col("d.place")).alias("index"), "o.size"), "merkle-leaves"), trees


def _proven(trees: int, root: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {k: [] for k in ("proof_sha256", "folded_root", "verified")}
            columns = (batch.column(c).to_pylist() for c in ("tree", "index", "size", "held", "path"))
            for tree, index, size, held, path in zip(*columns):
                made["proof_sha256"].append(hashlib.sha256(path.hex().encode()).hexdigest())
                top, rest = fold(held, index, size, path)
                folded, rest = fold(top, tree, trees, rest)
                made["folded_root"].append(folded.hex())
                made["verified"].append(folded == root and not rest)
            keep = [c for c in batch.schema.names if c not in ("tree", "index", "size", "held", "path")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(made[k], pa.bool_() if k == "verified" else pa.string()) for k in made)], names=[*keep, *made])

    return run


@dataclass(frozen=True)
class Manifest:
    """The root of a table, the number of trees, and of every leaf: id, tree, index, size (of the tree), leaf, held, subroot
    and path, the siblings of 32 bytes each from the leaf to the root."""

    root: bytes
    trees: int
    leaves: DataFrame

    def prove(self) -> DataFrame:
        """The digest of every leaf's proof, the root that held and the proof give, and whether it is the root."""
        hexed = lambda c: F.lower(F.hex(c)).alias(c)
        ready = self.leaves.select("id", hexed("leaf"), hexed("subroot"), F.lit(self.root.hex()).alias("root"), "tree", "index", "size", "held", "path")
        return ready.mapInArrow(_proven(self.trees, self.root), "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(rows: DataFrame, depth: int = DEPTH) -> Manifest:
    """From group, id, leaf and held (the leaf to be proven, as it may have been tampered with); a round builds depth levels."""
    leaves, trees = number_leaves(rows)
    subroots, rounds = build(leaves.select("tree", "index", "size", F.col("leaf").alias("digest")), depth)
    subroots, n = written(subroots, "merkle-subroots"), trees.count()
    roots, over = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(n).cast("long").alias("size"), "digest"), depth)
    root = roots.first()
    out, up = leaves, subroots.select("tree", F.col("digest").alias("subroot"))
    for k, paths in enumerate(rounds):
        at = paths.select("tree", F.col("index").alias("at"), F.col("path").alias(f"path{k}"))
        out = out.withColumn("at", F.floor(F.col("index") / ARITY ** (depth * k))).join(at, ["tree", "at"]).drop("at")
    for k, paths in enumerate(over):
        at = paths.select(F.col("index").alias("at"), F.col("path").alias(f"over{k}"))
        up = up.withColumn("at", F.floor(F.col("tree") / ARITY ** (depth * k))).join(at, "at").drop("at")
    out = out.join(written(up, "merkle-over"), "tree")
    path = F.concat(*(f"path{k}" for k in range(len(rounds))), *(f"over{k}" for k in range(len(over))))
    return Manifest(bytes(root.digest) if root else b"", n, out.select("id", "tree", "index", "size", "leaf", "held", "subroot", path.alias("path")))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents: a tree a lang, in order of doc_id. In held, documents whose doc_id's CRC-32 seven divides have one
    added to n_chars."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    more = [(F.col(c).cast("decimal(20,0)") + 1).cast("string") if c == "n_chars" else c for c in fields]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    made = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf_of(*fields).alias("leaf"), F.when(tampered, leaf_of(*more)).alias("changed"))
    made = written(made, "merkle-hashes")
    return made.select("group", "id", "leaf", F.coalesce("changed", "leaf").alias("held"))
