"""Mixing of sources to target weights. The words of every source are laid out in one row and packed into blocks of a fixed
length. Output shards have a fixed number of slots; each shard draws the number of its slots for every source from a
multinomial distribution, slot by slot. The j-th slot of a source is mapped through the source's pseudorandom permutation of
block indices, a new one each time that all blocks are used up, and slots and blocks are joined by index. Everything stays in
DataFrame operations on the JVM, and every draw comes from MD5 or modular arithmetic, so that reruns agree.

Drawn totals scatter about what the targets ask. Slots of a source beyond its share are dealt to the sources that lack some,
so a source's total is its target to within a block, and no block is used more often than the cap allows. As slots are counted
in the order of shards, it is the last shards whose counts give way.

Documents of a source are laid out by a hash of doc_id, then doc_id, size and text: places come from sums over 4,096 hash
buckets a source and running sums within a bucket, so no task has a whole source. Rows with the same source, doc_id and size
(and text, where texts are carried) are counted together before they are laid out.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, the last; a null
doc_id comes first in its bucket; rows that repeat are documents of their own; extra columns are ignored, whatever their names;
an empty table gives no rows; a source without words has the target 0. Weights are positive; a source that the weights leave
out is not taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import SPACES, written

#: Words of a block, slots of an output shard, rounds of a permutation, and the seed of all draws.
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, SEED = 64, 8192, 24, 7
#: What the draws are taken from is split into as many cells, so that a draw meets its source by an equality.
CELLS = 1024
PRIME = (1 << 31) - 1


def hashed(*parts: Column | str | int) -> Column:
    """A value of 60 bits from the MD5 of the parts."""
    text = F.concat_ws("|", *(F.lit(str(x)) if not isinstance(x, Column) else x.cast("string") for x in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(c: str = "source") -> Column:
    """The source as a string that is never null and sorts nulls last by its first character."""
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("t"))


def lay_out(docs: DataFrame, text: bool = False) -> DataFrame:
    """Documents with their sizes, equal ones counted together: skey, doc_id, size, bucket, copies, and text if asked for."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACES}]+"), F.lit(0))).cast("long")
    rows = docs.select(source_key().alias("skey"), "doc_id", size.alias("size"), *(["text"] if text else []))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary")), 1, 3), 16, 10).cast("int")
    return written(rows.withColumn("bucket", bucket), "mix-sizes")


def cycled_weights(docs: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """The sources in order of their code points, null last, with the weights repeating: skey and weight. One row a source."""
    keys = docs.select(source_key().alias("skey")).distinct()
    no = F.row_number().over(Window.orderBy("skey")) - 1
    return keys.select("skey", F.element_at(F.array(*(F.lit(w) for w in weights)), (no % len(weights) + 1).cast("int")).cast("long").alias("weight"))


def source_targets(laid: DataFrame, weights: DataFrame, percent: int, cap: int) -> DataFrame:
    """skey, weight, source_size and target of every source. All sources share percent of all words by weight; a source above
    cap times its size stops there and what it leaves is shared by the others, until none is above. Each round reads three
    sums of the table of sources."""
    sizes = laid.groupBy("skey").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = written(sizes.join(weights, "skey"), "mix-sources")
    words, rate = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    words, rate, stopped = words or 0, rate or 0, None
    wide = lambda c: c.cast("decimal(38,0)")
    num, den = percent * words, 100 * rate
    while den:
        above = wide(F.col("weight")) * wide(F.lit(num)) > wide(F.col("source_size")) * wide(F.lit(cap * den))
        count, full, left = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if count == stopped:
            break
        stopped, num, den = count, percent * words - 100 * cap * (full or 0), 100 * (left or 0)
    most = (F.col("source_size") * cap).cast("double")
    share = most if not den else F.least(most, (F.col("weight") * F.lit(num)).cast("double") / F.lit(float(den)))
    return sources.select("skey", "weight", "source_size", share.alias("target"))


def numbered(targets: DataFrame, block_words: int, cap: int) -> DataFrame:
    """The sources with their number, blocks, slots and where these begin among all slots. One row a source."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    slots = F.when(F.col("source_size") == 0, 0).otherwise(F.least(cap * F.col("blocks"), F.floor(F.col("blocks") * F.col("target") / F.col("source_size") + 0.5)))
    out = targets.withColumn("blocks", blocks).withColumn("slots", slots.cast("long"))
    order = Window.orderBy("skey")
    before = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return written(out.select("*", F.row_number().over(order).alias("no"), F.coalesce(before, F.lit(0)).cast("long").alias("lo")), "mix-targets")


def permuted(j: Column, n: Column, keys: Column) -> Column:
    """The place of j in a permutation of n places by swapping or not: in every round a place and its mirror about a random
    point change places if a bit of the greater of both says so. Holds for any n."""

    def step(x: Column, k: Column) -> Column:
        mirror = (k["at"] + n - x) % n
        return F.when(((F.greatest(x, mirror) % PRIME * k["a"] + k["b"]) % PRIME).bitwiseAND(1) == 1, mirror).otherwise(x)

    return F.aggregate(keys, j, step)


def round_keys(no: Column, epoch: Column, n: Column) -> Column:
    one = lambda r: F.struct((hashed(SEED, "at", no, epoch, r) % n).alias("at"), (hashed(SEED, "a", no, epoch, r) % (PRIME - 1) + 1).alias("a"), (hashed(SEED, "b", no, epoch, r) % PRIME).alias("b"))
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), one)


def placed(sources: DataFrame, shard_slots: int, cap: int) -> DataFrame:
    """slot, shard, no and block of every slot of the output."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    width = max(1, -(-total // CELLS))
    cells = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("slots") - 1) / width)))
    ranges = sources.filter("slots > 0").select("no", "lo", (F.col("lo") + F.col("slots")).alias("hi"), cells.alias("cell"))
    draws = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), (hashed(SEED, "slot", F.col("id")) % max(total, 1)).alias("u"))
    drawn = draws.withColumn("cell", F.floor(F.col("u") / width)).join(ranges, "cell").filter("u >= lo AND u < hi").select("slot", "shard", "no")
    drawn = written(drawn.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "no").orderBy("slot")) - 1), "mix-draws")
    counts = written(drawn.groupBy("shard", "no").agg(F.count("*").alias("c")), "mix-counts")
    before = counts.select("shard", "no", F.coalesce(F.sum("c").over(Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    have = sources.select("no", "slots").join(counts.groupBy("no").agg(F.sum("c").alias("c")), "no", "left").select("no", "slots", F.coalesce("c", F.lit(0)).alias("c"))
    over, lack = F.greatest(F.col("c") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("c"), F.lit(0))
    up_to = lambda x: (F.sum(x).over(Window.orderBy("no")) - x).cast("long")
    have = written(have.select("no", "slots", "c", up_to(over).alias("over_at"), lack.alias("lack"), up_to(lack).alias("lack_at")), "mix-shares")
    ranked = drawn.join(before, ["shard", "no"]).withColumn("j", F.col("before") + F.col("nth")).join(have.select("no", "slots", "over_at"), "no")
    kept = ranked.filter("j < slots").select("slot", "shard", "no", "j")
    free = have.filter("lack > 0").select(F.col("no").alias("to"), "c", "lack_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("i"))
    moved = ranked.filter("j >= slots").select("slot", "shard", (F.col("over_at") + F.col("j") - F.col("slots")).alias("q"))
    moved = moved.join(free.select("to", (F.col("lack_at") + F.col("i")).alias("q"), (F.col("c") + F.col("i")).alias("j")), "q").select("slot", "shard", F.col("to").alias("no"), "j")
    epochs = sources.filter("blocks > 0").select("no", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cap - 1).cast("long"))).alias("epoch"))
    epochs = written(epochs.withColumn("keys", round_keys(F.col("no"), F.col("epoch"), F.col("blocks"))), "mix-keys")
    size = sources.select("no", "blocks")
    indexed = kept.union(moved).join(size, "no").select("slot", "shard", "no", F.floor(F.col("j") / F.col("blocks")).alias("epoch"), (F.col("j") % F.col("blocks")).alias("j"))
    return indexed.join(epochs, ["no", "epoch"]).select("slot", "shard", "no", permuted(F.col("j"), F.col("blocks"), F.col("keys")).alias("block"))


def segments(laid: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """Every document's part in every block: no, block, doc_id, size, row (what tells documents apart), first_word and
    n_words; a document without words has one row, without a block. Columns of laid stay."""
    within = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size", *(["text"] if "text" in laid.columns else []))
    words = F.col("size") * F.col("copies")
    rows = laid.select("*", (F.sum(words).over(within) - words).alias("here"), F.row_number().over(within).alias("n"))
    per = laid.groupBy("skey", "bucket").agg(F.sum(words).alias("w"))
    before = per.select("skey", "bucket", (F.sum("w").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("w")).alias("before"))
    at = rows.join(written(before, "mix-buckets"), ["skey", "bucket"]).join(sources.select("skey", "no"), "skey")
    each = at.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    each = each.withColumn("from", F.col("before") + F.col("here") + F.col("copy") * F.col("size")).withColumn("row", F.struct("bucket", "n", "copy"))
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("from") + F.col("size") - 1) / block_words)))
    each = each.select("*", F.explode_outer(blocks).alias("block"))
    first = F.greatest(F.col("block") * block_words, F.col("from")) - F.col("from")
    last = F.least((F.col("block") + 1) * block_words, F.col("from") + F.col("size")) - F.col("from")
    return each.select("no", "block", "row", "doc_id", "size", "from", *(["text"] if "text" in laid.columns else []), first.alias("first_word"), (last - first).alias("n_words"))


@dataclass(frozen=True)
class Mix:
    """sources: one row a source with its target. slots: the source and block of each slot of each shard.
    parts: the parts of documents that blocks hold."""

    sources: DataFrame
    slots: DataFrame
    parts: DataFrame

    def documents(self) -> DataFrame:
        """doc_id, size, source_size, target and taken of every document."""
        times = self.slots.groupBy("no", "block").agg(F.count("*").alias("times"))
        taken = self.parts.join(times, ["no", "block"], "left").groupBy("no", "row", "doc_id", "size").agg(F.coalesce(F.sum(F.col("n_words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
        return taken.join(self.sources.select("no", "source_size", "target"), "no").select("doc_id", "size", "source_size", "target", "taken")

    def texts(self) -> DataFrame:
        """shard, slot, source and text of every slot: the words of its block, joined by a space. A block's parts, and no
        others, meet in one row."""
        words = F.slice(F.regexp_extract_all("text", F.lit(f"[^{SPACES}]+"), F.lit(0)), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
        parts = self.parts.filter("n_words > 0").select("no", "block", F.struct("from", F.concat_ws(" ", words).alias("text")).alias("part"))
        blocks = parts.groupBy("no", "block").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"])).alias("text"))
        source = F.when(F.col("skey") != "t", F.substr("skey", F.lit(2)))
        return self.slots.join(blocks, ["no", "block"]).join(self.sources.select("no", source.alias("source")), "no").select("shard", "slot", "source", "text")


def mix(docs: DataFrame, weights: DataFrame, *, percent: int = 150, cap: int = 2, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, text: bool = False) -> Mix:
    """Mixes docs so that sources share percent of all words by weights (skey, weight; see cycled_weights), none taken more
    than cap times. With text, the blocks' texts can be had."""
    laid = lay_out(docs, text)
    sources = numbered(source_targets(laid, weights, percent, cap), block_words, cap)
    return Mix(sources, written(placed(sources, shard_slots, cap), "mix-slots"), segments(laid, sources, block_words))
