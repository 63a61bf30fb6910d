"""A cache of computed values with time to live, as Parquet files in a shared folder. Entries are appended and never changed;
the last one of a key counts. Deleting appends an entry without a value; compaction writes what still counts as a new
generation and drops the old ones only when that is complete, so a session lost at any time leaves a readable cache."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key_hash string, key string, value string, cached_at double, ttl long, deleted boolean, at long"
#: Seconds that an entry is valid if nothing else is said: a day.
DAY = 86_400


def key_hash(namespace: str, key: str | Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{namespace}:"), F.col(key) if isinstance(key, str) else key).cast("binary"), 256)


def expired(cached_at: Column, ttl: Column, now: Column) -> Column:
    """Whether more than ttl seconds have passed; without a ttl, or with one of 0, never."""
    return (F.coalesce(ttl, F.lit(0)) != 0) & (now > cached_at + ttl)


@dataclass(frozen=True)
class Cache:
    """Values (JSON texts) by key in a namespace below path."""

    spark: SparkSession
    path: str
    namespace: str = "default"
    ttl: int = DAY

    @property
    def folder(self) -> str:
        return f"{self.path.rstrip('/')}/{self.namespace}"

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _generations(self) -> list[str]:
        """The complete generations of the folder."""
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()]
        return [p.toString() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def entries(self) -> DataFrame:
        parts = self._generations()
        return self.spark.read.schema(ENTRY).parquet(*parts) if parts else self.spark.createDataFrame([], ENTRY)

    def valid(self, now: float | None = None) -> DataFrame:
        """key, value and cached_at of the last entry of every key that is not deleted, expired or corrupt. An entry is corrupt
        if its value is no JSON or its hash is not its key's."""
        last = self.entries().groupBy("key_hash").agg(F.max(F.struct("cached_at", "at", "key", "value", "ttl", "deleted")).alias("e")).select("key_hash", "e.*")
        sound = F.try_parse_json("value").isNotNull() & (F.col("key_hash") == key_hash(self.namespace, "key")) & F.col("cached_at").isNotNull()
        fresh = ~expired(F.col("cached_at"), F.col("ttl"), F.lit(time.time() if now is None else now))
        return last.filter(~F.coalesce("deleted", F.lit(False)) & sound & fresh).select("key", "value", "cached_at")

    def get(self, requests: DataFrame, now: float | None = None) -> DataFrame:
        """requests (key and more) with value, null for a miss."""
        return requests.join(self.valid(now).select("key", "value"), "key", "left")

    def _append(self, rows: DataFrame, name: str = "set") -> None:
        rows.select(*(F.col(c).cast(t) for c, t in (x.split() for x in ENTRY.split(", ")))).write.parquet(f"{self.folder}/{name}-{uuid.uuid4().hex}")

    def set(self, rows: DataFrame, ttl: int | None = None, now: float | None = None) -> None:
        """Adds rows of key and value; a ttl of 0 or None stands for the cache's own."""
        self._append(rows.select(key_hash(self.namespace, "key").alias("key_hash"), "key", "value", F.lit(time.time() if now is None else now).alias("cached_at"), F.lit(ttl or self.ttl).alias("ttl"), F.lit(False).alias("deleted"), F.lit(time.time_ns()).alias("at")))

    def delete(self, keys: DataFrame, now: float | None = None) -> None:
        self._append(keys.select(key_hash(self.namespace, "key").alias("key_hash"), "key", F.lit(None).alias("value"), F.lit(time.time() if now is None else now).alias("cached_at"), F.lit(0).alias("ttl"), F.lit(True).alias("deleted"), F.lit(time.time_ns()).alias("at")), "delete")

    def clear(self) -> int:
        """Deletes all entries of the namespace and says how many keys had valid ones or not."""
        n = self.entries().filter(~F.coalesce("deleted", F.lit(False))).select("key_hash").distinct().count()
        fs, at = self._fs()
        fs.delete(at, True)
        return n

    def get_or_compute(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], ttl: int | None = None, now: float | None = None) -> DataFrame:
        """requests with value: what is cached, and for the rest what compute makes of their distinct keys (one row a key, with
        key and value). Computed values are written before they are read, so each is computed once, and a later call computes
        none of them."""
        missing = requests.join(self.valid(now).select("key"), "key", "left_anti").filter("key IS NOT NULL").dropDuplicates(["key"])
        self.set(compute(missing).select("key", "value"), ttl, now)
        return self.get(requests, now)

    def compact(self, now: float | None = None) -> None:
        """Rewrites the cache without entries that are expired, corrupt, deleted or replaced."""
        old = self._generations()
        last = self.entries().join(self.valid(now).select("key", "cached_at"), ["key", "cached_at"], "left_semi").filter(~F.coalesce("deleted", F.lit(False)))
        best = last.groupBy("key_hash").agg(F.max(F.struct("at", "key", "value", "cached_at", "ttl", "deleted")).alias("e")).select("key_hash", "e.*")
        self._append(best, "compact")
        fs, _ = self._fs()
        for p in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p), True)


def replay(log: DataFrame) -> DataFrame:
    """The outcome of every get in a log of cache calls (namespace, key, seq, at in seconds, call: set, get, delete; ttl, value):
    the value that it finds or null, and whether it is a hit. Many keys' calls are replayed at once, a key's in one window."""
    from pyspark.sql import Window

    before = Window.partitionBy("namespace", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("call") != "get", F.struct("call", "at", "ttl", "value")), ignorenulls=True).over(before)
    found = log.select("namespace", "key", "seq", "call", F.col("at").alias("now"), last.alias("e")).filter("call = 'get'")
    hit = F.coalesce((F.col("e.call") == "set") & ~expired(F.col("e.at"), F.col("e.ttl"), F.col("now")), F.lit(False))
    return found.select("namespace", "key", "seq", hit.alias("hit"), F.when(hit, F.col("e.value")).alias("value"))
