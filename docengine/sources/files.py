"""Project files as tables: discovery with hashes and metadata, checklists, session state, text sidecars."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions import text as X
from docengine.operators import discovery
from docengine.sources.workbooks import count_sheets

CHECKLIST = T.StructType(
    [
        T.StructField("methodology_id", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("requirements", T.ArrayType(T.StructType([
            T.StructField(n, T.BooleanType() if n == "mandatory" else T.StringType())
            for n in ("requirement_id", "category", "requirement_text", "source", "accepted_evidence", "mandatory", "validation_type", "scope")
        ]))),
    ]
)

SESSION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("session_id", "created_at", "updated_at", "status")]
    + [T.StructField("project_metadata", T.StructType([T.StructField(n, T.StringType()) for n in ("project_name", "project_id", "methodology", "documents_path")])),
       T.StructField("workflow_progress", T.MapType(T.StringType(), T.StringType())), T.StructField("statistics", T.MapType(T.StringType(), T.StringType())),
       T.StructField("document_sources", T.ArrayType(T.StructType([T.StructField("source_type", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])))]
)


def read_checklist(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """Rows of a checklist file; scope picks those of one scope."""
    rows = spark.read.schema(CHECKLIST).option("multiLine", True).json(path).select("methodology_id", F.explode("requirements").alias("r")).select("methodology_id", "r.*")
    return rows if scope is None else rows.filter(F.col("scope") == scope)


def discover(spark: SparkSession, path: str, session: str) -> DataFrame:
    """Documents under a folder: hash, id, class, size and time, in path order; later files of equal content are marked.
    File contents are hashed where they are read and not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.expr("substring(path, length(input_root) + 1)")
    named = files.withColumn("input_root", F.regexp_extract("path", "^(.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/)", 1)).withColumn("relative", relative)
    kept = named.filter(discovery.scannable(F.col("relative")))
    digest = discovery.content_hash(F.col("content"))
    docs = kept.select(F.lit(session).alias("session"), "path", X.basename(F.col("path")).alias("filename"), digest.alias("content_hash"), F.col("length").alias("size"), "modificationTime", discovery.classify(F.col("path")).alias("c"))
    docs = docs.select("*", discovery.document_id(F.col("content_hash")).alias("document_id"), "c.label", "c.confidence", "c.method").drop("c").withColumnRenamed("label", "classification")
    return discovery.first_occurrences(docs, "content_hash", "path")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session state files below a folder; those that can't be read, or have no id, are left out."""
    rows = spark.read.schema(SESSION).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "session.json").json(path)
    return rows.filter("session_id IS NOT NULL")


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """What a list of sessions shows, newest first; sessions without a time come last."""
    empty = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>")).alias(c)
    rows = read_sessions(spark, path).select(
        "session_id", "project_metadata.project_name", "created_at", "updated_at", "status", "project_metadata.methodology", empty("workflow_progress"), empty("statistics"), "project_metadata",
    )
    return rows.orderBy(F.desc_nulls_last("created_at"), "session_id")


def session_roots(sessions: DataFrame) -> DataFrame:
    """session, kind (upload, path or legacy_path), pos and root: the folders that a session's documents are in, in the order
    in which they are scanned. Other sources have none."""
    s = F.col("s")
    at = F.when(s["source_type"] == "upload", s["metadata"]["directory"]).when(s["source_type"] == "path", s["metadata"]["path"])
    own = sessions.select(F.col("session_id").alias("session"), F.posexplode("document_sources").alias("pos", "s")).select("session", s["source_type"].alias("kind"), "pos", at.alias("root"))
    legacy = sessions.select(F.col("session_id").alias("session"), F.lit("legacy_path").alias("kind"), F.coalesce(F.size("document_sources"), F.lit(0)).alias("pos"), F.col("project_metadata.documents_path").alias("root"))
    return own.union(legacy).filter("root <> ''")


METADATA = "path string, relative string, size long, created timestamp, modified timestamp, content_hash string, page_count int, has_tables boolean, error string"


def file_metadata(path: str, relative: str) -> tuple:
    """Size, times, hash of the content read by small pieces, and for sheets how many there are: of a workbook from its list of
    sheets alone, one of a flat file. A workbook that can't be read has no count and no tables; of a PDF neither is known
    before it is converted."""
    try:
        stat, digest = os.stat(path), hashlib.sha256()
        with open(path, "rb") as f:
            while piece := f.read(4096):
                digest.update(piece)
        ending, sheets, tables = os.path.splitext(path)[1].lower(), None, False
        if ending in (".csv", ".tsv"):
            sheets, tables = 1, True
        elif ending in (".xlsx", ".xls"):
            try:
                with open(path, "rb") as f:
                    sheets, tables = count_sheets(f), True
            except Exception:  # a broken workbook is a document still
                sheets, tables = None, False
        elif ending != ".pdf":
            tables = None
        times = (dt.datetime.fromtimestamp(x, dt.UTC) for x in (stat.st_ctime, stat.st_mtime))
        return (path, relative, stat.st_size, *times, digest.hexdigest(), sheets, tables, None)
    except OSError as e:
        return (path, relative, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])


def discover_sessions(roots: DataFrame) -> DataFrame:
    """The documents of many sessions in one job, from roots (session, kind, pos, root) as session_roots gives them: every root
    is walked by a task of its own choosing among the executors, hidden folders apart, and then every file is read by one.
    Roots that do not exist have no documents; where roots of a session overlap a file counts once, by its first root. Files of
    equal content within a session are marked, the first by root and path being the one that counts. The folders must be
    mounted on all executors, as a path in shared storage is."""
    spread = max(roots.sparkSession.sparkContext.defaultParallelism, 1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for session, kind, pos, root in b.itertuples(index=False):
                found = []
                for folder, inner, names in os.walk(root):
                    inner[:] = sorted(d for d in inner if not d.startswith("."))
                    found += [(session, kind, pos, root, os.path.realpath(f"{folder}/{n}"), os.path.relpath(f"{folder}/{n}", root)) for n in sorted(names)]
                yield pd.DataFrame(found, columns=["session", "kind", "pos", "root", "path", "relative"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(*x, *file_metadata(*x[4:])[2:]) for x in b.itertuples(index=False)]
            yield pd.DataFrame(made, columns=["session", "kind", "pos", "root", "path", "relative", *(c.split()[0] for c in METADATA.split(", ")[2:])]).astype({"page_count": "Int32", "size": "Int64", "has_tables": "boolean"})

    place = "session string, kind string, pos int, root string, "
    walked = roots.select("session", "kind", F.col("pos").cast("int").alias("pos"), "root").repartition(spread, "session", "pos").mapInPandas(walk, f"{place}path string, relative string")
    first = walked.filter(discovery.scannable(F.col("relative"))).groupBy("session", "path").agg(F.min(F.struct("pos", "kind", "root", "relative")).alias("r"))
    files = first.select("session", "r.kind", "r.pos", "r.root", "path", "r.relative").repartition(spread, "path")
    docs = files.mapInPandas(read, place + METADATA).withColumn("filename", X.basename(F.col("path"))).withColumn("c", discovery.classify(F.col("path")))
    docs = docs.select("*", discovery.document_id(F.col("content_hash")).alias("document_id"), F.col("c.label").alias("classification"), "c.confidence", "c.method").drop("c")
    order = Window.partitionBy("session", "content_hash").orderBy("pos", "path")
    return docs.withColumn("is_first", F.col("error").isNull() & (F.row_number().over(order) == 1))


def text_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Extracted texts beside the documents: stem, quality (hq, fast or the plain one) and text."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select("value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"))
    name = X.basename(F.col("path"))
    return t.select("path", F.regexp_replace(name, r"(\.fast|\.hq)?\.md$", "").alias("stem"), F.coalesce(X.found(name, r"\.(fast|hq)\.md$"), F.lit("plain")).alias("quality"), F.col("value").alias("text"))


def pages(texts: DataFrame) -> DataFrame:
    """Pages of extracted texts, split at their page markers."""
    marked = texts.select("path", F.split("text", r"--- Page \d+ ---").alias("parts"), F.regexp_extract_all("text", F.lit(r"--- Page (\d+) ---"), F.lit(1)).alias("numbers"))
    rows = marked.select("path", "parts", F.posexplode("numbers").alias("n", "page"))
    return rows.select("path", F.col("page").cast("int").alias("page"), X.full_trim(F.get("parts", F.col("n") + 1)).alias("text"))
