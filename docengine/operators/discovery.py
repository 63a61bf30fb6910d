"""Document discovery: hashing, identity, first occurrences, classification by file name, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import text as T


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(digest: Column) -> Column:
    return F.concat(F.lit("DOC-"), F.substring(digest, 1, 8))


def scannable(path: Column) -> Column:
    """Files of a known kind with no hidden part in their path."""
    return T.extension(path).isin(*C.SCANNED_EXTENSIONS) & ~path.rlike(r"(^|/)\.")


def classify(path: Column) -> Column:
    """Class, confidence and method from the file name: the first pattern that fits, else the extension's class."""
    name = F.lower(T.basename(path))
    row = lambda label, confidence, method: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    out = None
    for label, confidence, pattern in C.FILENAME_CLASSES:
        test, value = name.rlike(pattern), row(label, confidence, "filename")
        out = F.when(test, value) if out is None else out.when(test, value)
    for extensions, label, confidence in ((C.GIS_EXTENSIONS, "gis_shapefile", 0.80), (C.IMAGE_EXTENSIONS, "land_cover_map", 0.70), (C.SPREADSHEET_EXTENSIONS, "spreadsheet_data", 0.75)):
        out = out.when(T.extension(name).isin(*extensions), row(label, confidence, "file_type"))
    return out.otherwise(row("unknown", 0.50, "default"))


def first_occurrences(docs: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with whether it is the first of its key by order. The first is found by a partial minimum and joined back,
    so a key that many rows share does not gather in one task."""
    heads = docs.groupBy(key).agg(F.min(order).alias("__first"))
    return docs.join(heads, key).withColumn("is_first", F.col(order) == F.col("__first")).drop("__first")


def class_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("classification").agg(F.count("*").alias("n_documents"))


def text_quality(text: Column, pages: Column) -> Column:
    """Why an extraction is rejected; null if it is good."""
    readable = F.length(F.regexp_replace(text, r"[^\p{L}\p{N} ]", ""))
    return F.when(pages == 0, "no pages").when(F.length(text) < 100, "too short").when(readable < 0.7 * F.length(text), "unreadable")


def needs_ocr(text: Column, image_blocks: Column) -> Column:
    return (F.length(F.regexp_replace(text, r"\s", "")) < 50) & (image_blocks > 0)


def overlap_share(files: DataFrame, a: str, b: str) -> DataFrame:
    """Share of the distinct hashes of session a that session b has too, from columns session and content_hash."""
    own = files.filter(F.col("session") == a).select("content_hash").distinct()
    other = files.filter(F.col("session") == b).select("content_hash").distinct()
    hit = own.join(other.withColumn("hit", F.lit(1)), "content_hash", "left")
    return hit.agg(F.count("*").alias("n_hashes"), F.count("hit").alias("n_shared"))


def best_text(texts: DataFrame, preference: str = "best") -> DataFrame:
    """document_id and text by quality: the high-quality text if preferred and there, else the fast one."""
    wide = texts.groupBy("document_id").agg(*(F.max(F.when(F.col("quality") == q, F.col("text"))).alias(q) for q in ("hq", "fast")))
    return wide.select("document_id", (F.coalesce("hq", "fast") if preference == "best" else F.col(preference)).alias("text"))


def upload_name(name: Column) -> Column:
    """The last part of a path; null if nothing is left or it is hidden."""
    base = F.trim(T.basename(name))
    return F.when((base != "") & ~base.startswith("."), base)


def split_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads by pos with why they are dropped: a file name or a content seen before; null if kept."""
    name = Window.partitionBy("session", "filename").orderBy("pos")
    kept = uploads.withColumn("__n", F.row_number().over(name))
    content = Window.partitionBy("session", "content_hash", F.col("__n") == 1).orderBy("pos")
    kept = kept.withColumn("__c", F.row_number().over(content))
    return kept.withColumn("dropped", F.when(F.col("__n") > 1, "filename").when(F.col("__c") > 1, "content")).drop("__n", "__c")
