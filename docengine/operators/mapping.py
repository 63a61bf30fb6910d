"""Requirements mapped to documents by expected classes, and what the mapping covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import text as T


def expected_classes(category: Column, evidence: Column) -> Column:
    """The first category key contained, else the first evidence rule, else project plans."""
    array = lambda xs: F.array(*(F.lit(x) for x in xs))
    category, evidence, out = F.lower(category), F.lower(evidence), None
    for key, classes in C.EXPECTED_CLASSES:
        out = F.when(category.contains(key), array(classes)) if out is None else out.when(category.contains(key), array(classes))
    for words, classes in C.EVIDENCE_CLASSES:
        out = out.when(T.contains_any(evidence, words), array(classes))
    return out.otherwise(array(C.DEFAULT_CLASSES))


def map_requirements(requirements: DataFrame, docs: DataFrame) -> DataFrame:
    """session, requirement_id, status, confidence, n_documents and the first documents of each requirement.

    Requirements are a fixed checklist, so they are broadcast; documents are counted by class first, so only counts and
    the first documents of a class by pos take part in the join."""
    classes = docs.groupBy("session", "classification").agg(F.count("*").alias("n"), F.min_by("document_id", "pos").alias("first_document"))
    wanted = requirements.select("requirement_id", F.posexplode(expected_classes(F.col("category"), F.col("accepted_evidence"))).alias("class_pos", "classification"))
    sessions = docs.select("session").distinct().join(F.broadcast(requirements.select("requirement_id")))
    hits = classes.join(F.broadcast(wanted), "classification").groupBy("session", "requirement_id").agg(F.sum("n").alias("n_documents"), F.min_by("first_document", "class_pos").alias("first_document"))
    plans = classes.filter("classification = 'project_plan'").select("session", F.col("first_document").alias("plan"))
    out = sessions.join(hits, ["session", "requirement_id"], "left").join(plans, "session", "left")
    n = F.coalesce("n_documents", F.lit(0))
    return out.select(
        "session", "requirement_id",
        F.when(n > 0, n).when(F.col("plan").isNotNull(), 1).otherwise(0).cast("long").alias("n_documents"),
        F.coalesce("first_document", "plan").alias("first_document"),
        F.when((n > 0) | F.col("plan").isNotNull(), "suggested").otherwise("unmapped").alias("mapping_status"),
        F.when(n == 1, 0.85).when(n > 1, 0.75).when(F.col("plan").isNotNull(), 0.50).otherwise(0.0).alias("confidence"),
    )


def mapping_summary(mappings: DataFrame) -> DataFrame:
    """Coverage and confidence bands of each session; a null confidence counts as 0."""
    c = F.coalesce("confidence", F.lit(0.0))
    count = lambda x: F.count_if(x).cast("long")
    mapped = count(F.col("mapping_status") != "unmapped")
    return mappings.groupBy("session").agg(
        F.count("*").alias("total"), mapped.alias("mapped"), count(F.col("mapping_status") == "confirmed").alias("confirmed"), count(F.col("mapping_status") == "unmapped").alias("unmapped"),
        (mapped / F.count("*")).alias("coverage_rate"), count(c > 0.75).alias("high"), count((c >= 0.5) & (c <= 0.75)).alias("medium"), count((c > 0) & (c < 0.5)).alias("low"),
        count((F.col("mapping_status") == "unmapped") | (c < 0.75)).alias("attention"),
    )


def mapping_icon(status: Column, confidence: Column) -> Column:
    """A mark for a mapping: confirmed, by hand, unmapped, or suggested with more or less confidence."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(status == "confirmed", "✓").when(status == "unmapped", "✗").when(c > 0.75, "●").when(c >= 0.5, "○").otherwise("◌")


def is_ready(summary: DataFrame) -> DataFrame:
    """Whether nothing is left to map: all confirmed, or all confirmed or suggested with none unmapped."""
    return summary.withColumn("ready", (F.col("confirmed") == F.col("total")) | (F.col("unmapped") == 0))


def matrix(mappings: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each mapping and document of its session, the cell a mark if mapped, else a dot. The result itself has
    that many rows; sessions bound the product."""
    cells = mappings.join(docs.select("session", "document_id"), "session")
    hit = pairs.withColumn("hit", F.lit(True))
    cells = cells.join(hit, ["session", "requirement_id", "document_id"], "left")
    return cells.select("session", "requirement_id", "document_id", F.when(F.col("hit"), mapping_icon(F.col("mapping_status"), F.col("confidence"))).otherwise("·").alias("cell"))


def latest_mappings(events: DataFrame) -> DataFrame:
    """State of each mapping after confirmations and removals: the last event by seq wins."""
    last = events.groupBy("session", "requirement_id").agg(F.max_by("action", "seq").alias("action"))
    return last.select("session", "requirement_id", F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "remove", "unmapped").otherwise("suggested").alias("mapping_status"))
