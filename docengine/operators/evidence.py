"""Evidence: requirement status and coverage, first snippets, merges and filters of extracted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import text as T


def requirement_status(requirements: DataFrame, snippets: DataFrame, *, gate_schema_match: bool = False) -> DataFrame:
    """Covered above a confidence of 0.8, partial below, missing without snippets, for each session and requirement."""
    used = snippets.filter("schema_match") if gate_schema_match else snippets
    found = used.groupBy("session", "requirement_id").agg(F.count("*").alias("n_snippets"), F.max("confidence").alias("best"))
    every = snippets.select("session").distinct().join(F.broadcast(requirements.select("requirement_id")))
    out = every.join(found, ["session", "requirement_id"], "left")
    return out.select(
        "session", "requirement_id", F.coalesce("n_snippets", F.lit(0)).cast("long").alias("n_snippets"), F.coalesce("best", F.lit(0.0)).alias("confidence"),
        F.when(F.col("n_snippets").isNull(), "missing").when(F.col("best") > 0.8, "covered").otherwise("partial").alias("status"),
    )


def coverage(statuses: DataFrame) -> DataFrame:
    """Counts by status and the overall share, a partial one as half."""
    count = lambda s: F.count_if(F.col("status") == s).cast("long")
    return statuses.groupBy("session").agg(
        F.count("*").alias("total"), count("covered").alias("covered"), count("partial").alias("partial"), count("missing").alias("missing"),
        ((count("covered") + 0.5 * count("partial")) / F.count("*")).alias("overall"),
    )


def first_snippets(snippets: DataFrame, n: int) -> DataFrame:
    """The first n snippets of each requirement by pos."""
    w = Window.partitionBy("session", "requirement_id").orderBy("pos")
    return snippets.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def evidence_matrix(requirements: DataFrame, statuses: DataFrame, snippets: DataFrame) -> DataFrame:
    """Status with validation type and the first snippet's text, cut at 300."""
    first = snippets.groupBy("session", "requirement_id").agg(F.min_by("text", "pos").alias("text"), F.min_by("document_id", "pos").alias("document_id"))
    kinds = F.broadcast(requirements.select("requirement_id", "validation_type"))
    out = statuses.join(first, ["session", "requirement_id"], "left").join(kinds, "requirement_id", "left")
    auto = F.coalesce(F.col("validation_type").isin("document_presence", "cross_document", "structured_field", "date_alignment"), F.lit(False))
    return out.select("session", "requirement_id", "status", F.coalesce("validation_type", F.lit("manual")).alias("validation_type"), F.substring("text", 1, 300).alias("snippet"), "document_id", auto.alias("auto_validatable"))


def routed_snippets(snippets: DataFrame, n: int = 5) -> DataFrame:
    """The first n snippets of the requirements that each kind of field is read from."""
    routes = [(kind, r) for kind, reqs in C.FIELD_SOURCES for r in reqs]
    table = snippets.sparkSession.createDataFrame(routes, "kind string, requirement_id string")
    return first_snippets(snippets.join(F.broadcast(table), "requirement_id"), n)


def merge_best(fields: DataFrame) -> DataFrame:
    """For each session and field the value of the most confident row, of equal ones the first by pos, and the greatest
    value_type where the rows have one: one aggregation."""
    key = F.struct((-F.coalesce("confidence", F.lit(0.5))).alias("c"), F.col("pos"))
    kind = [F.max("value_type").alias("value_type")] if "value_type" in fields.columns else []
    return fields.groupBy("session", "field_name").agg(F.min_by(F.struct("value"), key)["value"].alias("value"), F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"), *kind)


def merge_by_document(fields: DataFrame) -> DataFrame:
    """For each session, document and field the first value that is not null. Groups are in order of session and field, as
    checks across documents need them."""
    doc = F.coalesce("document_id", "document_name", F.lit("unknown")).alias("document")
    out = fields.filter(F.col("value").isNotNull()).groupBy("session", "field_name", doc).agg(F.min_by("value", "pos").alias("value"))
    return out.select("session", "document", "field_name", "value")


def last_by_document(fields: DataFrame) -> DataFrame:
    """For each document and field the last value; the document's first field sets its confidence. One aggregation by field,
    and a window over a document's fields. Rows without session or document are left out."""
    known = fields.filter("session IS NOT NULL AND document_id IS NOT NULL")
    last = known.groupBy("session", "document_id", "field_name").agg(F.max_by("value", "pos").alias("value"), F.min_by("confidence", "pos").alias("c"), F.min("pos").alias("first"))
    document = Window.partitionBy("session", "document_id")
    return last.select("session", "document_id", "field_name", "value", F.min_by("c", "first").over(document).alias("confidence"))


def dedup_values(fields: DataFrame) -> DataFrame:
    """Each value of a field once, with its most confident row, of equal ones the first by pos."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "pos", "document_id"))
    return fields.groupBy("session", "field_name", "value").agg(best.alias("b")).select("session", "field_name", "value", (-F.col("b.c")).alias("confidence"), F.col("b.document_id").alias("document_id"))


def valid_project_id(value, raw_text):
    """Whether a found project id is one: not a bare number or a file name, and of a registry's form or called an id."""
    v, raw = T.full_trim(F.coalesce(value, F.lit(""))), F.lower(F.coalesce(raw_text, F.lit("")))
    bad = (v == "") | v.rlike(r"^\d+$") | v.rlike(f"^{C.ALTERNATIVE_ID}$") | T.contains_any(raw, C.FILENAME_CONTEXT)
    return ~bad & (v.rlike(f"^({C.REGISTRY_ID})$") | raw.contains("project id"))


def fuzzy_owners(fields: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Owner names of a document, in order of pos, then of value. Each is held against the names that stand: if the most
    similar one, the first of equal ones, has the threshold, the more confident of the two stands, else both. A name that
    takes another's place stands last. A document's names are one group; a name's repeats count once, at the first place and
    with the highest confidence, so they don't add to it. Null names are left out."""
    import pandas as pd

    from docengine.functions.fuzzy import OwnerNames

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "value"]).reset_index(drop=True)
        names, confidence = OwnerNames(pdf["value"].tolist()), pdf["confidence"].tolist()
        standing: dict[int, None] = {}
        for i in range(len(pdf)):
            match = names.best(i, list(standing), threshold) if standing else None
            if match is None:
                standing[i] = None
            elif confidence[i] > confidence[match]:
                del standing[match]
                standing[i] = None
        return pdf.iloc[list(standing)]

    names = fields.filter("value IS NOT NULL").groupBy("session", "document_id", "value").agg(F.max("confidence").alias("confidence"), F.min("pos").alias("pos"))
    return names.groupBy("session", "document_id").applyInPandas(run, names.schema)
