"""Reports as ordered lines: findings, requirement blocks, checklist rows, colours, and what a preview counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T


def findings(statuses: DataFrame, snippets: DataFrame) -> DataFrame:
    """Status of each requirement with its strength, review flag and citations (five at most, by pos)."""
    key = ["session", "requirement_id"]
    # ranks limit each task's rows before they are dealt out, so that a large group is never gathered
    first = snippets.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("pos", "citation"))).filter("rank <= 5")
    cites = first.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "citation"))), lambda x: x["citation"]).alias("citations"))
    documents = snippets.groupBy(*key).agg(F.count_distinct("document_id").alias("n_documents"))
    out = statuses.join(cites, key, "left").join(documents, key, "left")
    c = F.col("confidence")
    return out.select(
        "session", "requirement_id", "status", "confidence", "n_snippets", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"),
        F.when(F.col("status") == "missing", "none").when(c >= 0.8, "strong").when(c >= 0.5, "partial").otherwise("limited").alias("strength"),
        (F.col("status").isin("partial", "missing", "flagged") | (c < 0.8)).alias("review"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
    )


def fixed(x: Column, digits: int) -> Column:
    """Decimal text rounded half to even."""
    return F.bround(x.cast("decimal(20,10)"), digits).cast(f"decimal(20,{digits})").cast("string")


def requirement_block(*, detailed: bool = False) -> Column:
    """The lines of a requirement's block, of the columns of findings and title; detailed ones have confidence and summary
    too, and all of citations in one line."""
    c, percent = F.col("citations"), F.concat(fixed(100 * F.col("confidence"), 0), F.lit("%"))
    more = F.concat(F.lit("(and "), (F.size(c) - 3).cast("string"), F.lit(" more)"))
    cites = F.concat(F.lit("**Citations:** "), F.concat_ws(", ", F.slice(c, 1, 3)))
    head = [
        F.concat(F.lit("### "), F.col("requirement_id"), F.lit(": "), F.substring("title", 1, 80), F.when(F.length("title") > 80, "...").otherwise("")),
        F.concat(F.lit("**Status:** "), F.initcap("status")),
    ]
    evidence = F.concat(F.lit("**Evidence:** "), F.col("n_snippets").cast("string"), F.lit(" snippet(s) from "), F.col("n_documents").cast("string"), F.lit(" document(s)"))
    if detailed:
        confidence = F.concat(F.lit("**Confidence:** "), fixed(F.col("confidence"), 2), F.lit(" ("), percent, F.lit(")"))
        one_line = F.when(F.size(c) > 3, F.concat(cites, F.lit(" "), more)).otherwise(cites)
        lines = [*head, confidence, evidence, F.concat(F.lit("**Summary:** "), evidence_summary()), F.when(F.size(c) > 0, one_line)]
    else:
        lines = [*head, evidence, F.when(F.size(c) > 0, cites), F.when(F.size(c) > 3, F.concat(F.lit("  "), more))]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def evidence_summary() -> Column:
    c, n = F.col("confidence"), F.col("n_documents").cast("string")
    return (
        F.when(c >= 0.8, F.concat(F.lit("Strong evidence found across "), n, F.lit(" document(s)")))
        .when(c >= 0.5, F.concat(F.lit("Partial evidence found in "), n, F.lit(" document(s)"))).otherwise("Limited or no evidence found")
    )


def requirement_lines(found: DataFrame) -> DataFrame:
    """The lines of each requirement's block, with their places."""
    return found.select("session", "requirement_id", F.posexplode(requirement_block()).alias("line_no", "line"))


def check_lines(checks: DataFrame) -> DataFrame:
    label = F.when(F.col("status") == "pass", "PASS:").when(F.col("status") == "warning", "WARNING:").when(F.col("status") == "fail", "FAIL:").otherwise("")
    line = F.concat(F.lit("- **"), label, F.lit("**"), F.when(F.col("flagged"), " [Review]").otherwise(""), F.lit(" "), F.col("field_name"))
    return checks.select("session", "check_type", line.alias("line"))


def approved_symbol(status: Column, confidence: Column) -> Column:
    return F.when((status == "covered") & (confidence >= 0.8), "✓").when(status == "missing", "✗").otherwise("⚠")


def status_color(status: Column, confidence: Column, review: Column) -> Column:
    return (
        F.when(review & (status != "covered"), "purple").when((status == "covered") & (confidence >= 0.8), "green")
        .when((status == "partial") | ((confidence >= 0.5) & (confidence < 0.8)), "orange").when((status == "missing") | (confidence < 0.5), "red").otherwise("blue")
    )


def checklist_rows(found: DataFrame) -> DataFrame:
    """One Markdown row of six cells for each finding."""
    cell = lambda x: T.escape_cell(F.coalesce(x, F.lit("")))
    cells = [cell(F.col("category")), cell(F.col("title")), cell(F.col("requirement_id")), cell(F.concat_ws("; ", "citations")), approved_symbol(F.col("status"), F.col("confidence")), F.initcap("status")]
    return found.select("session", "requirement_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def preview_counts(statuses: DataFrame) -> DataFrame:
    """Counts of a preview; what is neither covered nor partial is missing."""
    s = F.col("status")
    covered, n = F.count_if(s == "covered"), F.count("*")
    return statuses.groupBy("session").agg(n.alias("total"), covered.cast("long").alias("covered"), F.count_if(s == "partial").cast("long").alias("partial"), (n - covered - F.count_if(s == "partial")).cast("long").alias("missing"), F.bround(100 * covered / n, 0).cast("long").alias("percent"))


def report_text(lines: DataFrame) -> DataFrame:
    """The text of each session's report from (session, section, requirement_id, line_no, line); a report is one value."""
    at = F.struct("section", "requirement_id", "line_no", "line")
    return lines.groupBy("session").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(at)), lambda x: x["line"])).alias("text"))
