"""Whole reports of many sessions in one plan: Markdown, JSON, a filled checklist, and the parts of a DOCX or PDF file.

projects has a row for each session: session, project_name, project_id, methodology, reviewed_at (yyyy-MM-dd HH:mm:ss),
crediting_period, proponent, documents (array of names). found are findings with category and title; checks have session,
check_type, status, flagged and message. A report is one value: it holds a checklist's requirements and a session's checks.
Nulls among a project's values are left out or empty; a session without findings has counts of nought; findings and checks
of a session that projects lacks are in no report; of equal messages each has its line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import text as T
from docengine.operators import casework
from docengine.operators import report as R

STATUSES = ("covered", "partial", "missing", "flagged")


def totals(projects: DataFrame, found: DataFrame, checks: DataFrame) -> DataFrame:
    """Counts of each session of projects: requirements by status, checks by status, snippets, rows to review."""
    of = lambda x: F.count_if(x).cast("long")
    s = F.col("status")
    a = found.groupBy("session").agg(F.count("*").alias("total"), *(of(s == k).alias(k) for k in STATUSES), F.sum("n_snippets").cast("long").alias("snippets"), of(F.col("review")).alias("to_review"))
    b = checks.groupBy("session").agg(F.count("*").alias("n_checks"), of(s == "pass").alias("passed"), of(s == "warning").alias("warnings"), of(s == "fail").alias("failed"))
    out = projects.join(a, "session", "left").join(b, "session", "left").fillna(0, ["total", *STATUSES, "snippets", "to_review", "n_checks", "passed", "warnings", "failed"])
    n = F.when(F.col("total") > 0, F.col("total"))
    return out.withColumn("overall", F.coalesce((F.col("covered") + 0.5 * F.col("partial")) / n, F.lit(0.0))).withColumn("n_documents", F.greatest(F.size(F.coalesce("documents", F.array().cast("array<string>"))), F.lit(0)))


def _field(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{label}:** "), value.cast("string"))


def _head() -> Column:
    share = lambda k: F.concat(F.col(k).cast("string"), F.lit(" ("), R.fixed(F.coalesce(100 * F.col(k) / F.nullif("total", F.lit(0)), F.lit(0.0)), 1), F.lit("%)"))
    checked = lambda x: F.when(F.col("n_checks") > 0, x)
    text = lambda k: F.coalesce(k, F.lit(""))
    lines = [
        F.lit("# Registry Agent Review"), F.lit(""), F.lit("## Project Metadata"), _field("Project Name", text("project_name")), _field("Project ID", F.nullif("project_id", F.lit(""))),
        _field("Methodology", text("methodology")), _field("Review Date", F.concat(text("reviewed_at"), F.lit(" UTC"))), F.lit(""), F.lit("## Summary"), F.lit(""), F.lit("### Requirements Coverage"),
        _field("Total Requirements", F.col("total")), _field("Covered", share("covered")), _field("Partial", share("partial")), _field("Missing", share("missing")),
        _field("Overall Coverage", F.concat(R.fixed(100 * F.col("overall"), 1), F.lit("%"))), F.lit(""), checked(F.lit("### Cross-Document Validation")), checked(_field("Total Checks", F.col("n_checks"))),
        checked(_field("Passed", F.col("passed"))), checked(_field("Warnings", F.col("warnings"))), checked(_field("Failed", F.col("failed"))), checked(F.lit("")), F.lit("### Review Statistics"),
        _field("Documents Reviewed", F.col("n_documents")), _field("Evidence Snippets Extracted", F.col("snippets")), _field("Items Requiring Human Review", F.col("to_review")), F.lit(""),
    ]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def review_item() -> Column:
    return F.concat("requirement_id", F.lit(": "), F.substring("title", 1, 80), F.lit("... (Status: "), "status", F.lit(", Confidence: "), R.fixed(F.col("confidence"), 2), F.lit(")"))


def _numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def _sorted(value: Column, *by: str) -> Column:
    """value of all rows of a group, in the order of by."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*by, value.alias("v")))), lambda x: x["v"])


def markdown_texts(projects: DataFrame, found: DataFrame, checks: DataFrame, *, detailed: bool = False) -> DataFrame:
    """(session, text): head, requirements by status in the order of their ids, checks by type in the order of their
    messages, what a person has to look at, next steps."""
    kept = lambda df: df.join(projects.select("session"), "session", "left_semi")
    found, checks = kept(found), kept(checks)
    place = F.array_position(F.array(*(F.lit(s) for s in STATUSES)), F.col("status")).cast("int")
    title = F.element_at(F.array(*(F.lit(f"## {t}") for t in C.STATUS_TITLES)), place)
    blank = F.array(F.lit(""))
    blocks = found.filter(place > 0).groupBy("session", place.alias("section")).agg(F.concat(F.array(F.first(title), F.lit("")), F.flatten(_sorted(F.concat(R.requirement_block(detailed=detailed), blank), "requirement_id"))).alias("lines"))
    by_type = R.check_lines(checks.withColumn("field_name", F.col("message"))).groupBy("session", "check_type").agg(F.sort_array(F.collect_list("line")).alias("ls"))
    heads = F.create_map(*(F.lit(x) for kv in C.CHECK_TITLES for x in kv))
    typed = F.concat(F.array(F.concat(F.lit("### "), F.coalesce(heads[F.col("check_type")], F.initcap(F.replace("check_type", F.lit("_"), F.lit(" "))))), F.lit("")), F.col("ls"), blank)
    results = by_type.groupBy("session").agg(F.concat(F.array(F.lit("## Cross-Document Validation Results"), F.lit("")), F.flatten(_sorted(typed, "check_type")), blank).alias("lines"))
    items = found.filter("review").groupBy("session").agg(F.concat(F.array(F.lit("## Items Requiring Human Review"), F.lit("")), _numbered(_sorted(review_item(), "requirement_id")), blank).alias("lines"))
    steps = F.array(F.lit("## Next Steps"), F.lit(""), *(F.lit(f"{i}. {s}") for i, s in enumerate(C.NEXT_STEPS, 1)), F.lit(""))
    parts = totals(projects, found, checks).select("session", F.lit(0).alias("section"), _head().alias("lines")).unionByName(blocks)
    for i, df in ((5, results), (6, items), (7, projects.select("session", steps.alias("lines")))):
        parts = parts.unionByName(df.select("session", F.lit(i).alias("section"), "lines"))
    return parts.groupBy("session").agg(F.array_join(F.flatten(_sorted(F.col("lines"), "section")), "\n").alias("text"))


def json_texts(projects: DataFrame, found: DataFrame, checks: DataFrame) -> DataFrame:
    """(session, text): the same as one object with metadata, summary, requirements, validations and next steps."""
    kept = ["requirement_id", "title", "category", "status", "confidence", "n_documents", "n_snippets", "citations", "review"]
    reqs = found.groupBy("session").agg(_sorted(F.struct(*kept, R.evidence_summary().alias("evidence_summary")), "requirement_id").alias("requirements"), F.filter(_sorted(F.when(F.col("review"), review_item()), "requirement_id"), lambda x: x.isNotNull()).alias("items_for_review"))
    done = checks.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("check_type", "message", "status", "flagged"))).alias("validations"))
    t = totals(projects, found, checks).join(reqs, "session", "left").join(done, "session", "left")
    meta = F.struct("project_name", "project_id", "methodology", "reviewed_at")
    counts = F.struct("total", *STATUSES, "overall", "n_checks", "passed", "failed", "warnings", "n_documents", "snippets", "to_review")
    none = lambda k: F.coalesce(k, F.array()).alias(k)
    whole = F.struct("session", meta.alias("metadata"), counts.alias("summary"), none("requirements"), none("validations"), none("items_for_review"), F.array(*(F.lit(s) for s in C.NEXT_STEPS)).alias("next_steps"))
    return t.select("session", F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("text"))


def checklist_cells(found: DataFrame, snippets: DataFrame, projects: DataFrame) -> DataFrame:
    """The six cells of each requirement's row, with the colours of the last two: category, title, summary of evidence,
    submitted material, symbol, comments (one a line). snippets have value, citation and text by pos."""
    wanted = found.select("session", "requirement_id").join(projects.select("session", "project_id"), "session")
    cells = found.join(casework.material_cells(snippets, wanted), ["session", "requirement_id"])
    comments = F.array(F.concat(F.lit("Confidence: "), R.fixed(100 * F.col("confidence"), 0), F.lit("%")), F.concat(F.lit("Evidence: "), F.nullif("evidence", F.lit(""))), F.when(F.col("review"), "Human review needed"))
    sign = R.approved_symbol(F.col("status"), F.col("confidence"))
    return cells.select(
        "session", "requirement_id", "category", "title", R.evidence_summary().alias("summary"), "material", sign.alias("sign"), F.array_join(comments, "\n").alias("comments"),
        F.when(sign == "✓", "green").when(sign == "✗", "red").otherwise("orange").alias("sign_color"), R.status_color(F.col("status"), F.col("confidence"), F.col("review")).alias("color"),
    )


def checklist_texts(template: str, counts: DataFrame, cells: DataFrame, agent: str = "AI-assisted review") -> DataFrame:
    """(session, text): the template with its header filled and the rows of its table in place of what follows the table's
    head; counts are the rows of totals. A template without the table's head is an error."""
    if C.CHECKLIST_MARKER not in template:
        raise ValueError("the checklist template has no table of requirements")
    head = template.split(C.CHECKLIST_MARKER, 1)[0]
    for pattern, to in C.CHECKLIST_CLEANUP:
        head = re.sub(pattern, to, head, flags=re.M)
    cell = lambda k: T.escape_cell(F.coalesce(k, F.lit("")))
    short = F.concat(F.substring("title", 1, 100), F.when(F.length("title") > 100, "...").otherwise(""))
    row = F.concat(F.lit("| "), F.array_join(F.array(cell(F.col("category")), cell(short), cell(F.col("summary")), cell(F.col("material")), F.col("sign"), cell(F.replace("comments", F.lit("\n"), F.lit("<br>")))), " | "), F.lit(" |"))
    rows = cells.groupBy("session").agg(_sorted(row, "requirement_id").alias("rows"))
    names, overall = F.coalesce("documents", F.array().cast("array<string>")), F.col("overall")
    listed = F.when(F.size(names) > 0, F.concat(F.size(names).cast("string"), F.lit(" document(s): "), F.array_join(names, ", "))).otherwise("0 documents")
    n, total = F.col("covered").cast("string"), F.col("total").cast("string")
    told = F.when((100 * overall >= 80) & (F.col("failed") == 0), F.concat(F.lit("All "), n, F.lit(" requirements covered ("), R.fixed(100 * overall, 0), F.lit("% coverage)."))).otherwise(F.concat(n, F.lit("/"), total, F.lit(" requirements covered.")))
    values = {
        "project_name": cell(F.col("project_name")), "project_id": F.coalesce("project_id", F.lit("C06-___")), "crediting_period": cell(F.coalesce("crediting_period", F.lit("_Not specified_"))), "date": F.substring(F.coalesce("reviewed_at", F.lit("")), 1, 10),
        "agent": F.lit(agent), "documents": listed, "outcome": casework.outcome(overall, F.col("failed")), "told": told,
    }
    text = F.lit(head)
    for found, before, key, after in C.CHECKLIST_SLOTS:
        text = F.replace(text, F.lit(found), F.concat(F.lit(before), values[key], F.lit(after)))
    table = F.array_join(F.concat(F.array(*(F.lit(x) for x in C.CHECKLIST_HEAD)), F.coalesce("rows", F.array().cast("array<string>"))), "\n")
    end = F.concat(F.lit("\n\n---\n*Generated on "), F.coalesce("reviewed_at", F.lit("")), F.lit(" UTC*\n"))
    return counts.join(rows, "session", "left").select("session", F.concat(text, table, end).alias("text"))
