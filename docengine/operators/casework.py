"""Sessions, their documents and what a reviewer sees of them: session state from events, duplicates, unified results,
lookups, text cells and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import text as T
from docengine.functions.fuzzy import ratio_column
from docengine.operators.evidence import first_snippets

ANNOTATIONS = ("note", "question", "concern", "clarification")
PLACEHOLDER = "[No markdown available]"


# sessions


def current_sessions(events: DataFrame, *attributes: str) -> DataFrame:
    """Session state from create, update and delete events: the last value given of each attribute, from the last create
    on; a session that was deleted after that is gone, and one that was never created does not exist."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    born = events.withColumn("born", F.max(F.when(F.col("action") == "create", F.col("seq"))).over(w)).filter("born IS NOT NULL")
    last = born.groupBy("session", "born").agg(F.max(F.col("action") == "delete").alias("gone"), F.max("seq").alias("seq"), *(F.max_by(a, F.when(F.col(a).isNotNull(), F.col("seq"))).alias(a) for a in attributes))
    newest = last.groupBy("session").agg(F.max_by(F.struct("gone", "seq", *attributes), "born").alias("s"))
    return newest.filter("NOT s.gone").select("session", F.col("s.seq").alias("seq"), *(F.col("s")[a].alias(a) for a in attributes))


def added_documents(additions: DataFrame) -> DataFrame:
    """What becomes of each document added to a session: a link is an error, content that the session has already a
    duplicate (kept, with a warning), else it is added."""
    usable = F.col("kind").isin("upload", "path")
    w = Window.partitionBy("session", "content_hash", usable).orderBy("seq")
    return additions.select("session", "seq", F.when(~usable, "error").when(F.row_number().over(w) > 1, "duplicate").otherwise("added").alias("outcome"))


def sessions_from_uploads(uploads: DataFrame) -> DataFrame:
    """For each session of uploads how many files stay after dropping repeats of a name, then of a content; a session with
    an unreadable file is not created and has none."""
    by_name = uploads.groupBy("session", "filename").agg(F.min_by(F.struct("content_hash", "seq"), "seq").alias("f"), F.max("broken").alias("broken"))
    one = by_name.groupBy("session").agg(F.count_distinct("f.content_hash").alias("n"), F.max("broken").alias("broken"))
    return one.select("session", (~F.col("broken")).alias("created"), F.when(F.col("broken"), 0).otherwise(F.col("n")).cast("long").alias("n_documents"))


def normal_path(path: Column) -> Column:
    """Without repeated or trailing slashes and single dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/{2,}", "/"), "(?<=.)/$", "")


def same_directory(sessions: DataFrame) -> DataFrame:
    """The first session of each directory, and how many have it."""
    return sessions.groupBy(normal_path(F.col("path")).alias("path")).agg(F.min_by("session", "seq").alias("session"), F.count("*").alias("n"))


def duplicate_sessions(names: DataFrame, files: DataFrame, *, similarity: float = 0.8, overlap: float = 0.8) -> DataFrame:
    """For each session the first other one of a similar name that has more than overlap of its files by content; names has one
    row a session. Sessions of one name, case apart, and equal files are one class: they have each other, and other classes
    are found for the class. A class that misses so few of another's files has one of any few more of them, so classes meet
    only at that many of the first one's rarest files; each two names are compared once."""
    sets = files.select("session", "content_hash").groupBy("session").agg(F.sort_array(F.collect_set("content_hash")).alias("files"))
    members = names.select("session", F.lower("name").alias("name")).join(sets.filter(F.size("files") > 0), "session")
    classes = members.groupBy("name", "files").agg(F.min("session").alias("class"))
    members = members.join(classes, ["name", "files"]).select("session", "class")
    second = members.filter("session <> class").groupBy("class").agg(F.min("session").alias("second"))

    each = classes.select("class", "name", F.size("files").alias("n"), F.explode("files").alias("content_hash"))
    rarity = each.groupBy("content_hash").agg(F.count("*").alias("classes"))
    w = Window.partitionBy("class").orderBy("classes", "content_hash")
    rare = each.join(rarity, "content_hash").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.floor(F.col("n") * (1 - overlap) + 1e-9) + 1)
    other = each.select(F.col("class").alias("other"), "content_hash", F.col("name").alias("other_name"))
    met = rare.select("class", "name", "n", "content_hash").join(other, "content_hash").filter("class <> other").select("class", "name", "n", "other", "other_name").distinct()
    compared = met.select("name", "other_name").distinct()
    alike = compared.filter(F.col("name") == F.col("other_name")).unionByName(compared.filter(F.col("name") != F.col("other_name")).filter(ratio_column(F.col("name"), F.col("other_name")) >= similarity))
    pairs = met.join(alike, ["name", "other_name"]).select("class", "n", "other")
    shared = pairs.join(each.select("class", "content_hash"), "class").join(other.select("other", "content_hash"), ["other", "content_hash"]).groupBy("class", "other", "n").agg(F.count("*").alias("c"))
    found = shared.filter(F.col("c") / F.col("n") > overlap).groupBy("class").agg(F.min("other").alias("found"))

    own = F.when(F.col("session") == F.col("class"), F.col("second")).otherwise(F.col("class"))
    out = members.join(second, "class", "left").join(found, "class", "left").select("session", F.least(own, "found").alias("duplicate_of"))
    return out.filter("duplicate_of IS NOT NULL")


# review state


def override_history(events: DataFrame) -> DataFrame:
    """Changes and removals of overrides: events of an allowed status, or that clear one, which find an override set."""
    known = events.filter(F.col("state").isin(*C.OVERRIDES, "cleared"))
    before = F.lag("state").over(Window.partitionBy("session", "entity").orderBy("seq"))
    changed = known.withColumn("previous", before).filter("previous IS NOT NULL AND previous <> 'cleared'")
    kind = F.when(F.col("state") == "cleared", "override_cleared").otherwise("override_changed")
    return changed.select("session", "entity", "seq", kind.alias("type"), "previous", F.when(F.col("state") != "cleared", F.col("state")).alias("state"))


def annotations(events: DataFrame) -> DataFrame:
    """Annotations of an allowed kind with their place among those of the entity."""
    w = Window.partitionBy("session", "entity").orderBy("seq")
    return events.filter(F.col("kind").isin(*ANNOTATIONS)).withColumn("n", F.row_number().over(w).cast("long"))


def review_status(entities: DataFrame, overrides: DataFrame, notes: DataFrame, session: str | None = None) -> DataFrame:
    """Override (none: null) and number of annotations of every entity, of one session or all."""
    counts = notes.groupBy("session", "entity").agg(F.count("*").alias("n_annotations"))
    out = entities.join(overrides.select("session", "entity", "state"), ["session", "entity"], "left").join(counts, ["session", "entity"], "left").fillna({"n_annotations": 0})
    return out if session is None else out.filter(F.col("session") == session)


# results


def unified_result(statuses: DataFrame, requirements: DataFrame, mapped: DataFrame, documents: DataFrame, snippets: DataFrame) -> DataFrame:
    """Each requirement's result with its text and category, its mapped documents with their paths, in order, and its
    snippets, all of which name the first mapped document."""
    paths = mapped.join(documents.select("document_id", "filepath"), "document_id", "left")
    docs = paths.groupBy("session", "requirement_id").agg(F.sort_array(F.collect_set(F.struct("place", "document_id", F.coalesce("filepath", F.lit("")).alias("filepath")))).alias("d"))
    counts = snippets.groupBy("session", "requirement_id").agg(F.count("*").alias("n"))
    out = statuses.join(requirements, "requirement_id", "left").join(docs, ["session", "requirement_id"], "left").join(counts, ["session", "requirement_id"], "left")
    ids = lambda field: F.coalesce(F.transform("d", lambda x: x[field]), F.array().cast("array<string>"))
    return out.select(
        "session", "requirement_id", F.coalesce("requirement_text", F.lit("")).alias("requirement_text"), F.coalesce("category", F.lit("")).alias("category"), "status",
        F.array_join(ids("document_id"), ",").alias("documents"), F.array_join(ids("filepath"), ",").alias("filepaths"), F.coalesce("n", F.lit(0)).cast("long").alias("n_snippets"), F.coalesce(F.get(ids("document_id"), 0), F.lit("")).alias("snippet_document"),
    )


def report_rows(requirements: DataFrame, found: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row for each requirement of each session, with its evidence if there is any."""
    rows = sessions.select("session").distinct().join(requirements.select("requirement_id"))
    return rows.join(found, ["session", "requirement_id"], "left")


def routed_fields(fields: DataFrame) -> DataFrame:
    """Fields for the older checks, by the field's name: tenure once for each document and field, the first by pos; dates
    and project ids all. Without a confidence it is 0.8."""
    kind = F.when(F.col("field_name").isin("owner_name", "area_hectares", "tenure_type"), "tenure").when(F.col("field_name").isin("project_start_date", "crediting_period_start", "crediting_period_end", "baseline_date", "monitoring_date"), "date").when(F.col("field_name") == "project_id", "project_id")
    rows = fields.select("session", "document_id", kind.alias("kind"), "field_name", "value", "pos", F.coalesce("confidence", F.lit(0.8)).alias("confidence")).filter("kind IS NOT NULL")
    first = rows.filter("kind = 'tenure'").groupBy("session", "document_id", "kind", "field_name").agg(F.min_by(F.struct("value", "pos", "confidence"), "pos").alias("f"))
    return rows.filter("kind <> 'tenure'").unionByName(first.select("session", "document_id", "kind", "field_name", "f.*"))


def synthesis_inputs(snippets: DataFrame, checks: DataFrame) -> DataFrame:
    """What a model is asked to judge of each session: its first ten snippets, 150 characters of each, and every check that
    did not pass."""
    head = first_snippets(snippets.withColumn("requirement_id", F.lit("")), 10)
    texts = head.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", F.substring("text", 1, 150).alias("text")))).alias("s"))
    issues = checks.filter("status <> 'pass'").groupBy("session").agg(F.count("*").alias("n_issues"), F.min("field_name").alias("first_issue"))
    return texts.join(issues, "session", "left").select("session", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("texts"), F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"), "first_issue")


def verification_counts(fields: DataFrame, by: str) -> DataFrame:
    """How many fields were verified, and how many were not."""
    ok = F.col("verification") == "verified"
    return fields.groupBy(by).agg(F.count("*").alias("total"), F.count_if(ok).cast("long").alias("verified"), F.count_if(~ok).cast("long").alias("failed"))


def missing_keys(keys: Column, required) -> Column:
    return F.array_sort(F.array_except(F.array(*(F.lit(k) for k in required)), keys))


# texts and cells


def markdown_of(documents: DataFrame, texts: DataFrame, *, fallbacks: bool = True) -> DataFrame:
    """Each document's markdown: at its recorded path, if it is said to have one; with fallbacks else beside it, else in a
    folder of its name, else a placeholder."""
    stem = F.regexp_replace("filepath", r"\.[^./]*$", "")
    keys = [F.when(F.col("has_markdown"), F.col("markdown_path"))]
    if fallbacks:
        keys = [F.col("markdown_path"), F.concat(stem, F.lit(".md")), F.concat(stem, F.lit("/"), T.basename(stem), F.lit(".md"))]
    out = documents
    for i, k in enumerate(keys):
        out = out.withColumn(f"at_{i}", k).join(texts.select(F.col("path").alias(f"at_{i}"), F.col("text").alias(f"text_{i}")), f"at_{i}", "left")
    found = [F.col(f"text_{i}") for i in range(len(keys))]
    return out.select("document_id", F.coalesce(*found, *([F.lit(PLACEHOLDER)] if fallbacks else [])).alias("markdown"))


def image_slices(chunks: DataFrame, most: int = 20) -> DataFrame:
    """A document's images dealt over its chunks in order, most to each; what no chunk has room for is left out."""
    return chunks.select("doc_id", "chunk_no", F.slice("images", (F.col("chunk_no") * most + 1).cast("int"), most).alias("images"))


def capped_workbook(sections: DataFrame, cap: int = 60_000) -> DataFrame:
    """A workbook's sheets as one text; beyond cap it is cut at the last blank line before, with a footer that says so."""
    whole = sections.groupBy("workbook").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("sheets"))
    n, at = F.length("text"), T.last_index(F.substring("text", 1, cap), "\n\n")
    cut = F.when(at > 1, at - 1).otherwise(cap)
    number = lambda c: F.format_number(c, 0)
    footer = F.concat(F.lit(f"\n\n*Truncated by workbook cap ({cap:,} chars): kept first "), number(cut), F.lit(" of "), number(n), F.lit(" total chars across "), F.col("sheets").cast("string"), F.lit(" sheet(s). Full data remains on disk at "), F.col("workbook"), F.lit(".*"))
    return whole.select("workbook", F.when(n <= cap, F.col("text")).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), cut), footer)).alias("text"))


def material_cells(snippets: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The cells of each requirement: value, primary source and up to three more; and its evidence, 1,000 characters cut at
    a sentence. With wanted (session, requirement_id, project_id) there is a row for each of these, sources begin with the
    project's id where there is one, and what has no snippets says so."""
    key = ["session", "requirement_id"]
    four = first_snippets(snippets, 4).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "value", "citation", "text"))).alias("s"))
    four = four.withColumn("project_id", F.lit(None).cast("string")) if wanted is None else wanted.select(*key, "project_id").join(four, key, "left")
    prefix = F.coalesce(F.concat(F.lit("["), F.nullif("project_id", F.lit("")), F.lit("] ")), F.lit(""))
    first, rest = F.get("s", F.lit(0)), F.transform(F.slice("s", 2, 3), lambda x: F.concat(prefix, x["citation"]))
    cell = F.concat_ws("<br>", first["value"], F.concat(F.lit("**Primary Documentation:** "), prefix, first["citation"]), F.when(F.size(rest) > 0, F.concat(F.lit("**Supplementary:** "), F.array_join(rest, "; "))))
    none = F.col("s").isNull()
    evidence = F.coalesce(T.truncate_at_sentence(T.squeeze(first["text"]), 1000), F.lit(""))
    return four.select(*key, F.when(none, "_No evidence found_").otherwise(cell).alias("material"), evidence.alias("evidence"))


def centred(text: Column, width: int) -> Column:
    """Text in the middle of width characters, the odd blank after it."""
    left = F.floor((width - F.length(text)) / 2).cast("int")
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(F.concat(F.repeat(F.lit(" "), left), text), width, " "))


def matrix_line(requirement: Column, category: Column, icons: list[Column], status: Column) -> Column:
    """A row of the mapping matrix as text: fixed widths, six documents at most."""
    cells = [F.rpad(requirement, 8, " "), F.rpad(F.substring(category, 1, 15), 15, " "), *(centred(x, 12) for x in icons[:6]), centred(status, 6)]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def outcome(coverage: Column, failed: Column) -> Column:
    """Of a checklist: approved from 80 % coverage on, if no check failed."""
    return F.when((coverage * 100 >= 80) & (failed == 0), "[X] Approved  [ ] Not Approved").otherwise("[ ] Approved  [X] Not Approved")


def example_lookup(examples: DataFrame, part: str) -> DataFrame:
    """The first example by name that has part in its name, in any case."""
    return examples.filter(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("name").limit(1)


def put(column: str, changes: dict[str, Column]) -> Column:
    """A struct column with dot-path keys set; levels that are missing are made."""
    out = F.col(column)
    for path, value in changes.items():
        out = out.withField(path, value)
    return out

