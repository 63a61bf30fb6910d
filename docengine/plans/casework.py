"""Queries of sessions, lookups, unified results and cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import text as T
from docengine.operators import casework as W
from docengine.operators import evidence, validation
from docengine.plans import adapters as A
from docengine.plans import reviews as R

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn

    return add


def text_of(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def pick(values, index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


# sessions

SESSION_EVENTS = """e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'create' WHEN event_id % 31 = 0 THEN 'delete' ELSE 'update' END AS action,
  CASE WHEN event_id % 3 = 0 THEN 'Project ' || (event_id % 5) END AS name, CASE WHEN event_id % 2 = 0 THEN 'stage ' || (event_id % 7) END AS status FROM events)"""


@query("rev09_sessions", f"""WITH {SESSION_EVENTS}, b AS (SELECT *, max(CASE WHEN action = 'create' THEN seq END) OVER (PARTITION BY session ORDER BY seq) AS born FROM e),
g AS (SELECT session, born, bool_or(action = 'delete') AS gone, max(seq) AS seq, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(status, seq) FILTER (status IS NOT NULL) AS status FROM b WHERE born IS NOT NULL GROUP BY session, born)
SELECT session, seq, name, status FROM g QUALIFY row_number() OVER (PARTITION BY session ORDER BY born DESC) = 1 AND NOT gone""")
def current_sessions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    e = A.table(spark, sf, "events").select(
        text_of("user_id").alias("session"), n.alias("seq"), F.when(n % 7 == 0, "create").when(n % 31 == 0, "delete").otherwise("update").alias("action"),
        F.when(n % 3 == 0, F.concat(F.lit("Project "), text_of(n % 5))).alias("name"), F.when(n % 2 == 0, F.concat(F.lit("stage "), text_of(n % 7))).alias("status"),
    )
    return W.current_sessions(e, "name", "status")


@query("rev10_added_documents", """WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS session, o_orderkey AS seq, ['upload', 'path', 'link'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS kind, CAST(o_orderkey % 4 AS VARCHAR) AS content_hash FROM orders)
SELECT session, seq, CASE WHEN kind = 'link' THEN 'error' WHEN row_number() OVER (PARTITION BY session, content_hash, kind = 'link' ORDER BY seq) > 1 THEN 'duplicate' ELSE 'added' END AS outcome FROM a""")
def added_documents(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    return W.added_documents(A.table(spark, sf, "orders").select(text_of("o_custkey").alias("session"), n.alias("seq"), pick(("upload", "path", "link"), n % 3).alias("kind"), text_of(n % 4).alias("content_hash")))


@query("rev11_sessions_from_uploads", """WITH u AS (SELECT CAST(o_custkey AS VARCHAR) AS session, o_orderkey AS seq, 'f' || (o_orderkey % 6) AS filename, CAST(o_orderkey % 4 AS VARCHAR) AS content_hash, o_orderkey % 50 = 0 AS broken FROM orders),
f AS (SELECT session, filename, arg_min(content_hash, seq) AS h, bool_or(broken) AS broken FROM u GROUP BY ALL)
SELECT session, NOT bool_or(broken) AS created, CASE WHEN bool_or(broken) THEN 0 ELSE count(DISTINCT h) END AS n_documents FROM f GROUP BY session""")
def sessions_from_uploads(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    return W.sessions_from_uploads(A.table(spark, sf, "orders").select(text_of("o_custkey").alias("session"), n.alias("seq"), F.concat(F.lit("f"), text_of(n % 6)).alias("filename"), text_of(n % 4).alias("content_hash"), (n % 50 == 0).alias("broken")))


@query("jon10_same_directory", """SELECT '/data/' || (o_custkey % 500) AS path, arg_min(CAST(o_orderkey AS VARCHAR), o_orderkey) AS session, count(*) AS n FROM orders GROUP BY 1""")
def same_directory(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    path = F.concat(pick(("/data/", "/data//", "/./data/"), n % 3), text_of(F.col("o_custkey") % 500), pick(("", "/", "/./"), n % 3))
    return W.same_directory(A.table(spark, sf, "orders").select(text_of(n).alias("session"), n.alias("seq"), path.alias("path")))


FARMS = ("Oak Farm", "Oak Farms", "Elm Ranch", "Oak Ranch")
#: Names of at least 0.8 similarity, worked out by hand.
FARMS_ALIKE = ", ".join(f"('{a}', '{b}')" for a, b in (("Oak Farm", "Oak Farm"), ("Oak Farms", "Oak Farms"), ("Elm Ranch", "Elm Ranch"), ("Oak Ranch", "Oak Ranch"), ("Oak Farm", "Oak Farms"), ("Oak Farms", "Oak Farm")))


@query("jon09_duplicate_sessions", f"""WITH f AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS session, {list(FARMS)}[CAST(o_custkey % 4 AS INTEGER) + 1] AS name, CAST(o_orderkey % 7 + o_custkey % 2 * 100 AS VARCHAR) AS h FROM orders),
n AS (SELECT session, count(*) AS n FROM f GROUP BY session), alike(x, y) AS (VALUES {FARMS_ALIKE}),
c AS (SELECT a.session, b.session AS other, count(*) AS c FROM f a JOIN f b ON a.h = b.h AND a.session <> b.session JOIN alike ON x = a.name AND y = b.name GROUP BY ALL)
SELECT c.session, min(other) AS duplicate_of FROM c JOIN n ON n.session = c.session WHERE c / n > 0.8 GROUP BY c.session""")
def duplicate_sessions(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").select(text_of("o_custkey").alias("session"), pick(FARMS, F.col("o_custkey") % 4).alias("name"), text_of(F.col("o_orderkey") % 7 + F.col("o_custkey") % 2 * 100).alias("content_hash"))
    return W.duplicate_sessions(o.select("session", "name").distinct(), o)


# review state


@query("rev01_override_history", f"""WITH {A.EVENTS_LOG}, h AS (SELECT *, lag(state) OVER (PARTITION BY session, entity ORDER BY seq) AS previous FROM log)
SELECT session, entity, seq, CASE WHEN state = 'cleared' THEN 'override_cleared' ELSE 'override_changed' END AS type, previous, nullif(state, 'cleared') AS state FROM h WHERE previous <> 'cleared'""")
def override_history(spark: SparkSession, sf: str) -> DataFrame:
    return W.override_history(A.events_log(spark, sf))


NOTES = "notes AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id % 10 AS entity, event_id AS seq, ['note', 'question', 'concern', 'clarification', 'remark'][CAST(event_id // 10 % 5 AS INTEGER) + 1] AS kind FROM events)"


def notes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    return A.table(spark, sf, "events").select(text_of("user_id").alias("session"), (n % 10).alias("entity"), n.alias("seq"), pick((*W.ANNOTATIONS, "remark"), F.floor(n / 10) % 5).alias("kind"))


@query("rev02_annotations", f"WITH {NOTES} SELECT session, entity, seq, kind, row_number() OVER (PARTITION BY session, entity ORDER BY seq) AS n FROM notes WHERE kind <> 'remark'")
def annotations(spark: SparkSession, sf: str) -> DataFrame:
    return W.annotations(notes(spark, sf))


@query("flt08_review_status", f"""WITH {A.EVENTS_LOG}, {NOTES}, l AS (SELECT session, entity, arg_max(state, seq) AS state FROM log GROUP BY ALL), n AS (SELECT session, entity, count(*) AS n FROM notes WHERE kind <> 'remark' GROUP BY ALL)
SELECT x.session, x.entity, nullif(l.state, 'cleared') AS state, coalesce(n, 0) AS n_annotations FROM (SELECT DISTINCT session, entity FROM log) x LEFT JOIN l ON l.session = x.session AND l.entity = x.entity LEFT JOIN n ON n.session = x.session AND n.entity = x.entity""")
def review_status(spark: SparkSession, sf: str) -> DataFrame:
    log = A.events_log(spark, sf)
    return W.review_status(log.select("session", "entity").distinct(), R.latest_state(spark, sf), annotations(spark, sf))


# results

MAPPED = "mapped AS (SELECT DISTINCT session, requirement_id, document_id, pos AS place FROM snippets WHERE page < 30)"


@query("jon07_unified_result", f"""WITH {R.STATUS}, {MAPPED}, m AS (SELECT session, requirement_id, string_agg(document_id, ',' ORDER BY place) AS documents, string_agg(CASE WHEN place % 5 = 0 THEN '' ELSE '/d/' || document_id || '.pdf' END, ',' ORDER BY place) AS filepaths, arg_min(document_id, place) AS first FROM mapped GROUP BY ALL)
SELECT s.session, s.requirement_id, r.accepted_evidence AS requirement_text, r.category, s.status, coalesce(documents, '') AS documents, coalesce(filepaths, '') AS filepaths, s.n_snippets, coalesce(first, '') AS snippet_document
FROM status s JOIN requirements r ON r.requirement_id = s.requirement_id LEFT JOIN m ON m.session = s.session AND m.requirement_id = s.requirement_id""")
def unified_result(spark: SparkSession, sf: str) -> DataFrame:
    snippets, requirements = A.snippets(spark, sf), A.requirements(spark)
    mapped = snippets.filter("page < 30").select("session", "requirement_id", "document_id", F.col("pos").alias("place"))
    documents = snippets.filter("pos % 5 <> 0").select("document_id", F.concat(F.lit("/d/"), "document_id", F.lit(".pdf")).alias("filepath"))
    statuses = evidence.requirement_status(requirements, snippets).select("session", "requirement_id", "status")
    return W.unified_result(statuses, requirements.select("requirement_id", F.col("accepted_evidence").alias("requirement_text"), "category"), mapped, documents, snippets)


@query("jon12_report_rows", f"WITH {R.STATUS} SELECT s.session, r.requirement_id, best FROM (SELECT DISTINCT session FROM snippets) s CROSS JOIN requirements r LEFT JOIN found f ON f.session = s.session AND f.requirement_id = r.requirement_id")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    snippets = A.snippets(spark, sf)
    return W.report_rows(A.requirements(spark), snippets.groupBy("session", "requirement_id").agg(F.max("confidence").alias("best")), snippets)


@query("set04_mapped_documents", f"WITH {A.SNIPPETS} SELECT session, count(DISTINCT document_id) AS n_documents FROM snippets GROUP BY session")
def mapped_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The union of the documents mapped to a session's requirements, counted."""
    return A.snippets(spark, sf).select("session", "document_id").distinct().groupBy("session").agg(F.count("*").alias("n_documents"))


@query("agg09_routed_fields", f"""WITH {A.FIELDS}, k AS (SELECT session, document_id, CASE WHEN field_name IN ('owner_name', 'area_hectares') THEN 'tenure' WHEN field_name IN ('project_start_date', 'crediting_period_start', 'crediting_period_end', 'baseline_date') THEN 'date' WHEN field_name = 'project_id' THEN 'project_id' END AS kind, field_name, value, pos, confidence FROM fields)
SELECT session, document_id, kind, field_name, value, pos, confidence FROM k WHERE kind IN ('date', 'project_id')
UNION ALL SELECT session, document_id, kind, field_name, arg_min(value, pos), min(pos), arg_min(confidence, pos) FROM k WHERE kind = 'tenure' GROUP BY ALL""")
def routed_fields(spark: SparkSession, sf: str) -> DataFrame:
    return W.routed_fields(A.fields(spark, sf))


@query("leg04_session_dates", f"""WITH {A.FIELDS}, d AS (SELECT session, field_name, arg_min(value, pos) AS value FROM fields WHERE value IS NOT NULL AND field_name IN ('baseline_date', 'crediting_period_end') GROUP BY ALL),
p AS (SELECT session, max(CASE WHEN field_name = 'baseline_date' THEN value END) AS a, max(CASE WHEN field_name = 'crediting_period_end' THEN value END) AS b FROM d GROUP BY session)
SELECT session, 'VAL-DATE-' || substr(sha256(session || '|baseline_date|crediting_period_end'), 1, 8) AS check_id, CASE WHEN abs(date_diff('day', CAST(a AS DATE), CAST(b AS DATE))) <= {C.MAX_DAYS_APART} THEN 'pass' ELSE 'fail' END AS status FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def session_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The older date check from routed fields, in the shape of the other checks, with an id of its own."""
    d = W.routed_fields(A.fields(spark, sf)).filter("kind = 'date' AND value IS NOT NULL")
    both = d.filter(F.col("field_name").isin("baseline_date", "crediting_period_end")).groupBy("session").agg(
        *(T.iso_date(F.min(F.when(F.col("field_name") == n, F.struct("pos", "value")))["value"]).alias(n) for n in ("baseline_date", "crediting_period_end"))
    )
    good = both.filter("baseline_date IS NOT NULL AND crediting_period_end IS NOT NULL")
    ident = T.check_id("VAL-DATE", F.col("session"), F.lit("baseline_date"), F.lit("crediting_period_end"))
    return good.select("session", ident.alias("check_id"), validation.pairwise_dates(F.col("baseline_date"), F.col("crediting_period_end"))["status"].alias("status"))


@query("idx01_check_ids", f"WITH {R.STRUCTURAL} SELECT session, check_type, field_name, 'STR-' || substr(sha256(session || '|' || check_type || '|' || field_name), 1, 8) AS check_id FROM structural")
def check_ids(spark: SparkSession, sf: str) -> DataFrame:
    return R.structural_checks(spark, sf).select("session", "check_type", "field_name", T.check_id("STR", F.col("session"), F.col("check_type"), F.col("field_name")).alias("check_id"))


@query("llm01_synthesis_inputs", f"""WITH {A.SNIPPETS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS rank FROM snippets),
t AS (SELECT session, string_agg(substr(text, 1, 150), chr(10) ORDER BY pos) AS texts FROM ranked WHERE rank <= 10 GROUP BY session),
i AS (SELECT source AS session, count(*) AS n, min('field-' || (doc_id % 9)) AS first FROM documents WHERE doc_id % 4 > 0 GROUP BY source)
SELECT t.session, texts, coalesce(n, 0) AS n_issues, first AS first_issue FROM t LEFT JOIN i ON i.session = t.session""")
def synthesis_inputs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    checks = A.table(spark, sf, "documents").select(F.col("source").alias("session"), F.concat(F.lit("field-"), text_of(n % 9)).alias("field_name"), F.when(n % 4 == 0, "pass").otherwise("fail").alias("status"))
    return W.synthesis_inputs(A.snippets(spark, sf), checks)


@query("cit03_verification_counts", """SELECT source, count(*) AS total, count(*) FILTER (doc_id % 4 <> 0 AND doc_id * 7 % 100 >= 75) AS verified, count(*) FILTER (NOT (doc_id % 4 <> 0 AND doc_id * 7 % 100 >= 75)) AS failed FROM documents GROUP BY source""")
def verification_counts(spark: SparkSession, sf: str) -> DataFrame:
    a = R.adjusted_confidence(spark, sf)
    return W.verification_counts(A.table(spark, sf, "documents").select("doc_id", "source").join(a, "doc_id"), "source")


@query("set03_missing_keys", "SELECT doc_id, list_sort(list_filter(['confidence', 'page', 'source', 'value'], lambda k: NOT ((k = 'value' AND doc_id % 2 = 0) OR (k = 'page' AND doc_id % 3 = 0) OR k = 'source'))) AS missing FROM documents")
def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    keys = F.array_compact(F.array(F.lit("source"), F.when(n % 2 == 0, "value"), F.when(n % 3 == 0, "page")))
    return A.table(spark, sf, "documents").select("doc_id", W.missing_keys(keys, ("confidence", "page", "source", "value")).alias("missing"))


@query("srt03_document_names", f"WITH {A.DOC_INDEX} SELECT session, list_sort(list(DISTINCT filename)) AS names FROM doc_index GROUP BY session")
def document_names(spark: SparkSession, sf: str) -> DataFrame:
    """A session's document names, each once, by name."""
    d = A.doc_index(spark, sf).select("session", "filename").distinct()
    return d.groupBy("session").agg(F.array_sort(F.collect_list("filename")).alias("names"))


@query("flt17_example_lookup", "SELECT c_name AS name FROM customer WHERE contains(lower(c_name), '0001') ORDER BY c_name LIMIT 1")
def example_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return W.example_lookup(A.table(spark, sf, "customer").select(F.col("c_name").alias("name")), "0001")


# texts and cells

MARKDOWN = """d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, '/d/' || doc_id || '.pdf' AS filepath, doc_id % 2 = 0 AS has_markdown, CASE WHEN doc_id % 3 = 0 THEN '/m/' || doc_id || '.md' END AS markdown_path FROM documents),
t AS (SELECT '/m/' || doc_id || '.md' AS path, 'recorded ' || text AS text FROM documents WHERE doc_id % 4 < 3 UNION ALL SELECT '/d/' || doc_id || '.md', 'beside ' || text FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT '/d/' || doc_id || '/' || doc_id || '.md', 'inside ' || text FROM documents WHERE doc_id % 7 = 0)"""


def markdown_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d, n = A.table(spark, sf, "documents"), F.col("doc_id")
    made = lambda test, *path: d.filter(test).select(F.concat(*path[:-1], F.lit(".md")).alias("path"), F.concat(F.lit(path[-1]), "text").alias("text"))
    own = text_of(n)
    texts = made(n % 4 < 3, F.lit("/m/"), own, "recorded ").unionByName(made(n % 5 == 0, F.lit("/d/"), own, "beside ")).unionByName(made(n % 7 == 0, F.lit("/d/"), own, F.lit("/"), own, "inside "))
    docs = d.select(own.alias("document_id"), F.concat(F.lit("/d/"), own, F.lit(".pdf")).alias("filepath"), (n % 2 == 0).alias("has_markdown"), F.when(n % 3 == 0, F.concat(F.lit("/m/"), own, F.lit(".md"))).alias("markdown_path"))
    return docs, texts


@query("src22_markdown", f"WITH {MARKDOWN} SELECT document_id, t.text AS markdown FROM d LEFT JOIN t ON has_markdown AND t.path = markdown_path")
def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return W.markdown_of(*markdown_tables(spark, sf), fallbacks=False)


@query("src23_markdown_fallbacks", f"""WITH {MARKDOWN} SELECT document_id, coalesce(a.text, b.text, c.text, '{W.PLACEHOLDER}') AS markdown FROM d LEFT JOIN t a ON a.path = markdown_path
LEFT JOIN t b ON b.path = '/d/' || doc_id || '.md' LEFT JOIN t c ON c.path = '/d/' || doc_id || '/' || doc_id || '.md'""")
def markdown_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    return W.markdown_of(*markdown_tables(spark, sf))


@query("txt03_image_slices", """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, list_slice(images, CAST(i * 20 + 1 AS BIGINT), CAST(i * 20 + 20 AS BIGINT)) AS images
FROM (SELECT doc_id, images, unnest(range(0, nc)) AS i FROM (SELECT doc_id, range(0, doc_id % 70) AS images, doc_id % 3 + 1 AS nc FROM documents))""")
def image_slices(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    images = F.when(n % 70 > 0, F.sequence(F.lit(0).cast("long"), n % 70 - 1)).otherwise(F.array().cast("array<bigint>"))
    d = A.table(spark, sf, "documents").select("doc_id", images.alias("images"), (n % 3 + 1).alias("n_chunks"))
    return W.image_slices(d.select("*", F.explode(F.sequence(F.lit(0), (F.col("n_chunks") - 1).cast("int"))).alias("chunk_no")))


@query("txt06_capped_workbook", """WITH s AS (SELECT 'w' || (page_id // 3) AS workbook, page_id AS sheet_no, html AS text FROM pages),
w AS (SELECT workbook, string_agg(text, chr(10) || chr(10) ORDER BY sheet_no) AS t, count(*) AS sheets FROM s GROUP BY workbook),
k AS (SELECT *, strpos(reverse(substr(t, 1, 3000)), chr(10) || chr(10)) AS r FROM w), c AS (SELECT *, CASE WHEN r > 0 AND 3000 - r - 1 > 0 THEN 3000 - r - 1 ELSE 3000 END AS cut FROM k)
SELECT workbook, CASE WHEN length(t) <= 3000 THEN t ELSE substr(t, 1, cut) || chr(10) || chr(10) || '*Truncated by workbook cap (3,000 chars): kept first ' || format('{:,}', CAST(cut AS BIGINT)) || ' of ' || format('{:,}', CAST(length(t) AS BIGINT)) || ' total chars across ' || sheets || ' sheet(s). Full data remains on disk at ' || workbook || '.*' END AS text FROM c""")
def capped_workbook(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "pages").select(F.concat(F.lit("w"), text_of(F.floor(F.col("page_id") / 3))).alias("workbook"), F.col("page_id").alias("sheet_no"), F.col("html").alias("text"))
    return W.capped_workbook(p, 3000)


@query("txt09_material_cells", f"""WITH {A.SNIPPETS}, wanted AS (SELECT session, 'REQ-' || lpad(CAST(k AS VARCHAR), 3, '0') AS requirement_id, CASE WHEN length(session) % 2 = 0 THEN '[C06-' || substr(session, 4) || '] ' ELSE '' END AS prefix FROM (SELECT DISTINCT source AS session FROM documents), (SELECT unnest(range(1, 26)) AS k)),
r AS (SELECT *, row_number() OVER (PARTITION BY session, requirement_id ORDER BY pos) AS rank FROM snippets),
g AS (SELECT session, requirement_id, max(CASE WHEN rank = 1 THEN 'value ' || pos END) AS v, max(CASE WHEN rank = 1 THEN citation END) AS c, list(citation ORDER BY rank) FILTER (rank > 1) AS more, max(CASE WHEN rank = 1 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END) AS t FROM r WHERE rank <= 4 GROUP BY ALL),
h AS (SELECT *, substr(t, 1, 1000) AS head, strpos(reverse(substr(t, 1, 1000)), ' .') AS s, strpos(reverse(substr(t, 1, 1000)), ' ') AS b FROM g)
SELECT w.session, w.requirement_id, CASE WHEN h.session IS NULL THEN '_No evidence found_' ELSE concat_ws('<br>', v, '**Primary Documentation:** ' || prefix || c, '**Supplementary:** ' || array_to_string(list_transform(more, lambda x: prefix || x), '; ')) END AS material,
  coalesce(CASE WHEN length(t) <= 1000 THEN t WHEN s > 0 AND 999 - s > 500 THEN substr(head, 1, 1000 - s) WHEN b > 0 AND 1000 - b > 700 THEN substr(head, 1, 1000 - b) || '...' ELSE head || '...' END, '') AS evidence FROM wanted w LEFT JOIN h ON h.session = w.session AND h.requirement_id = w.requirement_id""")
def material_cells(spark: SparkSession, sf: str) -> DataFrame:
    """For all requirements of the checklist and two that no document is for; every other session has a project id."""
    found = A.snippets(spark, sf).withColumn("value", F.concat(F.lit("value "), text_of("pos")))
    asked = F.explode(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.concat(F.lit("REQ-"), F.lpad(k.cast("string"), 3, "0"))))
    project = F.when(F.length("session") % 2 == 0, F.concat(F.lit("C06-"), F.substr("session", F.lit(4))))
    return W.material_cells(found, found.select("session").distinct().select("session", asked.alias("requirement_id"), project.alias("project_id")))


@query("txt16_matrix_lines", """WITH p AS (SELECT doc_id, 'REQ-' || lpad(CAST(doc_id % 23 + 1 AS VARCHAR), 3, '0') AS r, source AS c, CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE '·' END AS i, CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'yes' END AS s FROM documents)
SELECT doc_id, '| ' || rpad(r, 8, ' ') || ' | ' || rpad(substr(c, 1, 15), 15, ' ') || ' | ' || CASE WHEN i = 'ok' THEN '     ok     ' ELSE '     ·      ' END || ' | ' || CASE WHEN s = 'open' THEN ' open ' ELSE ' yes  ' END || ' |' AS line FROM p""")
def matrix_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    line = W.matrix_line(F.concat(F.lit("REQ-"), F.lpad(text_of(n % 23 + 1), 3, "0")), F.col("source"), [F.when(n % 3 == 0, "ok").otherwise("·")], F.when(n % 2 == 0, "open").otherwise("yes"))
    return A.table(spark, sf, "documents").select("doc_id", line.alias("line"))


@query("snk07_checklist_outcome", f"""WITH {R.STATUS} SELECT c.session, CASE WHEN overall * 100 >= 80 AND length(c.session) % 3 = 0 THEN '[X] Approved  [ ] Not Approved' ELSE '[ ] Approved  [X] Not Approved' END AS outcome FROM cover c""")
def checklist_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return R.coverage(spark, sf).select("session", W.outcome(F.col("overall"), F.length("session") % 3).alias("outcome"))


@query("snk02_dot_path_update", "SELECT o_orderkey, 'done' AS stage, CAST(o_custkey AS VARCHAR) AS owner, CAST(o_orderkey % 9 AS BIGINT) AS documents FROM orders")
def dot_path_update(spark: SparkSession, sf: str) -> DataFrame:
    state = F.struct(F.lit("old").alias("status"), F.struct(F.lit("started").alias("stage"), text_of("o_custkey").alias("owner")).alias("progress"))
    o = A.table(spark, sf, "orders").select("o_orderkey", state.alias("state"))
    changed = o.withColumn("state", W.put("state", {"progress.stage": F.lit("done"), "statistics": F.struct((F.col("o_orderkey") % 9).cast("long").alias("documents"))}))
    return changed.select("o_orderkey", "state.progress.stage", "state.progress.owner", "state.statistics.documents")
