"""Queries of discovery, mapping and text functions, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import canonical
from docengine.functions import text as T
from docengine.operators import chunking, discovery, extraction, mapping, prompts, spreadsheet
from docengine.plans import adapters as A
from docengine.sources import cache

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn

    return add


@query("src04_document_identity", f"WITH {A.DOC_INDEX} SELECT session, pos, content_hash, document_id, size FROM doc_index")
def document_identity(spark: SparkSession, sf: str) -> DataFrame:
    return A.doc_index(spark, sf).select("session", "pos", "content_hash", "document_id", "size")


@query("src01_scannable_paths", f"""SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS ext,
  list_contains({A.sql_list(C.SCANNED_EXTENSIONS)}, lower(regexp_extract(url, '(\\.[^./]+)$', 1))) AND NOT regexp_matches(url, '(^|/)\\.') AS scannable FROM pages""")
def scannable_paths(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "pages").select("page_id", T.extension(F.col("url")).alias("ext"), discovery.scannable(F.col("url")).alias("scannable"))


@query("flt01_classify_filename", f"WITH {A.DOC_INDEX}, c AS (SELECT pos, filename, {A.classify_sql()} AS c FROM doc_index) SELECT pos, filename, c.label AS label, c.confidence AS confidence, c.method AS method FROM c")
def classify_filename(spark: SparkSession, sf: str) -> DataFrame:
    return A.doc_index(spark, sf).select("pos", "filename", discovery.classify(F.col("filename")).alias("c")).select("pos", "filename", "c.*")


@query("flt01_classify_urls", f"WITH u AS (SELECT page_id, {A.classify_sql("lower(regexp_extract(url, '([^/]*)$', 1))")} AS c FROM pages) SELECT page_id, c.label AS label, c.confidence AS confidence FROM u")
def classify_urls(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "pages").select("page_id", discovery.classify(F.col("url")).alias("c")).select("page_id", "c.label", "c.confidence")


@query("flt03_extension_kinds", f"WITH {A.DOC_INDEX}, e AS (SELECT pos, regexp_extract(lower(filename), '(\\.[^./]+)$', 1) AS x FROM doc_index) SELECT pos, list_contains({A.sql_list(C.GIS_EXTENSIONS)}, x) AS gis, list_contains({A.sql_list(C.IMAGE_EXTENSIONS)}, x) AS image, x = '.pdf' AS pdf, list_contains({A.sql_list(C.SPREADSHEET_EXTENSIONS)}, x) AS sheet FROM e")
def extension_kinds(spark: SparkSession, sf: str) -> DataFrame:
    x = T.extension(F.col("filename"))
    return A.doc_index(spark, sf).select("pos", x.isin(*C.GIS_EXTENSIONS).alias("gis"), x.isin(*C.IMAGE_EXTENSIONS).alias("image"), x.isin(*C.PDF_EXTENSIONS).alias("pdf"), x.isin(*C.SPREADSHEET_EXTENSIONS).alias("sheet"))


@query("win01_first_occurrence", f"WITH {A.DOC_INDEX} SELECT pos, document_id, pos = min(pos) OVER (PARTITION BY content_hash) AS is_first FROM doc_index")
def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.first_occurrences(A.doc_index(spark, sf), "content_hash", "pos").select("pos", "document_id", "is_first")


@query("agg01_class_histogram", f"WITH {A.DOC_INDEX} SELECT classification, count(*) AS n_documents FROM doc_index GROUP BY classification")
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.class_counts(A.doc_index(spark, sf))


@query("src10_text_quality", """WITH t AS (SELECT doc_id, text || repeat('#', CAST(doc_id % 5 * length(text) // 5 AS INTEGER)) AS t, doc_id % 13 AS pages FROM documents)
SELECT doc_id, CASE WHEN pages = 0 THEN 'no pages' WHEN length(t) < 100 THEN 'too short' WHEN length(regexp_replace(t, '[^\\p{L}\\p{N} ]', '', 'g')) < 0.7 * length(t) THEN 'unreadable' END AS problem FROM t""")
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "documents").select("doc_id", F.concat("text", F.repeat(F.lit("#"), F.floor(F.col("doc_id") % 5 * F.length("text") / 5).cast("int"))).alias("t"), (F.col("doc_id") % 13).alias("pages"))
    return t.select("doc_id", discovery.text_quality(F.col("t"), F.col("pages")).alias("problem"))


@query("src15_needs_ocr", """WITH t AS (SELECT doc_id, text AS t, doc_id % 3 AS blocks FROM documents)
SELECT doc_id, length(regexp_replace(t, '\\s', '', 'g')) < 50 AND blocks > 0 AS needs_ocr FROM t""")
def needs_ocr(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"), (F.col("doc_id") % 3).alias("blocks"))
    return t.select("doc_id", discovery.needs_ocr(F.col("t"), F.col("blocks")).alias("needs_ocr"))


@query("src19_directory_counts", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS dir, count(*) AS n FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) NOT LIKE '.%' GROUP BY 1")
def directory_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("dir"))
    return d.filter(~F.col("dir").startswith(".")).groupBy("dir").agg(F.count("*").alias("n"))


@query("src20_uploads", f"WITH {A.DOC_INDEX} SELECT pos, CASE WHEN pos % 5 = 0 THEN NULL ELSE filename END AS name, base64(encode(filename)) AS content FROM doc_index")
def uploads(spark: SparkSession, sf: str) -> DataFrame:
    d = A.doc_index(spark, sf)
    path = F.concat(F.lit("/up/"), F.when(F.col("pos") % 5 == 0, ".").otherwise(""), F.col("filename"))
    content = F.base64(F.unbase64(F.base64(F.col("filename").cast("binary"))))
    return d.select("pos", discovery.upload_name(path).alias("name"), content.alias("content"))


@query("src21_best_text", "SELECT 'D' || doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'hq:' || md5(text) ELSE 'fast:' || md5(text) END AS text FROM documents")
def best_text(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("document_id"), F.md5(F.col("text").cast("binary")).alias("h"), "doc_id")
    fast = d.select("document_id", F.lit("fast").alias("quality"), F.concat(F.lit("fast:"), "h").alias("text"))
    hq = d.filter("doc_id % 3 = 0").select("document_id", F.lit("hq").alias("quality"), F.concat(F.lit("hq:"), "h").alias("text"))
    return discovery.best_text(fast.union(hq))


@query("set02_session_overlap", f"WITH {A.DOC_INDEX}, a AS (SELECT DISTINCT content_hash FROM doc_index WHERE session = 'src0'), b AS (SELECT DISTINCT content_hash FROM doc_index WHERE session = 'src3') SELECT count(*) AS n_hashes, count(b.content_hash) AS n_shared FROM a LEFT JOIN b ON a.content_hash = b.content_hash")
def session_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.overlap_share(A.doc_index(spark, sf), "src0", "src3")


@query("set05_upload_dedup", f"""WITH {A.DOC_INDEX}, u AS (SELECT session, pos, substr(filename, 1, 9) AS filename, content_hash FROM doc_index),
n AS (SELECT *, row_number() OVER (PARTITION BY session, filename ORDER BY pos) AS rn FROM u), c AS (SELECT *, row_number() OVER (PARTITION BY session, content_hash, rn = 1 ORDER BY pos) AS rc FROM n)
SELECT session, pos, CASE WHEN rn > 1 THEN 'filename' WHEN rc > 1 THEN 'content' END AS dropped FROM c""")
def upload_dedup(spark: SparkSession, sf: str) -> DataFrame:
    u = A.doc_index(spark, sf).select("session", "pos", F.substring("filename", 1, 9).alias("filename"), "content_hash")
    return discovery.split_uploads(u).select("session", "pos", "dropped")


@query("flt10_document_by_id", f"WITH {A.DOC_INDEX} SELECT pos, document_id, filename FROM doc_index WHERE pos = 17")
def document_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return A.doc_index(spark, sf).filter("pos = 17").select("pos", "document_id", "filename")


def expected_sql() -> str:
    cats = " ".join(f"WHEN contains(lower(category), '{k}') THEN {A.sql_list(v)}" for k, v in C.EXPECTED_CLASSES)
    ev = " ".join(f"WHEN {' OR '.join(f"contains(lower(accepted_evidence), '{w}')" for w in ws)} THEN {A.sql_list(v)}" for ws, v in C.EVIDENCE_CLASSES)
    return f"CASE {cats} {ev} ELSE {A.sql_list(C.DEFAULT_CLASSES)} END"


MAPPINGS = f"""{A.DOC_INDEX}, {A.REQUIREMENTS}, docs AS (SELECT session || '-' || (pos % 7) AS session, pos, document_id, classification FROM doc_index),
wanted AS (SELECT requirement_id, unnest(x) AS classification, generate_subscripts(x, 1) AS class_pos FROM (SELECT requirement_id, {expected_sql()} AS x FROM requirements)),
classes AS (SELECT session, classification, count(*) AS n, arg_min(document_id, pos) AS first_document FROM docs GROUP BY ALL),
hits AS (SELECT session, requirement_id, CAST(sum(n) AS BIGINT) AS n, arg_min(first_document, class_pos) AS first_document FROM classes JOIN wanted USING (classification) GROUP BY ALL),
plans AS (SELECT session, first_document AS plan FROM classes WHERE classification = 'project_plan'),
mappings AS (
  SELECT s.session, r.requirement_id, CASE WHEN coalesce(n, 0) > 0 THEN n WHEN plan IS NOT NULL THEN 1 ELSE 0 END AS n_documents, coalesce(h.first_document, plan) AS first_document,
    CASE WHEN coalesce(n, 0) > 0 OR plan IS NOT NULL THEN 'suggested' ELSE 'unmapped' END AS mapping_status,
    CAST(CASE WHEN n = 1 THEN 0.85 WHEN n > 1 THEN 0.75 WHEN plan IS NOT NULL THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence
  FROM (SELECT DISTINCT session FROM docs) s CROSS JOIN requirements r LEFT JOIN hits h ON h.session = s.session AND h.requirement_id = r.requirement_id LEFT JOIN plans p ON p.session = s.session
), summary AS (
  SELECT session, count(*) AS total, count(*) FILTER (mapping_status <> 'unmapped') AS mapped, count(*) FILTER (mapping_status = 'confirmed') AS confirmed, count(*) FILTER (mapping_status = 'unmapped') AS unmapped,
    count(*) FILTER (mapping_status <> 'unmapped') / count(*) AS coverage_rate, count(*) FILTER (confidence > 0.75) AS high, count(*) FILTER (confidence >= 0.5 AND confidence <= 0.75) AS medium,
    count(*) FILTER (confidence > 0 AND confidence < 0.5) AS low, count(*) FILTER (mapping_status = 'unmapped' OR confidence < 0.75) AS attention FROM mappings GROUP BY session
)"""


def mapped_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = A.doc_index(spark, sf)
    return d.withColumn("session", F.concat("session", F.lit("-"), (F.col("pos") % 7).cast("string")))


@query("jon02_requirement_mapping", f"WITH {MAPPINGS} SELECT session, requirement_id, CAST(n_documents AS BIGINT) AS n_documents, first_document, mapping_status, confidence FROM mappings")
def requirement_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.map_requirements(A.requirements(spark), mapped_docs(spark, sf))


@query("jon03_documents_by_class", f"WITH {MAPPINGS} SELECT session, classification, n, first_document FROM classes")
def documents_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return mapped_docs(spark, sf).groupBy("session", "classification").agg(F.count("*").alias("n"), F.min_by("document_id", "pos").alias("first_document"))


@query("agg04_mapping_summary", f"WITH {MAPPINGS} SELECT * FROM summary")
def mapping_summary(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.mapping_summary(requirement_mapping(spark, sf))


@query("agg05_mapping_attention", f"""WITH {MAPPINGS} SELECT session, requirement_id, CASE WHEN mapping_status = 'confirmed' THEN '✓' WHEN mapping_status = 'unmapped' THEN '✗' WHEN confidence > 0.75 THEN '●' WHEN confidence >= 0.5 THEN '○' ELSE '◌' END AS icon
FROM mappings WHERE mapping_status = 'unmapped' OR confidence < 0.75""")
def mapping_attention(spark: SparkSession, sf: str) -> DataFrame:
    m = requirement_mapping(spark, sf).filter("mapping_status = 'unmapped' OR confidence < 0.75")
    return m.select("session", "requirement_id", mapping.mapping_icon(F.col("mapping_status"), F.col("confidence")).alias("icon"))


@query("agg06_matrix_ready", f"WITH {MAPPINGS} SELECT session, confirmed = total OR unmapped = 0 AS ready FROM summary")
def matrix_ready(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.is_ready(mapping_summary(spark, sf)).select("session", "ready")


@query("jon04_mapping_matrix", f"""WITH {MAPPINGS}, ids AS (SELECT DISTINCT session, document_id FROM docs)
SELECT m.session, requirement_id, document_id, CASE WHEN document_id = first_document THEN CASE WHEN mapping_status = 'unmapped' THEN '✗' WHEN confidence > 0.75 THEN '●' WHEN confidence >= 0.5 THEN '○' ELSE '◌' END ELSE '·' END AS cell
FROM mappings m JOIN ids d ON m.session = d.session""")
def mapping_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = requirement_mapping(spark, sf)
    pairs = m.filter("first_document IS NOT NULL").select("session", "requirement_id", F.col("first_document").alias("document_id"))
    return mapping.matrix(m, pairs, mapped_docs(spark, sf).select("session", "document_id").distinct())


@query("rev08_mapping_state", f"""WITH {A.EVENTS_LOG} SELECT session, entity, CASE arg_max(seq % 3, seq) WHEN 0 THEN 'confirmed' WHEN 1 THEN 'unmapped' ELSE 'suggested' END AS mapping_status FROM log GROUP BY session, entity""")
def mapping_state(spark: SparkSession, sf: str) -> DataFrame:
    action = F.element_at(F.array(F.lit("confirm"), F.lit("remove"), F.lit("suggest")), (F.col("seq") % 3 + 1).cast("int"))
    e = A.events_log(spark, sf).select("session", F.col("entity").alias("requirement_id"), "seq", action.alias("action"))
    return mapping.latest_mappings(e).withColumnRenamed("requirement_id", "entity")


# text functions


@query("pat01_project_ids", f"WITH {A.RICH_TEXT} SELECT doc_id, array_to_string(regexp_extract_all(text, 'C\\d{{2}}-\\d+'), ',') AS ids FROM rich")
def project_ids(spark: SparkSession, sf: str) -> DataFrame:
    return A.rich_text(spark, sf).select("doc_id", F.array_join(T.project_ids(F.col("text")), ",").alias("ids"))


@query("dat01_dates", f"""WITH {A.RICH_TEXT} SELECT doc_id, array_to_string(list_concat(list_concat(regexp_extract_all(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), regexp_extract_all(text, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}')),
  regexp_extract_all(text, '(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\w*\\s+\\d{{1,2}},?\\s+\\d{{4}}')), ';') AS dates FROM rich""")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    return A.rich_text(spark, sf).select("doc_id", F.array_join(T.dates(F.col("text")), ";").alias("dates"))


@query("pat02_quantities", f"""WITH {A.RICH_TEXT} SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:ha|hectares?)', 1), ',') AS hectares, array_to_string(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)\\s*%', 1), ',') AS percentages,
  regexp_matches(source || doc_id || '@x.org', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') AS email FROM rich""")
def quantities(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return A.rich_text(spark, sf).select("doc_id", F.array_join(T.hectares(t), ",").alias("hectares"), F.array_join(T.percentages(t), ",").alias("percentages"), T.is_email(F.concat("source", F.col("doc_id").cast("string"), F.lit("@x.org"))).alias("email"))


@query("txt01_truncate_paragraph", """WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), h AS (SELECT *, substr(t, 1, 800) AS head, strpos(reverse(substr(t, 1, 800)), chr(10) || chr(10)) AS r FROM t),
k AS (SELECT *, CASE WHEN r > 0 AND length(head) - r - 1 > 0 THEN substr(head, 1, length(head) - r - 1) ELSE head END AS kept FROM h)
SELECT doc_id, CASE WHEN length(t) <= 800 THEN t ELSE kept || chr(10) || chr(10) || '_[showing first ' || length(kept) || ' of ' || length(t) || ' chars]_' || chr(10) END AS text FROM k""")
def truncate_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    return t.select("doc_id", T.truncate_at_paragraph(F.col("t"), 800).alias("text"))


@query("txt04_truncate_sentence", """WITH h AS (SELECT doc_id, text AS t, substr(text, 1, 200) AS head FROM documents),
p AS (SELECT *, CASE WHEN strpos(reverse(head), ' .') > 0 THEN 200 - strpos(reverse(head), ' .') - 1 ELSE -1 END AS s1, CASE WHEN strpos(reverse(head), chr(10) || '.') > 0 THEN 200 - strpos(reverse(head), chr(10) || '.') - 1 ELSE -1 END AS s2,
  CASE WHEN strpos(reverse(head), chr(9) || '.') > 0 THEN 200 - strpos(reverse(head), chr(9) || '.') - 1 ELSE -1 END AS s3, CASE WHEN strpos(reverse(head), ' ') > 0 THEN 200 - strpos(reverse(head), ' ') ELSE -1 END AS b FROM h)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN greatest(s1, s2, s3) > 100 THEN substr(head, 1, greatest(s1, s2, s3) + 1) WHEN b > 140 THEN substr(head, 1, b) || '...' ELSE head || '...' END AS text FROM p""")
def truncate_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", T.truncate_at_sentence(F.col("text"), 200).alias("text"))


@query("txt07_escape_cell", """SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '|', '\\|'), chr(10), ' '), chr(13), ''), '<br>', chr(1)), '<', '&lt;'), '>', '&gt;'), chr(1), '<br>') AS cell FROM pages""")
def escape_cell(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "pages").select("page_id", T.escape_cell(F.col("html")).alias("cell"))


@query("txt08_citation", """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN source ELSE source || ' (' || concat_ws(', ', CASE WHEN doc_id % 3 <> 0 THEN 'Section ' || lang END, CASE WHEN doc_id % 4 <> 0 THEN 'p.' || (doc_id % 40) END) || ')' END AS citation FROM documents""")
def citation(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    c = T.citation(F.when(n % 10 != 0, F.col("source")), F.when(n % 3 != 0, F.col("lang")), F.when(n % 4 != 0, n % 40))
    return A.table(spark, sf, "documents").select("doc_id", c.alias("citation"))


@query("txt11_squeeze", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", T.squeeze(F.col("text")).alias("text"))


@query("txt14_count_tables", f"WITH {A.RICH_TEXT} SELECT doc_id, CAST(len(regexp_extract_all(text, '\\|.*\\|.*\\n\\|[-:| ]+\\|')) AS BIGINT) AS n_tables FROM rich")
def count_tables(spark: SparkSession, sf: str) -> DataFrame:
    return A.rich_text(spark, sf).select("doc_id", T.count_tables(F.col("text")).alias("n_tables"))


@query("txt17_latin1", """SELECT doc_id, regexp_replace(replace(replace(replace('✓ œ—' || text || '…', '✓', 'Y'), '—', '--'), '…', '...'), '[^\\x{00}-\\x{ff}]', '?', 'g') AS text FROM documents""")
def latin1(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", T.latin1(F.concat(F.lit("✓ œ—"), "text", F.lit("…"))).alias("text"))


@query("txt19_limit_text", "SELECT doc_id, length(CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || chr(10) || '[... truncated ...]' ELSE text END) AS n FROM documents")
def limit_text(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", F.length(T.limit_text(F.col("text"), 1500)).cast("long").alias("n"))


@query("txt20_prompt_budget", "SELECT doc_id, least(length(text), 1500) + 500 <= 1900 AS fits FROM documents")
def prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", (F.least(F.length("text"), F.lit(1500)) + 500 <= 1900).alias("fits"))


def keyword_sql() -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(t, '{w}')" for w in ws)} THEN '{k}'" for k, ws in C.FIELD_KEYWORDS) + " END"


#: Each document with the requirement that its number stands for: half of their texts name a landowner.
ASKED = f"""asked AS (SELECT doc_id, source, r.*, category || CASE WHEN doc_id % 2 = 0 THEN ' of the landowner: ' ELSE ': ' END || coalesce(text, '') AS requirement_text FROM documents JOIN requirements r ON requirement_id = 'REQ-' || lpad(CAST(doc_id % 23 + 1 AS VARCHAR), 3, '0'))"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    d = A.table(spark, sf, "documents").select("doc_id", "source", "text", F.concat(F.lit("REQ-"), F.lpad((n % 23 + 1).cast("string"), 3, "0")).alias("requirement_id")).join(A.requirements(spark), "requirement_id")
    return d.withColumn("requirement_text", F.concat("category", F.when(n % 2 == 0, " of the landowner: ").otherwise(": "), F.coalesce("text", F.lit("")))).drop("text")


def field_config_of(text: Column) -> Column:
    """The first kind of field whose words a requirement has."""
    out, low = None, F.lower(text)
    for name, words in C.FIELD_KEYWORDS:
        test = T.contains_any(low, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


@query("txt18_field_config", f"WITH {A.REQUIREMENTS}, {ASKED}, t AS (SELECT doc_id, lower(requirement_text) AS t FROM asked) SELECT doc_id, {keyword_sql()} AS config FROM t")
def field_config(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("doc_id", field_config_of(F.col("requirement_text")).alias("config"))


PROMPT_BUDGET = prompts.Budget(document=900, instructions=120, output=40, total=3000)
PROMPT_OUTPUT = "Reply with a list of quotes as JSON."


@query("txt18_prompts", f"""WITH {A.SNIPPETS}, {A.REQUIREMENTS}, m AS (SELECT session, requirement_id, pos, '## ' || document_id || chr(10) || text || chr(10) AS text FROM snippets),
z AS (SELECT *, least(length(text), 980) AS size FROM m), l AS (SELECT *, 2836 - (sum(size) OVER (PARTITION BY session, requirement_id ORDER BY pos) - size) AS room FROM z),
c AS (SELECT *, CASE WHEN size <= room THEN 900 ELSE least(900, room - 80) END AS cap FROM l WHERE room > 80), h AS (SELECT *, substr(text, 1, CAST(cap AS BIGINT)) AS head FROM c),
k AS (SELECT *, CASE WHEN contains(head, chr(10) || chr(10)) AND instr(reverse(head), chr(10) || chr(10)) < length(head) - 1 THEN substr(head, 1, length(head) - instr(reverse(head), chr(10) || chr(10)) - 1) ELSE head END AS kept FROM h),
p AS (SELECT session, requirement_id, count(*) AS n, string_agg(CASE WHEN length(text) <= cap THEN text ELSE kept || chr(10) || chr(10) || '_[showing first ' || length(kept) || ' of ' || length(text) || ' chars]_' || chr(10) END, '' ORDER BY pos) AS texts FROM k GROUP BY ALL)
SELECT session, requirement_id, CAST(n AS INTEGER) AS n_parts, substr('Find evidence for ' || requirement_id || ', ' || category || '. Check: ' || validation_type || '. Accepted: ' || accepted_evidence || '.', 1, 120) || chr(10) || chr(10) || texts || chr(10) || chr(10) || '{PROMPT_OUTPUT}' AS prompt
FROM p JOIN requirements USING (requirement_id)""")
def requirement_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt for every requirement and session, with as many of its documents as the budget has room for."""
    group = ("session", "requirement_id")
    parts = A.snippets(spark, sf).select(*group, "pos", F.col("document_id").alias("name"), "text")
    say = F.concat(F.lit("Find evidence for "), F.col("requirement_id"), F.lit(", "), F.col("category"), F.lit(". Check: "), F.col("validation_type"), F.lit(". Accepted: "), F.col("accepted_evidence"), F.lit("."))
    requests = parts.select(*group).distinct().join(A.requirements(spark), "requirement_id").select(*group, say.alias("instructions"), F.lit(PROMPT_OUTPUT).alias("output"))
    return prompts.assembled(requests, parts, group, PROMPT_BUDGET)


@query("src05_checklist_scope", f"WITH {A.REQUIREMENTS}, {ASKED} SELECT source, scope, count(*) AS n, CAST(count(*) FILTER (mandatory) AS BIGINT) AS mandatory FROM asked GROUP BY source, scope")
def checklist_scope(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).groupBy("source", "scope").agg(F.count("*").alias("n"), F.count_if("mandatory").alias("mandatory"))


@query("jon01_expected_classes", f"WITH {A.REQUIREMENTS}, {ASKED}, e AS (SELECT doc_id, {expected_sql()} AS classes FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN category ELSE 'Other' END AS category, requirement_text AS accepted_evidence FROM asked)) SELECT doc_id, array_to_string(classes, ',') AS classes FROM e")
def expected_classes(spark: SparkSession, sf: str) -> DataFrame:
    a = asked(spark, sf)
    category = F.when(F.col("doc_id") % 3 == 0, F.col("category")).otherwise("Other")
    return a.select("doc_id", F.array_join(mapping.expected_classes(category, F.col("requirement_text")), ",").alias("classes"))


@query("flt12_project_slug", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ')--'), '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def project_slug(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "part").select("p_partkey", T.project_slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")--"))).alias("slug"))


@query("flt13_page_number", f"""WITH {A.RICH_TEXT}, s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ', Page ' || doc_id WHEN 1 THEN source || ' P. ' || doc_id WHEN 2 THEN source || ' (' || doc_id || ')' ELSE source END AS s FROM rich)
SELECT doc_id, CAST(coalesce(nullif(regexp_extract(s, '[Pp]age\\s+(\\d+)', 1), ''), nullif(regexp_extract(s, '[Pp]\\.\\s*(\\d+)', 1), ''), nullif(regexp_extract(s, '\\((\\d+)\\)', 1), ''), '-1') AS INTEGER) AS page FROM s""")
def page_number(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    s = F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit(", Page "), n)).when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit(" P. "), n)).when(F.col("doc_id") % 4 == 2, F.concat("source", F.lit(" ("), n, F.lit(")"))).otherwise(F.col("source"))
    return A.table(spark, sf, "documents").select("doc_id", F.coalesce(T.page_of(s), F.lit(-1)).alias("page"))


@query("flt14_source_parts", "WITH s AS (SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN ', DOC-' || doc_id ELSE ' REQ-7' END AS s FROM documents) SELECT doc_id, nullif(regexp_extract(s, '((?:DOC|REQ)-[A-Za-z0-9]+)', 1), '') AS ref, trim(split_part(s, ',', 1)) AS name FROM s")
def source_parts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat("source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(", DOC-"), F.col("doc_id").cast("string"))).otherwise(" REQ-7"))
    return A.table(spark, sf, "documents").select("doc_id", T.document_ref(s).alias("ref"), T.document_name(s).alias("name"))


@query("flt05_id_formats", f"WITH {A.DOC_INDEX} SELECT pos, regexp_matches('C' || lpad(CAST(pos % 100 AS VARCHAR), 2, '0') || '-' || CASE WHEN pos % 3 = 0 THEN 'x' ELSE CAST(pos AS VARCHAR) END, '^C\\d{{2}}-\\d+$') AS project, regexp_matches('REQ-' || (pos % 2000), '^REQ-\\d{{3}}$') AS requirement FROM doc_index")
def id_formats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("pos")
    project = F.concat(F.lit("C"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("-"), F.when(n % 3 == 0, "x").otherwise(n.cast("string")))
    return A.doc_index(spark, sf).select("pos", project.rlike(f"^{C.PROJECT_ID}$").alias("project"), F.concat(F.lit("REQ-"), (n % 2000).cast("string")).rlike(r"^REQ-\d{3}$").alias("requirement"))


@query("dat03_crediting_period", f"""WITH {A.RICH_TEXT}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'from 2020 to 2030' WHEN doc_id % 7 = 0 THEN 'none' ELSE tail END AS t, CASE WHEN doc_id % 5 = 0 THEN '2020-01-01' END AS a, '2030-01-01' AS b FROM rich),
x AS (SELECT *, nullif(regexp_extract(t, '(?i)(\\d+)\\s*[-–]?\\s*years?', 1), '') AS y, nullif(regexp_extract(t, '(\\d{{2}}/\\d{{2}}/\\d{{4}})\\s*(?:to|-|–)\\s*(\\d{{2}}/\\d{{2}}/\\d{{4}})', 1), '') AS d1, nullif(regexp_extract(t, '(\\d{{2}}/\\d{{2}}/\\d{{4}})\\s*(?:to|-|–)\\s*(\\d{{2}}/\\d{{2}}/\\d{{4}})', 2), '') AS d2,
 nullif(regexp_extract(t, '(\\d{{4}})\\s*(?:to|-|–)\\s*(\\d{{4}})', 1), '') AS y1, nullif(regexp_extract(t, '(\\d{{4}})\\s*(?:to|-|–)\\s*(\\d{{4}})', 2), '') AS y2 FROM t)
SELECT doc_id, coalesce(a || ' to ' || b, y || ' years (' || d1 || ' to ' || d2 || ')', y || ' years', y1 || ' to ' || y2, '_Not specified_') AS period FROM x""")
def crediting_period(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    t = F.when(n % 3 == 1, "from 2020 to 2030").when(n % 7 == 0, "none").otherwise(F.col("tail"))
    return A.rich_text(spark, sf).select("doc_id", T.crediting_period(F.when(n % 5 == 0, "2020-01-01"), F.lit("2030-01-01"), t).alias("period"))


@query("dat04_duration", """SELECT event_id, CASE WHEN s < 60 THEN s || ' seconds' WHEN s // 60 < 60 THEN (s // 60) || ' minute' || CASE WHEN s // 60 <> 1 THEN 's' ELSE '' END ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS eta FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)""")
def duration(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").select("event_id", T.duration(F.col("event_id") * 7 % 9000).alias("eta"))


@query("dat05_remaining_time", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber * 300 ELSE floor(CAST(l_partkey AS DOUBLE) / (l_suppkey % 4) * l_linenumber) END AS BIGINT) AS seconds FROM lineitem")
def remaining_time(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("l_suppkey") % 4
    s = F.when(done == 0, F.col("l_linenumber") * 300).otherwise(F.floor(F.col("l_partkey").cast("double") / F.when(done != 0, done) * F.col("l_linenumber")))
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", s.cast("long").alias("seconds"))


@query("jsn01_fenced_json", """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x ```json ' || props || ' ``` y' WHEN 1 THEN '``` ' || props || '```' ELSE props END AS r FROM events)
SELECT event_id, CAST(json_extract(trim(coalesce(nullif(regexp_extract(r, '(?s)```json\\s*(.*?)```', 1), ''), nullif(regexp_extract(r, '(?s)```\\s*(.*?)```', 1), ''), r)), '$.k') AS BIGINT) AS k, nullif(regexp_extract(r, '(\\{[^{}]*\\})', 1), '') AS flat FROM r""")
def fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id") % 3
    r = F.when(n == 0, F.concat(F.lit("x ```json "), "props", F.lit(" ``` y"))).when(n == 1, F.concat(F.lit("``` "), "props", F.lit("```"))).otherwise(F.col("props"))
    return A.table(spark, sf, "events").select("event_id", F.from_json(T.fenced_json(r), "k long")["k"].alias("k"), T.flat_object(r).alias("flat"))


@query("jsn03_reply_schema", "SELECT event_id, event_id % 5 <> 0 AND event_id % 101 / 100.0 <= 1.0 AS valid FROM events")
def reply_schema(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    c = (F.col("event_id") % 101 / 100.0).cast("double").cast("string")
    item = F.concat(F.lit('[{"field_type":"date","source":"s","reasoning":"r","confidence":'), c, F.when(F.col("event_id") % 5 == 0, "").otherwise(',"value":"v"'), F.lit("}]"))
    rows = F.from_json(item, "array<struct<value:string,field_type:string,source:string,confidence:double,reasoning:string>>")
    good = F.forall(rows, lambda x: x["value"].isNotNull() & x["field_type"].isNotNull() & x["source"].isNotNull() & x["reasoning"].isNotNull() & x["confidence"].between(0, 1))
    return e.select("event_id", good.alias("valid"))


JSON_TEXT = """'"' || array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN x = '"' THEN '\\"' WHEN x = '\\' THEN '\\\\' WHEN x = chr(10) THEN '\\n' WHEN x = chr(13) THEN '\\r' WHEN x = chr(9) THEN '\\t'
  WHEN x = chr(8) THEN '\\b' WHEN x = chr(12) THEN '\\f' WHEN unicode(x) BETWEEN 32 AND 126 THEN x WHEN unicode(x) < 65536 THEN format('\\u{{:04x}}', unicode(x))
  ELSE format('\\u{{:04x}}\\u{{:04x}}', 55296 + (unicode(x) - 65536) // 1024, 56320 + (unicode(x) - 65536) % 1024) END), '') || '"'"""


@query("key01_cache_key", f"""WITH r AS (SELECT doc_id, 'REQ-' || lpad(CAST(doc_id % 23 + 1 AS VARCHAR), 3, '0') AS req, coalesce(text, '') AS text, source || '"' || doc_id AS document_id, ['0.0', '0.1', '1e-05', '1.0', '2.5'][doc_id % 5 + 1] AS temperature FROM documents)
SELECT doc_id, substr(sha256('{{"accepted_evidence": "any \\u00e9vidence", "document_hash": "' || substr(sha256(text), 1, 16) || '", "document_id": ' || {JSON_TEXT.format(c="document_id")} || ', "model": "m-1", "prompt_version": "v2", "requirement_id": "' || req
  || '", "requirement_text": ' || {JSON_TEXT.format(c="text")} || ', "temperature": ' || temperature || '}}'), 1, 16) || '_' || ['docu', 'cros', 'stru'][doc_id % 3 + 1] AS key FROM r""")
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    n, lit = F.col("doc_id"), F.lit
    pick = lambda values, k: F.element_at(F.array(*(lit(v) for v in values)), (n % k + 1).cast("int"))
    text = F.coalesce("text", lit(""))
    key = canonical.request_key(
        F.concat(lit("REQ-"), F.lpad((n % 23 + 1).cast("string"), 3, "0")), text, lit("any évidence"), F.concat("source", lit('"'), n.cast("string")), text, lit("m-1"), pick((0.0, 0.1, 1e-05, 1.0, 2.5), 5), lit("v2"),
        pick(("document_presence", "cross_document", "structured_field"), 3),
    )
    return A.table(spark, sf, "documents").select("doc_id", key.alias("key"))


CACHE_LOG = """log AS (SELECT user_id % 50 AS k, event_id AS seq, epoch(ts) AS now, ['set', 'get', 'get', 'set', 'get', 'delete', 'get'][event_id % 7 + 1] AS call, [NULL, 600, 86400][event_id % 3 + 1] AS ttl, event_type AS value FROM events)"""


@query("cch01_cache_outcomes", f"""WITH {CACHE_LOG}, s AS (SELECT *, last_value(CASE WHEN call <> 'get' THEN {{'call': call, 'since': now, 'ttl': ttl, 'value': value}} END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM log),
h AS (SELECT *, coalesce(e.call = 'set' AND (e.ttl IS NULL OR now <= e.since + e.ttl), false) AS hit FROM s WHERE call = 'get')
SELECT 'pdf' AS namespace, 'key ' || k AS key, seq, hit, CASE WHEN hit THEN e.value END AS value FROM h""")
def cache_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    pick = lambda values, k: F.element_at(F.array(*(F.lit(v) for v in values)), (n % k + 1).cast("int"))
    log = A.table(spark, sf, "events").select(
        F.lit("pdf").alias("namespace"), F.concat(F.lit("key "), (F.col("user_id") % 50).cast("string")).alias("key"), n.alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"),
        pick(("set", "get", "get", "set", "get", "delete", "get"), 7).alias("call"), pick((None, 600, 86400), 3).cast("long").alias("ttl"), F.col("event_type").alias("value"),
    )
    return cache.replay(log)


@query("txt05_markdown_rows", "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |  |' AS line FROM nation")
def markdown_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = A.table(spark, sf, "nation")
    return n.select("n_nationkey", spreadsheet.markdown_row(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), 4).alias("line"))


PART_ROWS = """parts AS (SELECT p_brand || '.xlsx' AS path, CAST(p_partkey % 3 + 1 AS INTEGER) AS sheet_no, row_number() OVER (PARTITION BY p_brand, p_partkey % 3 ORDER BY p_partkey) AS pos, count(*) OVER (PARTITION BY p_brand, p_partkey % 3) AS n_rows,
  '| ' || p_partkey || ' | ' || trim(replace(p_name, '|', '\\|')) || ' | ' || p_size || ' |' AS line FROM part)"""


def part_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as rows of workbooks: a workbook a brand, three sheets each, with a header."""
    p, key = A.table(spark, sf, "part"), F.col("p_partkey")
    by = Window.partitionBy("p_brand", "no")
    cells = p.select("p_brand", (key % 3 + 1).cast("int").alias("no"), "p_partkey", F.array(key.cast("string"), "p_name", F.col("p_size").cast("string")).alias("cells"))
    data = cells.select("p_brand", "no", "cells", F.row_number().over(by.orderBy("p_partkey")).alias("pos"), F.count("*").over(by).alias("n_rows"))
    heads = data.filter("pos = 1").select("p_brand", "no", F.array(F.lit("key"), F.lit(" "), F.lit("a|b")).alias("cells"), F.lit(0).alias("pos"), "n_rows")
    return data.unionByName(heads).select(F.concat("p_brand", F.lit(".xlsx")).alias("path"), F.col("no").alias("sheet_no"), F.lit(3).alias("n_sheets"), F.concat(F.lit("s"), F.col("no").cast("string")).alias("sheet"), "n_rows", "pos", "cells", F.lit(None).cast("string").alias("error"))


@query("win06_rows_within", f"""WITH {PART_ROWS}, s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path, sheet_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS size FROM parts)
SELECT path, sheet_no, CAST(pos AS INTEGER) AS pos, line FROM s WHERE size <= 600 - 40""")
def rows_within(spark: SparkSession, sf: str) -> DataFrame:
    p = part_rows(spark, sf).filter("pos > 0").select("path", "sheet_no", "pos", spreadsheet.markdown_row(F.col("cells"), 3).alias("line"))
    return spreadsheet.rows_within(p, 600, 40, ("path", "sheet_no")).select("path", "sheet_no", "pos", "line")


@query("src08_workbook_texts", f"""WITH {PART_ROWS}, head AS (SELECT '| key | col_1 | a\\|b |' || chr(10) || '| --- | --- | --- |' AS h),
s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path, sheet_no ORDER BY pos ROWS UNBOUNDED PRECEDING) + length(h) AS size FROM parts, head WHERE pos <= 25),
g AS (SELECT path, sheet_no, any_value(n_rows) AS n_rows, least(any_value(n_rows), 25) AS have, any_value(h) || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY pos) FILTER (size <= 550), '') AS t, count(*) FILTER (size <= 550) AS kept FROM s GROUP BY ALL),
f AS (SELECT path, sheet_no, have, '--- Sheet "s' || sheet_no || '" (' || sheet_no || ' of 3) ---' || chr(10) || chr(10) || t
  || CASE WHEN n_rows > 25 THEN chr(10) || chr(10) || '*Truncated by row cap: showing first 25 of ' || format('{{:,}}', n_rows) || ' data rows*' ELSE '' END
  || CASE WHEN kept < have THEN chr(10) || chr(10) || '*Truncated by char cap (550): kept ' || kept || ' of ' || have || ' rows on this sheet*' ELSE '' END AS t FROM g),
w AS (SELECT path, string_agg(t, chr(10) || chr(10) ORDER BY sheet_no) AS t, CAST(sum(have) AS BIGINT) AS row_count, count(*) AS tables_found FROM f GROUP BY path),
c AS (SELECT *, length(t) AS n, 1500 - instr(reverse(substr(t, 1, 1500)), chr(10) || chr(10)) - 1 AS cut FROM w)
SELECT path, 3 AS sheet_count, row_count, tables_found, CASE WHEN n <= 1500 THEN t ELSE substr(t, 1, cut) || chr(10) || chr(10) || '*Truncated by workbook cap (1,500 chars): kept first ' || format('{{:,}}', cut) || ' of ' || format('{{:,}}', n)
  || ' total chars across 3 sheet(s). Full data remains on disk at ' || path || '.*' END AS markdown, CAST(NULL AS VARCHAR) AS error FROM c""")
def workbook_texts(spark: SparkSession, sf: str) -> DataFrame:
    """With small caps, so that all of them are met."""
    return spreadsheet.workbook_texts(part_rows(spark, sf), 25, 550, 1500)


def chunks_sql(docs: str, size: int, overlap: int, whole: int) -> str:
    """CTEs that end in chunks (doc_id, chunk_no, n_chunks, start, chunk) of the texts of docs: where each begins is found from
    the one before."""
    least = min(size // 5, 10_000)
    ends = f"""SELECT doc_id, chunk_no, start, text, n, CASE WHEN n <= {whole} THEN n WHEN fin >= n THEN n WHEN cut < start + {size // 2} THEN fin ELSE cut END AS fin FROM (
      SELECT *, CASE WHEN fin - start < {least} THEN fin WHEN contains(region, chr(10) || chr(10)) THEN low + length(region) - instr(reverse(region), chr(10) || chr(10)) + 1
        WHEN regexp_matches(region, '[.!?][ \n]') THEN low + length(regexp_extract(region, '(?s)^(.*[.!?][ \n])', 1))
        WHEN contains(region, ' ') THEN low + length(regexp_extract(region, '(?s)^(.*) ', 1)) ELSE fin END AS cut FROM (
        SELECT *, substr(text, low + 1, fin - low) AS region FROM (
          SELECT pt.doc_id, pt.chunk_no, pt.start, t.text, t.n, least(pt.start + {size}, t.n) AS fin, greatest(pt.start + {least}, least(pt.start + {size}, t.n) - {chunking.LOOK_BACK}) AS low FROM pt JOIN t ON t.doc_id = pt.doc_id)))"""
    step = f"CASE WHEN n <= {whole} THEN n WHEN fin - start - {overlap} >= {size // 10} THEN fin - start - {overlap} ELSE {size - overlap} END"
    return f"""t AS (SELECT doc_id, text, length(text) AS n FROM {docs} WHERE text IS NOT NULL),
pt AS (SELECT doc_id, 0 AS chunk_no, CAST(0 AS BIGINT) AS start FROM t UNION ALL SELECT doc_id, chunk_no + 1, start + {step} FROM ({ends}) WHERE start + {step} < n),
chunks AS (SELECT doc_id, chunk_no, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks, start, substr(text, start + 1, fin - start) AS chunk FROM ({ends}))"""


CHUNK_SIZES = {"size": 2000, "overlap": 100, "whole": 2500}


@query("txt02_chunks", f"WITH RECURSIVE {chunks_sql('documents', **CHUNK_SIZES)} SELECT * FROM chunks")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(A.table(spark, sf, "documents"), **CHUNK_SIZES)


def long_words(chunk: extraction.Chunk) -> list[extraction.Field]:
    """Words with a capital and nine letters more; every eleventh chunk fails, as a model's call may."""
    if (chunk.doc_id + chunk.number) % 11 == 0:
        raise RuntimeError(f"no reply for chunk {chunk.number}")
    return [extraction.Field("term", w, 0.5 + (chunk.number % 5) / 10, w) for w in re.findall("[A-Z][a-z]{9,}", chunk.text)]


def ids_and_dates(chunk: extraction.Chunk) -> list[extraction.Field]:
    found = [("project_id", C.PROJECT_ID, 0.9), ("date", r"\d{4}-\d{2}-\d{2}", 0.7)]
    return [extraction.Field(kind, m, sure, m) for kind, pattern, sure in found for m in re.findall(pattern, chunk.text, re.A)]


#: Stand-ins for a model's calls; any other function from a chunk to fields may be registered.
EXTRACTORS = [extraction.register(extraction.Extractor("long_words", long_words)), extraction.register(extraction.Extractor("ids_and_dates", ids_and_dates))]

EXTRACTED = f"""{A.RICH_TEXT}, {chunks_sql('rich', **CHUNK_SIZES)},
named AS (SELECT *, 'document ' || doc_id || CASE WHEN n_chunks > 1 THEN ' (chunk ' || (chunk_no + 1) || '/' || n_chunks || ')' ELSE '' END AS source FROM chunks),
terms AS (SELECT doc_id, chunk_no, source, unnest(regexp_extract_all(chunk, '[A-Z][a-z]{{9,}}')) AS value, unnest(range(0, len(regexp_extract_all(chunk, '[A-Z][a-z]{{9,}}')))) AS pos FROM named WHERE (doc_id + chunk_no) % 11 <> 0),
ids AS (SELECT doc_id, chunk_no, source, regexp_extract_all(chunk, 'C\\d{{2}}-\\d+') AS a, regexp_extract_all(chunk, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS b FROM named),
extracted AS (
  SELECT doc_id, chunk_no, CAST(pos AS INTEGER) AS pos, 'long_words' AS extractor, 'term' AS field_type, value, source, CAST(0.5 AS DOUBLE) + CAST(chunk_no % 5 AS DOUBLE) / 10 AS confidence, value AS raw_text, NULL AS error FROM terms
  UNION ALL SELECT doc_id, chunk_no, 0, 'long_words', NULL, NULL, source, NULL, NULL, 'RuntimeError: no reply for chunk ' || chunk_no FROM named WHERE (doc_id + chunk_no) % 11 = 0
  UNION ALL SELECT doc_id, chunk_no, CAST(unnest(range(0, len(a) + len(b))) AS INTEGER), 'ids_and_dates', unnest(list_concat(list_transform(a, lambda x: 'project_id'), list_transform(b, lambda x: 'date'))), unnest(list_concat(a, b)), source,
    unnest(list_concat(list_transform(a, lambda x: CAST(0.9 AS DOUBLE)), list_transform(b, lambda x: CAST(0.7 AS DOUBLE)))), unnest(list_concat(a, b)), NULL FROM ids
)"""


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract(chunking.chunk(A.rich_text(spark, sf), **CHUNK_SIZES), "long_words", "ids_and_dates")


@query("ext01_chunk_fields", f"WITH RECURSIVE {EXTRACTED} SELECT * FROM extracted")
def chunk_fields(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(spark, sf)


@query("ext02_merged_fields", f"""WITH RECURSIVE {EXTRACTED}
SELECT doc_id, field_type, value, max(confidence) AS confidence, arg_min(chunk_no, (-confidence, chunk_no, pos)) AS chunk_no, arg_min(source, (-confidence, chunk_no, pos)) AS source, any_value(raw_text) AS raw_text, count(*) AS n_found, min(chunk_no) AS first_chunk
FROM extracted WHERE error IS NULL GROUP BY doc_id, field_type, value""")
def merged_fields(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.merge(extracted(spark, sf))


@query("ext03_extraction_progress", f"""WITH RECURSIVE {EXTRACTED}, p AS (SELECT doc_id, count(DISTINCT CASE WHEN error IS NOT NULL THEN chunk_no END) AS failed, count(*) FILTER (error IS NULL) AS fields FROM extracted GROUP BY doc_id)
SELECT c.doc_id, chunks, coalesce(failed, 0) AS failed, coalesce(fields, 0) AS fields FROM (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id) c LEFT JOIN p ON p.doc_id = c.doc_id""")
def extraction_progress(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.progress(extracted(spark, sf), chunking.chunk(A.rich_text(spark, sf), **CHUNK_SIZES))


@query("txt12_tables")
def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.tables(A.rich_text(spark, sf))


@query("txt13_sections")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# A\n"), F.regexp_replace("text", r"\n", "\n## B\n"), F.lit("\n### C")).alias("text"))
    return chunking.sections(d)
