"""Queries of evidence, checks, review state, costs, agreement and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import canonical
from docengine.functions import text as T
from docengine.operators import evidence, metrics, report, review, session_reports, validation
from docengine.plans import adapters as A

Q: dict = {}
S: dict[str, str] = {}
AS_OF_YEAR = 1994


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn

    return add


# evidence

STATUS = f"""{A.REQUIREMENTS}, {A.SNIPPETS}, found AS (SELECT session, requirement_id, count(*) AS n, max(confidence) AS best FROM snippets GROUP BY ALL),
status AS (
  SELECT s.session, r.requirement_id, coalesce(n, 0) AS n_snippets, coalesce(best, 0.0) AS confidence, CASE WHEN n IS NULL THEN 'missing' WHEN best > 0.8 THEN 'covered' ELSE 'partial' END AS status
  FROM (SELECT DISTINCT session FROM snippets) s CROSS JOIN requirements r LEFT JOIN found f ON f.session = s.session AND f.requirement_id = r.requirement_id
), cover AS (
  SELECT session, count(*) AS total, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'missing') AS missing,
    (count(*) FILTER (status = 'covered') + 0.5::DOUBLE * count(*) FILTER (status = 'partial')) / count(*) AS overall FROM status GROUP BY session
)"""


@query("agg02_requirement_status", f"WITH {STATUS} SELECT session, requirement_id, n_snippets, confidence, status FROM status")
def requirement_status(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.requirement_status(A.requirements(spark), A.snippets(spark, sf))


@query("agg02_gated_status", f"""WITH {A.REQUIREMENTS}, {A.SNIPPETS}, found AS (SELECT session, requirement_id, count(*) AS n, max(confidence) AS best FROM snippets WHERE schema_match GROUP BY ALL)
SELECT s.session, r.requirement_id, coalesce(n, 0) AS n_snippets, coalesce(best, 0.0) AS confidence, CASE WHEN n IS NULL THEN 'missing' WHEN best > 0.8 THEN 'covered' ELSE 'partial' END AS status
FROM (SELECT DISTINCT session FROM snippets) s CROSS JOIN requirements r LEFT JOIN found f ON f.session = s.session AND f.requirement_id = r.requirement_id""")
def gated_status(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.requirement_status(A.requirements(spark), A.snippets(spark, sf), gate_schema_match=True)


@query("agg03_coverage", f"WITH {STATUS} SELECT * FROM cover")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.coverage(requirement_status(spark, sf))


@query("win02_first_snippets", f"WITH {A.SNIPPETS} SELECT session, requirement_id, pos, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session, requirement_id ORDER BY pos) AS INTEGER) AS rank FROM snippets) WHERE rank <= 3")
def first_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.first_snippets(A.snippets(spark, sf), 3).select("session", "requirement_id", "pos", "rank")


@query("jon05_mapped_texts", f"WITH {A.SNIPPETS} SELECT s.session, requirement_id, s.document_id, d.n_chars FROM snippets s JOIN documents d ON s.pos = d.doc_id")
def mapped_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "n_chars")
    return A.snippets(spark, sf).join(d, "pos").select("session", "requirement_id", "document_id", "n_chars")


@query("jon06_evidence_matrix", f"""WITH {STATUS}, first AS (SELECT session, requirement_id, arg_min(text, pos) AS text, arg_min(document_id, pos) AS document_id FROM snippets GROUP BY ALL)
SELECT s.session, s.requirement_id, s.status, validation_type, substr(text, 1, 300) AS snippet, document_id, validation_type IN ('document_presence', 'cross_document', 'structured_field', 'date_alignment') AS auto_validatable
FROM status s LEFT JOIN first f ON f.session = s.session AND f.requirement_id = s.requirement_id LEFT JOIN requirements r ON r.requirement_id = s.requirement_id""")
def evidence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    s = A.snippets(spark, sf)
    return evidence.evidence_matrix(A.requirements(spark), requirement_status(spark, sf), s)


@query("flt11_auto_validatable", f"WITH {A.REQUIREMENTS} SELECT o_orderkey, coalesce(validation_type IN ('document_presence', 'cross_document', 'structured_field', 'date_alignment'), false) AS auto FROM orders LEFT JOIN requirements ON requirement_id = 'REQ-' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 3, '0')")
def auto_validatable(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("REQ-"), F.lpad((F.col("o_orderkey") % 30).cast("string"), 3, "0")).alias("requirement_id"))
    kind = F.col("validation_type").isin("document_presence", "cross_document", "structured_field", "date_alignment")
    return o.join(F.broadcast(A.requirements(spark)), "requirement_id", "left").select("o_orderkey", F.coalesce(kind, F.lit(False)).alias("auto"))


@query("flt07_routed_snippets", f"""WITH {A.SNIPPETS}, route AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{r}')" for k, rs in C.FIELD_SOURCES for r in rs)}) AS t(kind, requirement_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY session, requirement_id ORDER BY pos) AS rank FROM snippets JOIN route USING (requirement_id)) SELECT session, requirement_id, kind, pos FROM r WHERE rank <= 5""")
def routed_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.routed_snippets(A.snippets(spark, sf)).select("session", "requirement_id", "kind", "pos")


@query("flt06_unconverted_mapped", f"WITH {A.SNIPPETS} SELECT doc_id FROM documents d WHERE doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM snippets s WHERE s.pos = d.doc_id)")
def unconverted_mapped(spark: SparkSession, sf: str) -> DataFrame:
    mapped = A.snippets(spark, sf).select(F.col("pos").alias("doc_id"))
    return A.table(spark, sf, "documents").filter("doc_id % 2 = 0").join(mapped, "doc_id", "left_semi").select("doc_id")


# extracted fields and checks


@query("agg07_merge_best", f"WITH {A.FIELDS} SELECT session, field_name, value, confidence FROM merged")
def merge_best(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.merge_best(A.fields(spark, sf, by_session=True).drop("value_type"))


@query("agg08_merge_by_document", f"WITH {A.FIELDS} SELECT session, document, field_name, value FROM by_document")
def merge_by_document(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.merge_by_document(A.fields(spark, sf, by_session=True))


@query("agg10_last_by_document", f"""WITH {A.FIELDS}, f AS (SELECT session, document_id, arg_min(confidence, pos) AS confidence FROM fields GROUP BY ALL), l AS (SELECT session, document_id, field_name, arg_max({{'v': value}}, pos).v AS value FROM fields GROUP BY ALL)
SELECT l.session, l.document_id, field_name, value, confidence FROM l JOIN f ON l.session = f.session AND l.document_id = f.document_id""")
def last_by_document(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.last_by_document(A.fields(spark, sf, by_session=True))


@query("agg11_dedup_values", f"WITH {A.FIELDS} SELECT session, field_name, value, max(confidence) AS confidence, arg_min(document_id, (-confidence, pos)) AS document_id FROM fields GROUP BY session, field_name, value")
def dedup_values(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.dedup_values(A.fields(spark, sf, by_session=True))


@query("agg13_dedup_project_ids", f"WITH {A.FIELDS} SELECT value, max(confidence) AS confidence FROM fields WHERE field_name = 'project_id' GROUP BY value")
def dedup_project_ids(spark: SparkSession, sf: str) -> DataFrame:
    return A.fields(spark, sf).filter("field_name = 'project_id'").groupBy("value").agg(F.max("confidence").alias("confidence"))


@query("flt04_valid_project_ids", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'C06-' || o_orderkey WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '4997Botany22' WHEN 3 THEN 'VCS-' || o_orderkey WHEN 4 THEN ' ' ELSE 'P-' || o_orderkey END AS v,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Project ID: x' WHEN o_orderkey % 7 = 0 THEN 'see plan.pdf' ELSE '' END AS raw FROM orders)
SELECT o_orderkey, trim(v) <> '' AND NOT regexp_matches(v, '^\\d+$') AND NOT regexp_matches(v, '^\\d{4}[A-Za-z]+\\d{2}$') AND NOT contains(lower(raw), '.pdf') AND (regexp_matches(v, '^(C\\d{2}-\\d+|VCS-?\\d+|GS-?\\d+|CAR\\d+|ACR\\d+)$') OR contains(lower(raw), 'project id')) AS valid FROM x""")
def valid_project_ids(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    v = F.when(k % 6 == 0, F.concat(F.lit("C06-"), s)).when(k % 6 == 1, s).when(k % 6 == 2, "4997Botany22").when(k % 6 == 3, F.concat(F.lit("VCS-"), s)).when(k % 6 == 4, " ").otherwise(F.concat(F.lit("P-"), s))
    raw = F.when(k % 5 == 0, "Project ID: x").when(k % 7 == 0, "see plan.pdf").otherwise("")
    return A.table(spark, sf, "orders").select("o_orderkey", evidence.valid_project_id(v, raw).alias("valid"))


@query("agg12_fuzzy_owners")
def fuzzy_owners(spark: SparkSession, sf: str) -> DataFrame:
    f = A.fields(spark, sf).filter("field_name = 'owner_name'").select(F.regexp_extract("session", r"-(\d+)$", 1).alias("session"), "document_id", "value", "confidence", "pos")
    return evidence.fuzzy_owners(f)


def merged_fields(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.merge_best(A.fields(spark, sf, by_session=True))


def names(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


STRUCTURAL = f"""{A.FIELDS}, sessions AS (SELECT DISTINCT session FROM merged), rules AS (SELECT * FROM (VALUES {", ".join(f"('{n}', true)" for n in C.REQUIRED_FIELDS)}, {", ".join(f"('{n}', false)" for n in C.RECOMMENDED_FIELDS)}) AS t(field_name, required)),
have AS (SELECT session, field_name FROM merged WHERE value IS NOT NULL AND value <> '' AND NOT (value_type = 'int' AND TRY_CAST(value AS DOUBLE) = 0)),
presence AS (SELECT s.session, 'presence' AS check_type, r.field_name, CASE WHEN required THEN CASE WHEN h.session IS NOT NULL THEN 'pass' ELSE 'fail' END WHEN h.session IS NULL THEN 'warning' END AS status, required AND h.session IS NULL AS flagged
  FROM sessions s CROSS JOIN rules r LEFT JOIN have h ON h.session = s.session AND h.field_name = r.field_name),
format AS (SELECT session, 'format' AS check_type, field_name, CASE WHEN regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND TRY_CAST(value AS DATE) IS NOT NULL THEN 'pass' ELSE 'warning' END AS status FROM merged WHERE field_name IN {names(C.DATE_FIELDS)} AND value IS NOT NULL AND value <> ''),
idformat AS (SELECT session, 'format' AS check_type, field_name, CASE WHEN regexp_matches(value, '^\\d{{4}}$') THEN 'fail' WHEN regexp_matches(value, '^C\\d{{2}}-\\d+$') OR regexp_matches(value, '^\\d{{4}}[A-Za-z]+\\d{{2}}$') THEN 'pass' ELSE 'warning' END AS status FROM merged WHERE field_name = 'project_id' AND value IS NOT NULL AND value <> ''),
daterange AS (SELECT session, 'range' AS check_type, field_name, CASE WHEN year(TRY_CAST(value AS DATE)) > {AS_OF_YEAR} + CASE WHEN contains(field_name, 'end') OR contains(field_name, 'permanence') THEN 50 ELSE 2 END OR year(TRY_CAST(value AS DATE)) < 1990 THEN 'warning' WHEN TRY_CAST(value AS DATE) IS NOT NULL THEN 'pass' END AS status FROM merged WHERE field_name IN {names(C.RANGE_DATE_FIELDS)}),
percent AS (SELECT session, 'range' AS check_type, field_name, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN 'warning' WHEN TRY_CAST(value AS DOUBLE) < 0 OR TRY_CAST(value AS DOUBLE) > 100 THEN 'fail' ELSE 'pass' END AS status FROM merged WHERE field_name IN {names(C.PERCENTAGE_FIELDS)} AND value IS NOT NULL),
area AS (SELECT session, 'range' AS check_type, field_name, CASE WHEN TRY_CAST(value AS DOUBLE) <= 0 THEN 'fail' WHEN TRY_CAST(value AS DOUBLE) > 1000000 THEN 'warning' WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'pass' END AS status FROM merged WHERE field_name = 'area_hectares'),
period AS (SELECT session, 'range' AS check_type, field_name, CASE WHEN TRY_CAST(value AS BIGINT) <= 0 OR TRY_CAST(value AS BIGINT) > 100 THEN 'warning' WHEN TRY_CAST(value AS BIGINT) IS NOT NULL THEN 'pass' END AS status FROM merged WHERE field_name IN {names(C.PERIOD_FIELDS)}),
ends AS (SELECT session, max(CASE WHEN field_name = 'crediting_period_start' THEN TRY_CAST(value AS DATE) END) AS cs, max(CASE WHEN field_name = 'crediting_period_end' THEN TRY_CAST(value AS DATE) END) AS ce FROM merged GROUP BY session),
consistent AS (SELECT session, 'consistency' AS check_type, 'crediting_period' AS field_name, CASE WHEN ce <= cs THEN 'fail' WHEN ce > cs THEN 'pass' END AS status FROM ends),
generic AS (SELECT session, 'generic' AS check_type, field_name, CASE WHEN {" OR ".join(f"contains(lower(value), '{t}')" for t in C.GENERIC_OWNER_TERMS)} THEN 'fail' ELSE 'pass' END AS status FROM merged WHERE field_name = 'owner_name' AND value IS NOT NULL AND value <> ''),
structural AS (
  SELECT * FROM presence WHERE status IS NOT NULL
  UNION ALL SELECT *, status <> 'pass' FROM (SELECT * FROM format UNION ALL SELECT * FROM idformat UNION ALL SELECT * FROM daterange UNION ALL SELECT * FROM percent UNION ALL SELECT * FROM area UNION ALL SELECT * FROM period UNION ALL SELECT * FROM consistent UNION ALL SELECT * FROM generic) WHERE status IS NOT NULL
)"""


@query("str10_structural_checks", f"WITH {STRUCTURAL} SELECT session, check_type, field_name, status, flagged FROM structural")
def structural_checks(spark: SparkSession, sf: str) -> DataFrame:
    return validation.structural(merged_fields(spark, sf), AS_OF_YEAR)


def _structural_part(name: str, cte: str, fn) -> None:
    flag = "flagged" if cte == "presence" else "status <> 'pass' AS flagged"
    query(name, f"WITH {STRUCTURAL} SELECT session, check_type, field_name, status, {flag} FROM {cte} WHERE status IS NOT NULL")(lambda spark, sf: fn(merged_fields(spark, sf)))


_structural_part("str01_required_fields", "presence", lambda f: validation.session_checks(f, periods=False))
_structural_part("str02_date_format", "format", lambda f: validation.field_checks(f, AS_OF_YEAR, "date_format"))
_structural_part("str03_project_id_format", "idformat", lambda f: validation.field_checks(f, AS_OF_YEAR, "project_id"))
_structural_part("str04_date_range", "daterange", lambda f: validation.field_checks(f, AS_OF_YEAR, "date_range"))
_structural_part("str05_percentage_range", "percent", lambda f: validation.field_checks(f, AS_OF_YEAR, "percentage"))
_structural_part("str06_area_range", "area", lambda f: validation.field_checks(f, AS_OF_YEAR, "area"))
_structural_part("str07_period_range", "period", lambda f: validation.field_checks(f, AS_OF_YEAR, "period"))
_structural_part("str08_period_consistency", "consistent", lambda f: validation.session_checks(f, presence=False))
_structural_part("str09_generic_owner", "generic", lambda f: validation.field_checks(f, AS_OF_YEAR, "owner"))

#: The owner names that the adapter makes, and the similarity of each two, worked out by hand, as SQL has no function for it:
#: twice the letters in common over both lengths.
OWNERS = [(a, b) for a in ("farm of", "nick") for b in "anr"]


def similarity_by_hand(a: tuple[str, str], b: tuple[str, str]) -> str:
    if a == b:
        return "1.0"
    if a[0] == b[0]:
        return "16.0 / 18.0" if a[0] == "farm of" else "10.0 / 12.0"
    return "4.0 / 15.0" if a[1] == b[1] else "2.0 / 15.0"


SIMILAR = ", ".join(f"('{' '.join(a)}', '{' '.join(b)}', CAST(CAST({similarity_by_hand(a, b).replace(' / ', ' AS DOUBLE) / CAST(')} AS DOUBLE) AS DOUBLE))" for a in OWNERS for b in OWNERS)

CROSS = f"""{A.FIELDS}, dates AS (SELECT session, 'date_alignment' AS check_type, field_name, CASE WHEN date_diff('day', min(TRY_CAST(value AS DATE)), max(TRY_CAST(value AS DATE))) <= {C.MAX_DAYS_APART} THEN 'pass' ELSE 'warning' END AS status
  FROM by_document WHERE field_name IN {names(C.ALIGNED_DATE_FIELDS)} GROUP BY session, field_name HAVING count(TRY_CAST(value AS DATE)) >= 2),
ids AS (SELECT session, 'id_consistency' AS check_type, field_name, CASE WHEN count(DISTINCT value) = 1 THEN 'pass' ELSE 'fail' END AS status FROM by_document WHERE field_name = 'project_id' GROUP BY session, field_name HAVING count(value) >= 2),
nums AS (SELECT session, field_name, min(TRY_CAST(value AS DOUBLE)) AS lo, max(TRY_CAST(value AS DOUBLE)) AS hi FROM by_document WHERE field_name IN {names(C.NUMERIC_FIELDS)} GROUP BY session, field_name HAVING count(TRY_CAST(value AS DOUBLE)) >= 2),
numeric_ AS (SELECT session, 'numeric_consistency' AS check_type, field_name, CASE WHEN CASE WHEN hi = 0 THEN CASE WHEN lo = 0 THEN 0 ELSE 1 END ELSE (hi - lo) / hi END <= {C.NUMERIC_TOLERANCE} THEN 'pass' ELSE 'warning' END AS status FROM nums),
own AS (SELECT session, field_name, lower(trim(value)) AS name, min(document) AS pos, count(*) AS n FROM by_document WHERE field_name IN {names(C.NAME_FIELDS)} GROUP BY ALL),
similar_(a, b, s) AS (VALUES {SIMILAR}),
least_ AS (SELECT x.session, x.field_name, min(s) AS similarity FROM own x JOIN own y ON x.session = y.session AND x.field_name = y.field_name AND (x.pos, x.name) < (y.pos, y.name) JOIN similar_ ON a = x.name AND b = y.name GROUP BY ALL),
named AS (SELECT session, 'name_consistency' AS check_type, field_name, CASE WHEN kinds = 1 THEN 'pass' WHEN similarity >= {C.NAME_SIMILARITY} THEN 'warning' ELSE 'fail' END AS status, coalesce(similarity, 1.0) AS similarity
  FROM (SELECT session, field_name, count(*) AS kinds, sum(n) AS n FROM own GROUP BY ALL) LEFT JOIN least_ USING (session, field_name) WHERE n >= 2)"""
_cross = "SELECT session, check_type, field_name, status, status <> 'pass' AS flagged FROM "


ALL_CROSS = f"{_cross} dates UNION ALL {_cross} ids UNION ALL {_cross} numeric_ UNION ALL {_cross} named"


@query("xdc01_date_alignment", f"WITH {CROSS} {_cross} dates")
def date_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return validation.document_checks(merge_by_document(spark, sf), "dates")


@query("xdc03_id_consistency", f"WITH {CROSS} {_cross} ids")
def id_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return validation.document_checks(merge_by_document(spark, sf), "ids")


@query("xdc04_numeric_consistency", f"WITH {CROSS} {_cross} numeric_")
def numeric_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return validation.document_checks(merge_by_document(spark, sf), "numbers")


@query("xdc02_name_consistency", f"WITH {CROSS} SELECT session, check_type, field_name, status, status <> 'pass' AS flagged, similarity FROM named")
def name_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return validation.name_consistency(merge_by_document(spark, sf))


@query("xdc05_cross_document", f"WITH {CROSS} {ALL_CROSS}")
def cross_document(spark: SparkSession, sf: str) -> DataFrame:
    return validation.cross_document(merge_by_document(spark, sf))


SUMMARY = """session, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (flagged) AS flagged,
  count(*) FILTER (status = 'pass') / count(*) AS pass_rate, count(*) FILTER (status = 'fail') = 0 AND count(*) FILTER (flagged) = 0 AS all_passed"""


@query("agg14_validation_summary", f"""WITH {CROSS}, checks AS ({ALL_CROSS}) SELECT {SUMMARY} FROM checks GROUP BY session""")
def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validation.summary(cross_document(spark, sf))


#: Replies of a model for the sessions of order lines: one with two flags, one without, one that is no JSON, and none.
@query("agg15_layer_summary", f"""WITH {STRUCTURAL}, {CROSS.removeprefix(A.FIELDS + ", ")}, checks AS (SELECT *, 1 AS layer FROM structural UNION ALL SELECT *, 2 FROM ({ALL_CROSS})),
c AS (SELECT {SUMMARY}, count(*) FILTER (layer = 1) AS structural_checks, count(*) FILTER (layer = 2) AS cross_document_checks, CAST(split_part(session, '-', 1) AS BIGINT) % 4 AS kind FROM checks GROUP BY session)
SELECT session, total, passed, warnings, failed, flagged + CASE WHEN kind = 0 THEN 2 ELSE 0 END AS flagged, pass_rate, structural_checks, cross_document_checks, kind < 2 AS synthesis_available, all_passed AND kind <> 0 AS all_passed FROM c""")
def layer_summary(spark: SparkSession, sf: str) -> DataFrame:
    order, session = F.col("l_orderkey"), A.session_key()
    flags = F.concat(F.lit('```json\n{"coherence_score": 0.5, "flags_for_review": ["order '), order.cast("string"), F.lit('", "b {"]}\n```'))
    reply = F.when(order % 4 == 0, flags).when(order % 4 == 1, '{"coherence_score": 1, "flags_for_review": []}').when(order % 4 == 2, "sorry")
    judged = A.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").repartition(session).select(session.alias("session"), reply.alias("reply")).distinct().select("session", validation.synthesis_result(F.col("reply")).alias("result"))
    return validation.layer_summary(structural_checks(spark, sf), cross_document(spark, sf), judged)


@query("llm02_synthesis_results", """SELECT doc_id, k < 3 AS available, CASE WHEN k < 2 THEN (doc_id % 10) / 10.0::DOUBLE WHEN k = 2 THEN 0.25 END AS coherence_score, CASE WHEN k < 2 THEN 'partial' END AS compliance_status, CASE WHEN k < 2 THEN coalesce(text, '') END AS reasoning,
  CASE WHEN k < 2 THEN source || ';' || lang WHEN k = 2 THEN 'x' ELSE '' END AS flags, CASE k WHEN 3 THEN 'no JSON object in the reply' WHEN 4 THEN 'no JSON object in the reply' WHEN 5 THEN 'no reply' END AS error
FROM (SELECT *, doc_id % 6 AS k FROM documents)""")
def synthesis_results(spark: SparkSession, sf: str) -> DataFrame:
    """Replies that hold each document's whole text: fenced, bare, within prose, broken, no object, none."""
    n, lit, j = F.col("doc_id"), F.lit, canonical.json_text
    kind = n % 6
    whole = F.concat(lit('{"coherence_score": 0.'), (n % 10).cast("string"), lit(', "compliance_status": "partial", "flags_for_review": ['), j(F.col("source")), lit(", "), j(F.col("lang")), lit('], "nested": {"a": [{}]}, "reasoning": '), j(F.coalesce("text", lit(""))), lit("}"))
    before, after = (F.when(kind == 0, x).otherwise("") for x in ("Here it is:\n```json\n", "\n```\nDone."))
    others = ['I think {"coherence_score": 0.25, "flags_for_review": ["x"]} holds {', '```json\n{"coherence_score": }\n```', " [1, 2]", None]
    reply = F.when(kind < 2, F.concat(before, whole, after)).otherwise(F.element_at(F.array(*map(lit, others)), (kind - 1).cast("int")))
    r = validation.synthesis_result(reply)
    out = A.table(spark, sf, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.*")
    return out.withColumn("flags", F.array_join("flags_for_review", ";")).drop("flags_for_review")


@query("crd01_session_validation", f"""WITH {STRUCTURAL}, {CROSS.removeprefix(A.FIELDS + ", ")}, checks AS (SELECT * FROM structural UNION ALL {ALL_CROSS}), s AS (SELECT {SUMMARY} FROM checks GROUP BY session),
wanted AS (SELECT DISTINCT l_orderkey || '-' || (year(l_shipdate) + CAST(l_linenumber % 2 AS INTEGER)) AS session FROM lineitem)
SELECT w.session, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, coalesce(warnings, 0) AS warnings, coalesce(failed, 0) AS failed, coalesce(flagged, 0) AS flagged, coalesce(pass_rate, 0.0) AS pass_rate, coalesce(all_passed, false) AS all_passed
FROM wanted w LEFT JOIN s ON w.session = s.session""")
def session_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with and without evidence; those without have an empty result."""
    year = F.year("l_shipdate") + (F.col("l_linenumber") % 2).cast("int")
    wanted = A.table(spark, sf, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), year.cast("string")).alias("session"))
    return validation.summary(structural_checks(spark, sf).unionByName(cross_document(spark, sf)), wanted)


@query("agg16_checks_by_type", f"WITH {STRUCTURAL} SELECT check_type, field_name, status, count(*) AS n FROM structural GROUP BY ALL")
def checks_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return structural_checks(spark, sf).groupBy("check_type", "field_name", "status").agg(F.count("*").alias("n"))


@query("leg01_pairwise_dates", "SELECT o_orderkey, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-15')) AS INTEGER) AS days, CASE WHEN abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-15')) <= 120 THEN 'pass' ELSE 'fail' END AS status FROM orders")
def pairwise_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = validation.pairwise_dates(F.col("o_orderdate").cast("date"), F.lit("1995-06-15").cast("date"))
    return A.table(spark, sf, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", "d.*")


@query("leg02_land_tenure")
def land_tenure(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders")
    names_ = F.concat(F.element_at(F.array(F.lit("Nick "), F.lit("Nicholas "), F.lit("John ")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.when(F.col("o_custkey") % 4 == 0, "Denman").otherwise("Smith"))
    return validation.land_tenure(o.select(F.col("o_custkey").cast("string").alias("session"), F.col("o_orderkey").alias("pos"), names_.alias("owner_name"), (F.col("o_custkey") % 50 + F.col("o_orderkey") % 3).cast("double").alias("area_hectares"), F.col("o_orderstatus").alias("tenure_type")))


@query("leg03_project_ids", """WITH occ AS (SELECT CAST(l_suppkey AS VARCHAR) AS session, CASE WHEN l_suppkey % 3 = 0 THEN 'C01-' || (l_partkey % 2) WHEN l_suppkey % 7 = 0 THEN 'bad' ELSE 'C02-7' END AS project_id, CAST(l_orderkey % 4 AS VARCHAR) AS document_id, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
per AS (SELECT session, project_id, count(*) AS c, min(pos) AS first FROM occ GROUP BY ALL), prim AS (SELECT session, arg_min(project_id, (-c, first)) AS primary_id, count(*) AS kinds, CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (NOT regexp_matches(project_id, '^C\\d{2}-\\d+$')) AS bad FROM per GROUP BY session),
docs AS (SELECT session, count(DISTINCT document_id) AS documents FROM occ GROUP BY session), i AS (SELECT *, concat_ws('; ', CASE WHEN bad > 0 THEN 'invalid pattern' END, CASE WHEN kinds > 1 THEN 'several ids' END, CASE WHEN n < 3 THEN 'few occurrences' END, CASE WHEN documents < 3 THEN 'few documents' END) AS issues FROM prim JOIN docs USING (session))
SELECT session, primary_id, kinds AS n_ids, n AS n_occurrences, documents AS n_documents, issues, CASE WHEN issues = '' THEN 'pass' WHEN kinds = 1 AND bad = 0 THEN 'warning' ELSE 'fail' END AS status FROM i""")
def project_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_suppkey")
    pid = F.when(k % 3 == 0, F.concat(F.lit("C01-"), (F.col("l_partkey") % 2).cast("string"))).when(k % 7 == 0, "bad").otherwise("C02-7")
    return validation.project_ids(A.table(spark, sf, "lineitem").select(k.cast("string").alias("session"), pid.alias("project_id"), (F.col("l_orderkey") % 4).cast("string").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")))


@query("cit01_exact_citations", """SELECT d.doc_id, contains(lower(text), lower(trim(substr(text, 11, 40)))) AS found FROM documents d""")
def exact_citations(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", F.lower("text").contains(F.lower(F.trim(F.substring("text", 11, 40)))).alias("found"))


@query("cit01_citation_scores")
def citation_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes from each text, every other one with a word that is not there; each is looked for in its whole text."""
    d = A.table(spark, sf, "documents").select("doc_id", F.concat(F.substring("text", 21, 30), F.when(F.col("doc_id") % 2 == 0, " zq").otherwise("")).alias("quote"), F.col("text").alias("source"))
    return validation.verified_citations(d)


@query("cit02_adjusted_confidence", """SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN c * 0.5 WHEN s < 75 THEN greatest(0.0, c - 0.3) ELSE c END AS DOUBLE) AS confidence, CASE WHEN doc_id % 4 = 0 THEN 'no_citation' WHEN s < 75 THEN 'failed' ELSE 'verified' END AS verification
FROM (SELECT doc_id, CAST(doc_id % 101 AS DOUBLE) / 100 AS c, CAST(doc_id * 7 % 100 AS DOUBLE) AS s FROM documents)""")
def adjusted_confidence(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    a = validation.adjusted_confidence((n % 101).cast("double") / 100, F.when(n % 4 == 0, "  ").otherwise("q"), (n * 7 % 100).cast("double"))
    return A.table(spark, sf, "documents").select("doc_id", a.alias("a")).select("doc_id", "a.*")


# review state


@query("win03_sequential_ids", f"WITH {A.EVENTS_LOG} SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS id FROM log")
def sequential_ids(spark: SparkSession, sf: str) -> DataFrame:
    return review.sequential_ids(A.events_log(spark, sf)).select("session", "seq", "id")


@query("win04_history", f"WITH {A.EVENTS_LOG} SELECT session, entity, seq, state, lag(state) OVER (PARTITION BY session, entity ORDER BY seq) AS previous FROM log")
def history(spark: SparkSession, sf: str) -> DataFrame:
    return review.history(A.events_log(spark, sf)).select("session", "entity", "seq", "state", "previous")


@query("win05_latest_state", f"WITH {A.EVENTS_LOG}, l AS (SELECT session, entity, arg_max(state, seq) AS state, max(seq) AS seq FROM log GROUP BY ALL) SELECT * FROM l WHERE state <> 'cleared'")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return review.latest(A.events_log(spark, sf))


@query("agg21_override_counts", f"WITH {A.EVENTS_LOG}, l AS (SELECT session, entity, arg_max(state, seq) AS state FROM log GROUP BY ALL) SELECT session, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in C.OVERRIDES)}, count(*) AS total FROM l WHERE state <> 'cleared' GROUP BY session")
def override_counts(spark: SparkSession, sf: str) -> DataFrame:
    return review.override_counts(latest_state(spark, sf))


@query("agg22_audit_counts", f"WITH {A.EVENTS_LOG} SELECT 'action' AS kind, action AS key, count(*) AS n FROM log GROUP BY action UNION ALL SELECT 'actor', actor, count(*) FROM log GROUP BY actor")
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return review.audit_counts(A.events_log(spark, sf))


@query("lim01_tail", f"WITH {A.EVENTS_LOG} SELECT seq, action FROM log WHERE action = 'click' ORDER BY seq DESC LIMIT 100")
def tail(spark: SparkSession, sf: str) -> DataFrame:
    return review.tail(A.events_log(spark, sf).filter("action = 'click'"), 100).select("seq", "action")


@query("lim02_newest", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def newest(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey")


@query("srt02_priority_rank", "SELECT o_orderkey, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '5' THEN 3 ELSE 4 END AS INTEGER) AS rank FROM orders")
def priority_rank(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "orders").select("o_orderkey", review.priority_rank(priority()).alias("rank"))


def priority():
    p = F.substring("o_orderpriority", 1, 1)
    return F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").when(p == "5", "low").otherwise("other")


@query("flt09_revision_summary", """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS session, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'resolved' END AS status, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '5' THEN 'low' ELSE 'other' END AS priority FROM orders)
SELECT session, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status <> 'pending') AS resolved, count(*) FILTER (status = 'pending' AND priority = 'critical') AS critical, count(*) FILTER (status = 'pending' AND priority = 'high') AS high,
 count(*) FILTER (status = 'pending' AND priority = 'medium') AS medium, count(*) FILTER (status = 'pending' AND priority = 'low') AS low FROM r GROUP BY session""")
def revision_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = A.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("session"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("resolved").alias("status"), priority().alias("priority"))
    return review.revision_summary(r)


@query("rev06_side_effects", """SELECT CAST(user_id AS VARCHAR) AS session, event_id % 10 AS entity, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'cleared' WHEN 2 THEN 'needs_revision' ELSE 'pending' END AS state FROM events WHERE event_id % 5 < 4""")
def side_effects(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(x) for x in ("override_set", "override_cleared", "revision_requested", "revision_resolved", "annotation_added"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), (F.col("event_id") % 10).alias("entity"), F.col("event_id").alias("seq"), kind.alias("action"), F.lit("approved").alias("value"))
    return review.with_side_effects(e)


@query("rev04_determination", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, ['approve', 'conditional', 'reject', 'hold', 'cleared'][event_id % 5 + 1] AS state, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'n' END AS notes, CASE WHEN event_id % 2 = 0 THEN 'c' END AS conditions FROM events),
g AS (SELECT * FROM e WHERE state = 'cleared' OR (notes <> '' AND (state <> 'conditional' OR conditions IS NOT NULL))) SELECT session, nullif(arg_max(state, seq), 'cleared') AS determination, max(seq) AS seq FROM g GROUP BY session""")
def determination(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    state = F.element_at(F.array(*(F.lit(x) for x in (*C.DETERMINATIONS, "cleared"))), (n % 5 + 1).cast("int"))
    e = A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), n.alias("seq"), state.alias("state"), F.when(n % 3 == 0, "").otherwise("n").alias("notes"), F.when(n % 2 == 0, "c").alias("conditions"))
    return review.determination(e)


@query("flt16_derived_status", "SELECT o_orderkey, " + "CASE " + " ".join(f"WHEN o_orderkey // {2**i} % 3 = 1 THEN '{label}'" for i, (_, label) in enumerate(C.STAGES)) + " ELSE 'Initialized' END AS status FROM orders")
def derived_status(spark: SparkSession, sf: str) -> DataFrame:
    done = {k: F.floor(F.col("o_orderkey") / 2**i) % 3 == 1 for i, (k, _) in enumerate(C.STAGES)}
    return A.table(spark, sf, "orders").select("o_orderkey", review.derived_status(done).alias("status"))


# costs, agreement, progress


@query("jon11_call_costs", f"WITH {A.CALLS} SELECT model, extractor, count(*) AS n, CAST(sum(CAST(round(micro_usd * 1000) AS BIGINT)) AS BIGINT) AS nano FROM costs GROUP BY ALL")
def call_costs(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.call_costs(A.calls(spark, sf))
    return c.groupBy("model", "extractor").agg(F.count("*").alias("n"), F.sum(F.round(F.col("micro_usd") * 1000).cast("long")).alias("nano"))


def cost_sql(key: str) -> str:
    return f"SELECT {key}, count(*) AS calls, CAST(CAST(sum(CAST(round(micro_usd * 1000) AS BIGINT)) AS BIGINT) AS DOUBLE) / 1e9 AS cost_usd, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) FILTER (cached) / count(*) AS hit_rate FROM costs GROUP BY {key}"


@query("agg17_session_costs", f"WITH {A.CALLS} {cost_sql('session')}")
def session_costs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cost_summary(metrics.call_costs(A.calls(spark, sf)), "session")


@query("agg18_extractor_costs", f"WITH {A.CALLS} {cost_sql('extractor')}")
def extractor_costs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cost_summary(metrics.call_costs(A.calls(spark, sf)), "extractor")


@query("agg28_expensive", f"WITH {A.CALLS} SELECT * FROM ({cost_sql('session')}) WHERE cost_usd > 0.10")
def expensive(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.expensive(metrics.call_costs(A.calls(spark, sf)), "session")


@query("agg25_agreement", f"""WITH {A.VERDICTS}, c AS (SELECT category, count(*) AS n, count(*) FILTER (system = human) AS e, count(*) FILTER (system < human) AS u, count(*) FILTER (system > human) AS o FROM verdicts GROUP BY category), z AS (SELECT *, e / n AS p, 1.959963984540054::DOUBLE AS z FROM c)
SELECT category, n, e / n AS exact_rate, u / n AS under_rate, o / n AS over_rate, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS ci_low, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS ci_high FROM z""")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.agreement(A.verdicts(spark, sf), "category")


@query("agg25_confusion", f"WITH {A.VERDICTS} SELECT system, human, count(*) AS n FROM verdicts GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(A.verdicts(spark, sf))


@query("agg26_set_scores", f"""WITH {A.VERDICTS}, f AS (SELECT DISTINCT category, doc_id % 200 AS k FROM verdicts WHERE system = 1), e AS (SELECT DISTINCT category, doc_id % 200 AS k FROM verdicts WHERE human = 0),
j AS (SELECT coalesce(f.category, e.category) AS category, count(*) FILTER (f.k IS NOT NULL AND e.k IS NOT NULL) AS hit, count(f.k) AS nf, count(e.k) AS ne FROM f FULL JOIN e ON f.category = e.category AND f.k = e.k GROUP BY 1)
SELECT category, CASE WHEN nf > 0 THEN hit / nf ELSE 0.0 END AS precision, CASE WHEN ne > 0 THEN hit / ne ELSE 0.0 END AS recall, CASE WHEN nf + ne > 0 THEN 2 * hit / (nf + ne) ELSE 0.0 END AS f1 FROM j""")
def set_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = A.verdicts(spark, sf).withColumn("k", F.col("doc_id") % 200)
    return metrics.set_scores(v.filter("system = 1"), v.filter("human = 0"), "k", "category")


@query("agg27_value_match", """WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(p_brand) WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS a, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 8 = 0 THEN p_brand END WHEN 1 THEN lower(p_brand) || ' x' WHEN 2 THEN CAST(p_partkey + 3 AS VARCHAR) ELSE p_type END AS b FROM part),
y AS (SELECT *, TRY_CAST(a AS DOUBLE) AS x, TRY_CAST(b AS DOUBLE) AS z FROM x)
SELECT p_partkey, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL WHEN x IS NOT NULL AND z IS NOT NULL AND z <> 0 THEN abs(x - z) / abs(z) <= 0.01 ELSE contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) END AS correct FROM y""")
def value_match(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    a = F.when(k % 4 == 1, F.upper("p_brand")).when(k % 4 == 2, k.cast("string")).when(k % 4 == 3, F.col("p_name"))
    b = F.when(k % 8 == 0, F.col("p_brand")).when(k % 4 == 1, F.concat(F.lower("p_brand"), F.lit(" x"))).when(k % 4 == 2, (k + 3).cast("string")).when(k % 4 == 3, F.col("p_type"))
    return A.table(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b")).select("p_partkey", metrics.value_match(F.col("a"), F.col("b")).alias("correct"))


@query("agg20_conversion_progress", f"""WITH {A.DOC_INDEX}, d AS (SELECT session || '-' || (pos // 7 % 40) AS session, CASE WHEN pos % 5 <> 0 THEN 'complete' ELSE 'pending' END AS fast_status, ['complete', 'converting', 'queued', 'pending'][pos % 4 + 1] AS hq_status FROM doc_index WHERE filename LIKE '%.pdf'),
c AS (SELECT session, count(*) AS pdfs, count(*) FILTER (fast_status = 'complete') AS fast, count(*) FILTER (hq_status = 'complete') AS hq, count(*) FILTER (hq_status = 'converting') AS converting, count(*) FILTER (hq_status = 'queued') AS queued FROM d GROUP BY session)
SELECT *, (3 * fast + 7 * hq) / (10 * pdfs) AS progress, (converting + queued) * 5 AS minutes_left, CASE WHEN hq = pdfs THEN 'All ' || pdfs || ' documents fully processed (high-quality)' WHEN fast = pdfs AND converting > 0 THEN 'Fast analysis ready. High-quality processing: ' || hq || '/' || pdfs || ' complete'
 WHEN fast = pdfs AND queued > 0 THEN 'Fast analysis ready. ' || queued || ' documents queued for high-quality conversion' WHEN fast = pdfs THEN 'Fast analysis complete for all ' || pdfs || ' documents. High-quality conversion available.'
 WHEN fast > 0 THEN 'Fast: ' || fast || '/' || pdfs || ' ready. HQ: ' || hq || '/' || pdfs || ' complete' ELSE 'No documents processed yet' END AS message FROM c""")
def conversion_progress(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("pos")
    d = A.doc_index(spark, sf).filter(F.col("filename").endswith(".pdf"))
    hq = F.element_at(F.array(*(F.lit(x) for x in ("complete", "converting", "queued", "pending"))), (n % 4 + 1).cast("int"))
    return metrics.conversion_progress(d.select(F.concat("session", F.lit("-"), (F.floor(n / 7) % 40).cast("string")).alias("session"), "filename", F.when(n % 5 != 0, "complete").otherwise("pending").alias("fast_status"), hq.alias("hq_status")))


@query("agg24_completion", f"WITH {STATUS} SELECT session, CASE WHEN overall * 100 >= 90 AND missing = 0 AND length(session) % 2 = 0 THEN 'READY' WHEN overall * 100 >= 80 AND missing <= 2 THEN 'CONDITIONAL' ELSE 'MAJOR REVISIONS' END AS assessment FROM cover")
def completion(spark: SparkSession, sf: str) -> DataFrame:
    c = coverage(spark, sf)
    return c.select("session", metrics.completion(F.col("overall") * 100, F.col("missing"), F.length("session") % 2).alias("assessment"))


@query("agg29_repeated_names", "SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.repeated_names(A.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")))


# reports

FINDINGS = f"""{STATUS}, cites AS (SELECT session, requirement_id, list(citation ORDER BY pos)[1:5] AS citations, count(DISTINCT document_id) AS n_documents FROM snippets GROUP BY ALL),
findings AS (SELECT s.session, s.requirement_id, status, confidence, n_snippets, coalesce(n_documents, 0) AS n_documents, CASE WHEN status = 'missing' THEN 'none' WHEN confidence >= 0.8 THEN 'strong' WHEN confidence >= 0.5 THEN 'partial' ELSE 'limited' END AS strength,
  status IN ('partial', 'missing', 'flagged') OR confidence < 0.8 AS review, coalesce(citations, []) AS citations FROM status s LEFT JOIN cites c ON c.session = s.session AND c.requirement_id = s.requirement_id),
titled AS (SELECT f.*, category, category || ' evidence for the review of this project, as the checklist of the program asks for it in this row' AS title FROM findings f JOIN requirements r ON r.requirement_id = f.requirement_id)"""


def findings_frame(spark: SparkSession, sf: str) -> DataFrame:
    return report.findings(requirement_status(spark, sf), A.snippets(spark, sf))


def titled(spark: SparkSession, sf: str) -> DataFrame:
    r = A.requirements(spark).select("requirement_id", "category", F.concat("category", F.lit(" evidence for the review of this project, as the checklist of the program asks for it in this row")).alias("title"))
    return findings_frame(spark, sf).join(F.broadcast(r), "requirement_id")


@query("agg19_findings", f"WITH {FINDINGS} SELECT session, requirement_id, status, confidence, n_snippets, n_documents, strength, review, array_to_string(citations, ';') AS citations FROM findings")
def findings(spark: SparkSession, sf: str) -> DataFrame:
    return findings_frame(spark, sf).withColumn("citations", F.array_join("citations", ";"))


LINES = f"""{FINDINGS}, lines AS (SELECT session, requirement_id, list_filter(['### ' || requirement_id || ': ' || substr(title, 1, 80) || CASE WHEN length(title) > 80 THEN '...' ELSE '' END, '**Status:** ' || upper(status[1]) || status[2:],
  '**Evidence:** ' || n_snippets || ' snippet(s) from ' || n_documents || ' document(s)', CASE WHEN len(citations) > 0 THEN '**Citations:** ' || array_to_string(citations[1:3], ', ') END, CASE WHEN len(citations) > 3 THEN '  (and ' || (len(citations) - 3) || ' more)' END], lambda x: x IS NOT NULL) AS ls FROM titled)"""


@query("snk05_requirement_lines", f"WITH {LINES} SELECT session, requirement_id, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM lines")
def requirement_lines(spark: SparkSession, sf: str) -> DataFrame:
    return report.requirement_lines(titled(spark, sf))


@query("snk04_report_text", f"WITH {LINES} SELECT session, string_agg(array_to_string(ls, chr(10)), chr(10) ORDER BY requirement_id) AS text FROM lines GROUP BY session")
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_text(requirement_lines(spark, sf).withColumn("section", F.lit(1)))


@query("snk06_check_lines", f"WITH {CROSS}, c AS ({_cross} dates) SELECT session, check_type, '- **' || CASE status WHEN 'pass' THEN 'PASS:' WHEN 'warning' THEN 'WARNING:' ELSE 'FAIL:' END || '**' || CASE WHEN flagged THEN ' [Review]' ELSE '' END || ' ' || field_name AS line FROM c")
def check_lines(spark: SparkSession, sf: str) -> DataFrame:
    return report.check_lines(date_alignment(spark, sf))


@query("snk08_checklist_rows", f"WITH {FINDINGS} SELECT session, requirement_id, '| ' || category || ' | ' || title || ' | ' || requirement_id || ' | ' || array_to_string(citations, '; ') || ' | ' || CASE WHEN status = 'covered' AND confidence >= 0.8 THEN '✓' WHEN status = 'missing' THEN '✗' ELSE '⚠' END || ' | ' || upper(status[1]) || status[2:] || ' |' AS line FROM titled")
def checklist_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.checklist_rows(titled(spark, sf))


@query("snk10_status_color", f"WITH {FINDINGS} SELECT session, requirement_id, CASE WHEN review AND status <> 'covered' THEN 'purple' WHEN status = 'covered' AND confidence >= 0.8 THEN 'green' WHEN status = 'partial' OR (confidence >= 0.5 AND confidence < 0.8) THEN 'orange' WHEN status = 'missing' OR confidence < 0.5 THEN 'red' ELSE 'blue' END AS color FROM findings")
def status_color(spark: SparkSession, sf: str) -> DataFrame:
    return findings_frame(spark, sf).select("session", "requirement_id", report.status_color(F.col("status"), F.col("confidence"), F.col("review")).alias("color"))


@query("snk13_preview_counts", f"WITH {STATUS} SELECT session, total, covered, partial, missing, CAST(round_even(100.0::DOUBLE * covered / total, 0) AS BIGINT) AS percent FROM cover")
def preview_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.preview_counts(requirement_status(spark, sf))


#: Projects and checks of each source: a check for each language on how long its documents are.
REPORTED = f"""{LINES}, langs AS (SELECT source AS session, coalesce(lang, '-') AS lang, count(*) AS n, min(coalesce(n_chars, 0)) AS least, max(coalesce(n_chars, 0)) AS most FROM documents WHERE source IS NOT NULL GROUP BY ALL),
checks AS (SELECT session, CASE WHEN lang = 'en' THEN 'date_alignment' ELSE 'project_id' END AS check_type, CASE WHEN least >= 200 THEN 'pass' WHEN most >= 200 THEN 'warning' ELSE 'fail' END AS status, lang || ' in ' || n || ' documents' AS message FROM langs),
projects AS (SELECT session, 'Project | ' || session AS project_name, CASE WHEN length(session) % 2 = 0 THEN 'C06-' || session END AS project_id, count(*) AS n_documents FROM langs GROUP BY session)"""


@query("snk03_markdown_reports", f"""WITH {REPORTED},
t AS (SELECT session, count(*) AS total, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'missing') AS missing, sum(n_snippets) AS snippets, count(*) FILTER (review) AS to_review FROM titled GROUP BY session),
k AS (SELECT session, count(*) AS n, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'fail') AS failed FROM checks GROUP BY session),
heads AS (SELECT p.session, array_to_string(list_filter(['# Registry Agent Review', '', '## Project Metadata', '- **Project Name:** ' || project_name, '- **Project ID:** ' || project_id, '- **Methodology:** soil', '- **Review Date:** 2024-05-06 07:08:09 UTC', '', '## Summary', '', '### Requirements Coverage',
  '- **Total Requirements:** ' || total, '- **Covered:** ' || covered || format(' ({{:.1f}}%)', 100.0::DOUBLE * covered / total), '- **Partial:** ' || partial || format(' ({{:.1f}}%)', 100.0::DOUBLE * partial / total), '- **Missing:** ' || missing || format(' ({{:.1f}}%)', 100.0::DOUBLE * missing / total),
  '- **Overall Coverage:** ' || format('{{:.1f}}%', 100.0::DOUBLE * (covered + 0.5::DOUBLE * partial) / total), '', '### Cross-Document Validation', '- **Total Checks:** ' || n, '- **Passed:** ' || passed, '- **Warnings:** ' || warnings, '- **Failed:** ' || failed, '',
  '### Review Statistics', '- **Documents Reviewed:** ' || n_documents, '- **Evidence Snippets Extracted:** ' || snippets, '- **Items Requiring Human Review:** ' || to_review, ''], lambda x: x IS NOT NULL), chr(10)) AS head FROM projects p JOIN t ON t.session = p.session JOIN k ON k.session = p.session),
b AS (SELECT l.session, status, string_agg(array_to_string(ls, chr(10)) || chr(10), chr(10) ORDER BY l.requirement_id) AS block FROM lines l JOIN status s ON s.session = l.session AND s.requirement_id = l.requirement_id GROUP BY ALL),
blocks AS (SELECT session, max('## Covered Requirements' || chr(10) || chr(10) || block) FILTER (status = 'covered') AS covered, max('## Partially Covered Requirements' || chr(10) || chr(10) || block) FILTER (status = 'partial') AS partial, max('## Missing Requirements' || chr(10) || chr(10) || block) FILTER (status = 'missing') AS missing FROM b GROUP BY session),
c AS (SELECT session, check_type, string_agg('- **' || CASE status WHEN 'pass' THEN 'PASS:**' WHEN 'warning' THEN 'WARNING:** [Review]' ELSE 'FAIL:** [Review]' END || ' ' || message, chr(10) ORDER BY '- **' || CASE status WHEN 'pass' THEN 'PASS:**' WHEN 'warning' THEN 'WARNING:** [Review]' ELSE 'FAIL:** [Review]' END || ' ' || message) AS ls FROM checks GROUP BY ALL),
results AS (SELECT session, '## Cross-Document Validation Results' || chr(10) || chr(10) || string_agg(CASE check_type WHEN 'project_id' THEN '### Project Ids' ELSE '### Date Alignments' END || chr(10) || chr(10) || ls || chr(10), chr(10) ORDER BY check_type) || chr(10) AS results FROM c GROUP BY session),
i AS (SELECT session, requirement_id, row_number() OVER (PARTITION BY session ORDER BY requirement_id) || '. ' || requirement_id || ': ' || substr(title, 1, 80) || '... (Status: ' || status || ', Confidence: ' || format('{{:.2f}}', confidence) || ')' AS item FROM titled WHERE review),
items AS (SELECT session, '## Items Requiring Human Review' || chr(10) || chr(10) || string_agg(item, chr(10) ORDER BY requirement_id) || chr(10) AS items FROM i GROUP BY session)
SELECT h.session, concat_ws(chr(10), head, covered, partial, missing, results, items, array_to_string(['## Next Steps', '', '1. Review items flagged for human review', '2. Verify partial requirements have sufficient evidence', '3. Address any validation warnings or failures', '4. Make final approval decision', ''], chr(10))) AS text
FROM heads h LEFT JOIN blocks b ON b.session = h.session LEFT JOIN results r ON r.session = h.session LEFT JOIN items i ON i.session = h.session""")
def markdown_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Whole reports of all sources, each one text."""
    lang, n = F.coalesce("lang", F.lit("-")), F.coalesce("n_chars", F.lit(0))
    langs = A.table(spark, sf, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("session"), lang.alias("lang")).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))
    status = F.when(F.col("least") >= 200, "pass").when(F.col("most") >= 200, "warning").otherwise("fail")
    checks = langs.select("session", F.when(F.col("lang") == "en", "date_alignment").otherwise("project_id").alias("check_type"), status.alias("status"), (status != "pass").alias("flagged"), F.concat("lang", F.lit(" in "), F.col("n").cast("string"), F.lit(" documents")).alias("message"))
    project = F.when(F.length("session") % 2 == 0, F.concat(F.lit("C06-"), "session"))
    projects = langs.groupBy("session").agg(F.sort_array(F.collect_list("lang")).alias("documents")).select("session", F.concat(F.lit("Project | "), "session").alias("project_name"), project.alias("project_id"), F.lit("soil").alias("methodology"), F.lit("2024-05-06 07:08:09").alias("reviewed_at"), "documents")
    return session_reports.markdown_texts(projects, titled(spark, sf), checks)


@query("txt10_snippet_value", """WITH f AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN MAP {'owner_name': 'Ann ' || doc_id} WHEN 1 THEN MAP {'zeta': 'z', 'alpha': 'a' || doc_id} ELSE MAP {'area': ''} END AS m, CASE WHEN doc_id % 8 = 2 THEN 'x' || doc_id END AS ex, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Ann ' || doc_id WHEN doc_id % 4 = 1 THEN 'a' || doc_id WHEN ex IS NOT NULL THEN ex WHEN strpos(c, '. ') - 1 > 0 AND strpos(c, '. ') - 1 < 200 THEN substr(c, 1, strpos(c, '. ')) WHEN length(c) <= 200 THEN c ELSE 'cut' END AS value FROM f""")
def snippet_value(spark: SparkSession, sf: str) -> DataFrame:
    n, s = F.col("doc_id"), F.col("doc_id").cast("string")
    m = F.when(n % 4 == 0, F.create_map(F.lit("owner_name"), F.concat(F.lit("Ann "), s))).when(n % 4 == 1, F.create_map(F.lit("zeta"), F.lit("z"), F.lit("alpha"), F.concat(F.lit("a"), s))).otherwise(F.create_map(F.lit("area"), F.lit("")))
    d = A.table(spark, sf, "documents").select("doc_id", "text", T.snippet_value(m, F.when(n % 8 == 2, F.concat(F.lit("x"), s)), F.col("text")).alias("v"))
    clean = T.squeeze(F.col("text"))
    cut = (n % 4 > 1) & (n % 8 != 2) & ~((F.instr(clean, ". ") > 1) & (F.instr(clean, ". ") <= 200)) & (F.length(clean) > 200)
    return d.select("doc_id", F.when(cut, "cut").otherwise(F.col("v")).alias("value"))
