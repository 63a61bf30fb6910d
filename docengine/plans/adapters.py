"""The driver's tables as domain relations, each as a DataFrame and as the same relation in SQL.

Plain projections with fixed arithmetic, so that both sides are equal; nothing here is a rule of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.operators import discovery

NAMES = ("Project Plan ", "baseline_report_", "Annual Report ", "GHG Emissions ", "Lease Agreement ", "Land Cover Map ", "registry agent review ", "Methodology ", "notes ")
EXTENSIONS = (".pdf", ".shp", ".geojson", ".tif", ".xlsx", ".csv", ".jpg")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small file dealt out evenly, as they would leave most cores idle; larger inputs stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(_pick(NAMES, F.col("doc_id") % 9), F.col("doc_id").cast("string"), _pick(EXTENSIONS, F.col("doc_id") % 7))
    digest = discovery.content_hash(F.col("text"))
    out = d.select(F.col("source").alias("session"), F.col("doc_id").alias("pos"), digest.alias("content_hash"), discovery.document_id(digest).alias("document_id"), name.alias("filename"), F.length("text").cast("long").alias("size"), "lang")
    return out.withColumn("classification", discovery.classify(F.col("filename"))["label"])


def classify_sql(name: str = "lower(filename)") -> str:
    whens = " ".join(f"WHEN regexp_matches({name}, '{p}') THEN {{'label': '{label}', 'confidence': CAST({c} AS DOUBLE), 'method': 'filename'}}" for label, c, p in C.FILENAME_CLASSES)
    ext = f"regexp_extract({name}, '(\\.[^./]+)$', 1)"
    kinds = ((C.GIS_EXTENSIONS, "gis_shapefile", 0.80), (C.IMAGE_EXTENSIONS, "land_cover_map", 0.70), (C.SPREADSHEET_EXTENSIONS, "spreadsheet_data", 0.75))
    more = " ".join(f"WHEN list_contains({sql_list(e)}, {ext}) THEN {{'label': '{label}', 'confidence': CAST({c} AS DOUBLE), 'method': 'file_type'}}" for e, label, c in kinds)
    return f"CASE {whens} {more} ELSE {{'label': 'unknown', 'confidence': CAST(0.5 AS DOUBLE), 'method': 'default'}} END"


DOC_INDEX = f"""doc_index0 AS (
  SELECT source AS session, doc_id AS pos, sha256(text) AS content_hash, 'DOC-' || substr(sha256(text), 1, 8) AS document_id,
    {sql_list(NAMES)}[doc_id % 9 + 1] || doc_id || {sql_list(EXTENSIONS)}[doc_id % 7 + 1] AS filename, CAST(length(text) AS BIGINT) AS size, lang
  FROM documents
), doc_index AS (SELECT *, ({classify_sql()}).label AS classification FROM doc_index0)"""


def requirements(spark: SparkSession) -> DataFrame:
    rows = [(*r, f"evidence on {r[1].lower()}") for r in C.REQUIREMENTS]
    return spark.createDataFrame(rows, "requirement_id string, category string, mandatory boolean, validation_type string, scope string, accepted_evidence string")


REQUIREMENTS = "requirements AS (SELECT *, 'evidence on ' || lower(category) AS accepted_evidence FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(m).lower()}, '{v}', '{s}')" for a, b, m, v, s in C.REQUIREMENTS) + ") AS t(requirement_id, category, mandatory, validation_type, scope))"


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snippet for each document: its whole text."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select(
        F.col("source").alias("session"), F.concat(F.lit("REQ-"), F.lpad((F.col("doc_id") % 23 + 1).cast("string"), 3, "0")).alias("requirement_id"), F.col("doc_id").alias("pos"),
        "text", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("document_id"), ((F.col("doc_id") * 37 % 101) / 100.0).cast("double").alias("confidence"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("schema_match"), (F.col("doc_id") % 40).cast("int").alias("page"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(", p."), (F.col("doc_id") % 40).cast("string")).alias("citation"),
    )


SNIPPETS = """snippets AS (
  SELECT source AS session, 'REQ-' || lpad(CAST(d.doc_id % 23 + 1 AS VARCHAR), 3, '0') AS requirement_id, d.doc_id AS pos, text, 'D' || d.doc_id AS document_id,
    CAST(d.doc_id * 37 % 101 AS DOUBLE) / 100.0 AS confidence, coalesce(quality = 1, false) AS schema_match, CAST(d.doc_id % 40 AS INTEGER) AS page, 'doc ' || d.doc_id || ', p.' || (d.doc_id % 40) AS citation
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def session_key() -> Column:
    """An order line's session: its order and year."""
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.year("l_shipdate").cast("string"))


def fields(spark: SparkSession, sf_dir: str, *, by_session: bool = False) -> DataFrame:
    """Extracted fields from order lines: an order and year is a session, a line a document. by_session: the lines are dealt
    out by session before fields are made of them, so that what groups by session and more moves no fields."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount", "l_linestatus", "l_returnflag")
    session = session_key()
    line = line.repartition(session) if by_session else spread(line)
    hundredths = F.round(F.col("l_discount") * 100).cast("long").cast("string")
    made = F.array(
        *(F.struct(F.lit(i).alias("k"), F.lit(name).alias("field_name"), value.alias("value"), F.lit(kind).alias("value_type")) for i, (name, value, kind) in enumerate((
            ("baseline_date", F.date_format("l_shipdate", "yyyy-MM-dd"), "str"),
            ("project_start_date", F.when(F.col("l_partkey") % 5 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")), "str"),
            ("area_hectares", hundredths, "int"), ("buffer_pool_percentage", F.concat(hundredths, F.when(F.col("l_partkey") % 11 == 0, "x").otherwise("")), "str"),
            ("project_id", F.concat(F.lit("C0"), F.when(F.col("l_linestatus") == "F", "1").otherwise("2"), F.lit("-"), (F.col("l_partkey") % 3).cast("string")), "str"),
            ("owner_name", F.concat(F.when(F.col("l_partkey") % 4 == 0, "Farm of ").otherwise("Nick "), F.col("l_returnflag")), "str"),
            ("crediting_period_years", (F.col("l_partkey") % 120).cast("string"), "int"),
            ("crediting_period_start", F.date_format("l_shipdate", "yyyy-MM-dd"), "str"),
            ("crediting_period_end", F.date_format(F.date_add("l_shipdate", (F.col("l_partkey") % 9 - 3).cast("int")), "yyyy-MM-dd"), "str"),
        )))
    )
    rows = line.select(session.alias("session"), F.concat(F.lit("D"), F.col("l_linenumber").cast("string")).alias("document_id"), (((F.col("l_linenumber") * F.lit(10_000_000) + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 10).alias("base"), ((F.col("l_suppkey") % 10) / 10.0).cast("double").alias("confidence"), F.explode(made).alias("f"))
    return rows.select("session", "document_id", F.col("document_id").alias("document_name"), (F.col("base") + F.col("f.k")).cast("long").alias("pos"), F.col("f.field_name").alias("field_name"), F.col("f.value").alias("value"), F.col("f.value_type").alias("value_type"), "confidence")


FIELDS = """line AS (
  SELECT l_orderkey || '-' || year(l_shipdate) AS session, 'D' || l_linenumber AS document_id, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 10000 + l_suppkey) * 10 AS base, CAST(l_suppkey % 10 AS DOUBLE) / 10.0 AS confidence,
    strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) AS hundredths, l_partkey AS p, l_linestatus AS ls, l_returnflag AS rf,
    strftime(CAST(l_shipdate AS DATE) + CAST(l_partkey % 9 - 3 AS INTEGER), '%Y-%m-%d') AS day_end
  FROM lineitem
), fields AS (
  SELECT session, document_id, base + k AS pos, field_name, value, value_type, confidence FROM (
    SELECT *, 0 AS k, 'baseline_date' AS field_name, day AS value, 'str' AS value_type FROM line
    UNION ALL SELECT *, 1, 'project_start_date', CASE WHEN p % 5 <> 0 THEN day END, 'str' FROM line
    UNION ALL SELECT *, 2, 'area_hectares', hundredths, 'int' FROM line
    UNION ALL SELECT *, 3, 'buffer_pool_percentage', hundredths || CASE WHEN p % 11 = 0 THEN 'x' ELSE '' END, 'str' FROM line
    UNION ALL SELECT *, 4, 'project_id', 'C0' || CASE WHEN ls = 'F' THEN '1' ELSE '2' END || '-' || (p % 3), 'str' FROM line
    UNION ALL SELECT *, 5, 'owner_name', CASE WHEN p % 4 = 0 THEN 'Farm of ' ELSE 'Nick ' END || rf, 'str' FROM line
    UNION ALL SELECT *, 6, 'crediting_period_years', CAST(p % 120 AS VARCHAR), 'int' FROM line
    UNION ALL SELECT *, 7, 'crediting_period_start', day, 'str' FROM line
    UNION ALL SELECT *, 8, 'crediting_period_end', day_end, 'str' FROM line
  )
), merged AS (
  SELECT session, field_name, arg_min({'v': value}, (-confidence, pos)).v AS value, max(confidence) AS confidence, max(value_type) AS value_type FROM fields GROUP BY session, field_name
), by_document AS (
  SELECT session, document_id AS document, field_name, arg_min(value, pos) AS value FROM fields WHERE value IS NOT NULL GROUP BY ALL
)"""


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review events: a user is a session, an event's id its seq, ten entities each."""
    e = table(spark, sf_dir, "events")
    state = _pick((*C.OVERRIDES, "cleared"), F.col("event_id") % 6)
    return e.select(F.col("user_id").cast("string").alias("session"), (F.col("event_id") % 10).alias("entity"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"), state.alias("state"), "value", "props")


EVENTS_LOG = f"""log AS (
  SELECT CAST(user_id AS VARCHAR) AS session, event_id % 10 AS entity, event_id AS seq, ts, event_type AS action, CAST(user_id AS VARCHAR) AS actor,
    {sql_list((*C.OVERRIDES, "cleared"))}[event_id % 6 + 1] AS state, value, props FROM events
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    model = F.when(F.col("l_returnflag") == "A", C.PRICES[0][0]).when(F.col("l_returnflag") == "N", C.PRICES[2][0]).otherwise("unknown-model")
    q = F.col("l_quantity").cast("long")
    return line.select(
        model.alias("model"), F.concat(F.lit("extractor-"), (F.col("l_suppkey") % 7).cast("string")).alias("extractor"), (F.col("l_orderkey") % 50).cast("string").alias("session"),
        (q * 100).alias("input_tokens"), (q * 10).alias("output_tokens"), (q * 3).alias("cache_creation_tokens"), (q * 7).alias("cache_read_tokens"), (F.col("l_linestatus") == "F").alias("cached"),
    )


CALLS = f"""calls AS (
  SELECT CASE l_returnflag WHEN 'A' THEN '{C.PRICES[0][0]}' WHEN 'N' THEN '{C.PRICES[2][0]}' ELSE 'unknown-model' END AS model, 'extractor-' || (l_suppkey % 7) AS extractor, CAST(l_orderkey % 50 AS VARCHAR) AS session,
    CAST(l_quantity AS BIGINT) * 100 AS input_tokens, CAST(l_quantity AS BIGINT) * 10 AS output_tokens, CAST(l_quantity AS BIGINT) * 3 AS cache_creation_tokens, CAST(l_quantity AS BIGINT) * 7 AS cache_read_tokens, l_linestatus = 'F' AS cached
  FROM lineitem
), prices AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {a}, {b}, {c}, {d})" for m, a, b, c, d in C.PRICES)}) AS t(pm, pi, po, pw, pr)),
costs AS (
  SELECT calls.*, CASE WHEN cached THEN 0.0 ELSE CAST(input_tokens AS DOUBLE) * CAST(coalesce(pi, {C.PRICES[0][1]}) AS DOUBLE) + CAST(output_tokens AS DOUBLE) * CAST(coalesce(po, {C.PRICES[0][2]}) AS DOUBLE)
    + CAST(cache_creation_tokens AS DOUBLE) * CAST(coalesce(pw, {C.PRICES[0][3]}) AS DOUBLE) + CAST(cache_read_tokens AS DOUBLE) * CAST(coalesce(pr, {C.PRICES[0][4]}) AS DOUBLE) END AS micro_usd
  FROM calls LEFT JOIN prices ON model = pm
)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return both.select("doc_id", F.col("lang").alias("category"), F.col("quality").alias("system"), F.col("toxic").alias("human"))


VERDICTS = "verdicts AS (SELECT l.doc_id, lang AS category, quality AS system, toxic AS human FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts with a tail that holds what the domain's patterns look for."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    month = F.lpad(s(n % 12 + 1), 2, "0")
    tail = F.concat(
        F.lit(" Start 2022-"), month, F.lit("-15, signed Mar 3, 2021 and "), s(n % 28 + 1), F.lit("/"), month, F.lit("/2023; "), s(n % 500), F.lit(".5 ha, "), s(n % 100), F.lit("% done, C06-"), s(n),
        F.lit(" page "), s(n % 40), F.lit(" | a | b |\n| a | b |\n|---|---|\n| 1 | 2 |\n"), s(n % 30), F.lit(" years 01/02/2020 to 01/02/2030"),
    )
    return d.select("doc_id", "source", F.concat(F.col("text"), tail).alias("text"), tail.alias("tail"))


RICH_TEXT = """tails AS (
  SELECT doc_id, source, text AS body, ' Start 2022-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-15, signed Mar 3, 2021 and ' || (doc_id % 28 + 1) || '/' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '/2023; '
    || (doc_id % 500) || '.5 ha, ' || (doc_id % 100) || '% done, C06-' || doc_id || ' page ' || (doc_id % 40) || ' | a | b |' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10)
    || (doc_id % 30) || ' years 01/02/2020 to 01/02/2030' AS tail FROM documents
), rich AS (SELECT doc_id, source, body || tail AS text, tail FROM tails)"""
