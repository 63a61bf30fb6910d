"""Published cases of the text, similarity, chunking and validation functions."""

import json

from pyspark.sql import functions as F

from docengine.functions import canonical, fuzzy
from docengine.functions import text as T
from docengine.operators import chunking, evidence, mapping, validation
from docengine.plans import registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dates_and_ids(spark):
    t = F.lit("Start 2022-08-15, or 15/08/2022, signed Aug 15, 2022; C06-4997 and C1-2")
    assert one(spark, T.dates(t)) == ["2022-08-15", "15/08/2022", "Aug 15, 2022"]
    assert one(spark, T.dates(t, month_only=True)) == ["2022-08-15", "15/08/2022", "Aug"]
    assert one(spark, T.project_ids(t)) == ["C06-4997"]
    assert one(spark, T.iso_date(F.lit("2022-13-40"))) is None
    assert one(spark, T.number(F.lit("5d"))) is None


def test_citation_and_sentence(spark):
    n = lambda x, t="string": F.lit(x).cast(t)
    assert one(spark, T.citation(n("Plan"), n("2.1"), n(7, "int"))) == "Plan (Section 2.1, p.7)"
    assert one(spark, T.citation(n("Plan"), n(None), n(None, "int"))) == "Plan"
    assert one(spark, T.citation(n(None), n("2"), n(None, "int"))) is None
    assert one(spark, T.truncate_at_sentence(F.lit("One two three. Four five six seven"), 20)) == "One two three."


def test_project_id_filter(spark):
    cases = [("4997", "", False), ("4997Botany22", "", False), ("C06-4997", "", True), ("VCS-1234", "", True), ("GS123", "", True), ("CAR77", "", True), ("C06-4997", "filename: x", False), ("P77", "Project ID: P77", True), ("P77", "", False), ("  ", "project id", False)]
    df = spark.createDataFrame(cases, "v string, raw string, want boolean")
    for r in df.withColumn("got", evidence.valid_project_id(F.col("v"), F.col("raw"))).collect():
        assert r["got"] == r["want"], r


def test_similarity():
    assert fuzzy.ratio("nick denman", "nicholas denman") < 0.8
    assert fuzzy.surname_similarity("Nick Denman", "Nicholas Denman") == 0.85
    assert fuzzy.surname_similarity("Nick Denman", "John Smith") < 0.8
    assert fuzzy.token_set_ratio("the north field", "field north the") == 100
    assert fuzzy.partial_ratio("denman", "nicholas denman esq") == 100
    assert fuzzy.citation_score("soil carbon", "The Soil Carbon plan") == 100
    assert fuzzy.citation_score("a long quote that is not there", "short") == 0
    assert fuzzy.citation_score("", "x") == 0


def test_date_alignment_goldens(spark):
    for a, b, days, status in (("2022-06-15", "2022-08-20", 66, "pass"), ("2022-01-01", "2022-05-31", 150, "fail"), ("2022-01-01", "2022-05-01", 120, "pass")):
        got = one(spark, validation.pairwise_dates(F.lit(a).cast("date"), F.lit(b).cast("date")))
        assert (got["days"], got["status"]) == (days, status)


def test_land_tenure_goldens(spark):
    rows = [("exact", 1, "Nick Denman", 120.5, "lease"), ("exact", 2, "Nick Denman", 120.5, "lease"), ("near", 1, "Nick Denman", 120.5, "lease"), ("near", 2, "Nicholas Denman", 120.5, "lease"), ("other", 1, "Nick Denman", 120.5, "lease"), ("other", 2, "John Smith", 120.5, "lease"), ("kind", 1, "A B", 1.0, "lease"), ("kind", 2, "A B", 1.0, "deed"), ("one", 1, "A", 1.0, "x")]
    got = {r["session"]: r for r in validation.land_tenure(spark.createDataFrame(rows, "session string, pos int, owner_name string, area_hectares double, tenure_type string")).collect()}
    assert (got["exact"]["status"], got["exact"]["flagged"]) == ("pass", False)
    assert got["near"]["status"] == "pass" and got["near"]["similarity"] >= 0.8 and got["near"]["flagged"]
    assert got["other"]["status"] == "fail" and got["kind"]["status"] == "warning" and got["one"]["status"] == "pass"


def test_numeric_consistency_edges(spark):
    rows = [("zero", "a", "0"), ("zero", "b", "0"), ("one", "a", "0"), ("one", "b", "-3"), ("neg", "a", "-1"), ("neg", "b", "-9"), ("single", "a", "4"), ("far", "a", "100"), ("far", "b", "90")]
    df = spark.createDataFrame([(s, d, "area_hectares", v) for s, d, v in rows], "session string, document string, field_name string, value string")
    assert {r["session"]: r["status"] for r in validation.document_checks(df, "numbers").collect()} == {"zero": "pass", "one": "warning", "neg": "pass", "far": "warning"}


def test_merge_keeps_first_of_equals(spark):
    rows = [("s", "f", 1, "a", 0.9), ("s", "f", 2, "b", 0.9), ("s", "f", 3, "c", 0.5), ("s", "g", 1, None, None), ("s", "g", 2, "x", 0.4)]
    got = {r["field_name"]: r["value"] for r in evidence.merge_best(spark.createDataFrame(rows, "session string, field_name string, pos int, value string, confidence double")).collect()}
    assert got == {"f": "a", "g": None}


def test_scope_partition(spark):
    from docengine.plans import adapters

    r = adapters.requirements(spark)
    assert (r.count(), r.filter("scope = 'farm'").count(), r.filter("scope = 'meta'").count()) == (23, 4, 19)
    assert one(spark, mapping.expected_classes(F.lit("Other"), F.lit("a deed of land")))[0] == "land_tenure"
    assert one(spark, mapping.expected_classes(F.lit("Other"), F.lit("words"))) == ["project_plan"]


def test_chunks_cover_text():
    text = "".join(f"Sentence number {i} ends here. " for i in range(2000))
    parts = chunking.split_text(text, 5000, 200, 6000)
    assert all(text[s : s + len(c)] == c for s, c in parts)
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == len(text)
    assert all(b[0] <= a[0] + len(a[1]) for a, b in zip(parts, parts[1:]))
    assert chunking.split_text("short") == [(0, "short")]


def test_tables_and_sections():
    text = "# A\n| x | y |\n|---|---|\n| 1 | 2 |\n\n## B\n### C\n## D\n"
    assert chunking.tables_of(text) == [(["x", "y"], [["1", "2"]])]
    assert [(s[0], s[1], s[4]) for s in chunking.sections_of(text)] == [(1, "A", -1), (2, "B", 0), (3, "C", 1), (2, "D", 0)]


def test_citation_scores_search_the_whole_text(spark, tmp_path):
    from docengine.plans import registry

    quote = "the quick brown fox jumps over"
    text = "-" * 20 + quote + "\n" + "filler " * 300 + quote + " zq"
    spark.createDataFrame([(2, text), (3, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    scores = {r["doc_id"]: r["score"] for r in registry.QUERIES["cit01_citation_scores"](spark, str(tmp_path)).collect()}
    assert scores == {2: 100.0, 3: 100.0}


def test_chunk_boundaries():
    assert chunking.boundary("a" * 50 + "\n\n" + "b c. d" * 8, 0, 90, 100) == 52
    assert chunking.boundary("abc. " + "d" * 40 + ". e fgh", 0, 50, 100) == 47
    text = "word " * 10
    at = chunking.boundary(text, 0, 43, 100)
    assert at == 39 and text[at] == " "
    assert chunking.boundary("x" * 80, 0, 60, 100) == 60
    assert chunking.boundary("x. " * 80, 0, 15, 100) == 15


def test_json_text_of_runs(spark):
    texts = ["", "plain \"a\\b\"", "é", "tab\t\u007f\x01é\r\n\b\f", "Ж слово \"ю\\\" 😀x😀", "\\u000aé", "中文 and more\n中"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", canonical.json_text(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r.j for r in got] == [json.dumps(t) for t in [*texts, None]]


def test_reply_is_read_once(spark, sf_dir):
    plan = registry.QUERIES["llm02_synthesis_results"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
