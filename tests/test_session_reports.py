"""Reports in five formats: texts by hand, files read back, and what a failed write leaves."""

import json
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from docengine.functions import pages
from docengine.operators import session_reports as S
from docengine.sources import session_files as W

TEMPLATE = "1. #\n1. # **Part**\n\n\n\n| Project Name |  |\n| **Project ID** | C06-___ |\n| **Crediting period** |  |\n| **Date of Submission** |  |\n| **Documents Submitted:** |  |\n[ ] Approved  [ ] Not Approved\nOutcome Summary  Required Actions:\n| **Category** | **Requirement** | old |\n| row |"


@pytest.fixture(scope="module")
def given(spark):
    projects = spark.createDataFrame(
        [("a/b", "Name | one", "C06-1", "soil", "2024-01-02 03:04:05", "10 years", "Ann", ["x.pdf", "y.pdf"]), ("empty", None, None, None, None, None, None, None)],
        "session string, project_name string, project_id string, methodology string, reviewed_at string, crediting_period string, proponent string, documents array<string>",
    )
    found = spark.createDataFrame(
        [("a/b", "REQ-002", "partial", 0.5, 1, 1, ["x.pdf (p.2)"], True, "Land", "T" * 101), ("a/b", "REQ-001", "covered", 0.9, 4, 2, list("pqrst"), False, "General", "First – ✓"), ("a/b", "REQ-003", "missing", 0.0, 0, 0, [], True, "Land", ""), ("other", "REQ-001", "covered", 0.9, 4, 2, [], False, "General", "First")],
        "session string, requirement_id string, status string, confidence double, n_snippets long, n_documents long, citations array<string>, review boolean, category string, title string",
    )
    checks = spark.createDataFrame([("a/b", "project_id", "fail", True, "id (x)"), ("a/b", "date_alignment", "pass", False, "dates"), ("a/b", "date_alignment", "pass", False, "dates")], "session string, check_type string, status string, flagged boolean, message string")
    snippets = spark.createDataFrame([("a/b", "REQ-001", 1, "p", "v <1> & \x01", "Some text."), ("a/b", "REQ-001", 2, "q", "w", "More."), ("a/b", "REQ-002", 1, "x.pdf (p.2)", "u", None)], "session string, requirement_id string, pos long, citation string, value string, text string")
    return projects, found, checks, snippets


MARKDOWN = f"""# Registry Agent Review

## Project Metadata
- **Project Name:** Name | one
- **Project ID:** C06-1
- **Methodology:** soil
- **Review Date:** 2024-01-02 03:04:05 UTC

## Summary

### Requirements Coverage
- **Total Requirements:** 3
- **Covered:** 1 (33.3%)
- **Partial:** 1 (33.3%)
- **Missing:** 1 (33.3%)
- **Overall Coverage:** 50.0%

### Cross-Document Validation
- **Total Checks:** 3
- **Passed:** 2
- **Warnings:** 0
- **Failed:** 1

### Review Statistics
- **Documents Reviewed:** 2
- **Evidence Snippets Extracted:** 5
- **Items Requiring Human Review:** 2

## Covered Requirements

### REQ-001: First – ✓
**Status:** Covered
**Evidence:** 4 snippet(s) from 2 document(s)
**Citations:** p, q, r
  (and 2 more)

## Partially Covered Requirements

### REQ-002: {"T" * 80}...
**Status:** Partial
**Evidence:** 1 snippet(s) from 1 document(s)
**Citations:** x.pdf (p.2)

## Missing Requirements

### REQ-003: 
**Status:** Missing
**Evidence:** 0 snippet(s) from 0 document(s)

## Cross-Document Validation Results

### Date Alignments

- **PASS:** dates
- **PASS:** dates

### Project Ids

- **FAIL:** [Review] id (x)


## Items Requiring Human Review

1. REQ-002: {"T" * 80}... (Status: partial, Confidence: 0.50)
2. REQ-003: ... (Status: missing, Confidence: 0.00)

## Next Steps

1. Review items flagged for human review
2. Verify partial requirements have sufficient evidence
3. Address any validation warnings or failures
4. Make final approval decision
"""


def texts(df):
    return {r["session"]: r["text"] for r in df.collect()}


def test_markdown(given):
    got = texts(S.markdown_texts(*given[:3]))
    assert set(got) == {"a/b", "empty"} and got["a/b"] == MARKDOWN
    assert "- **Covered:** 0 (0.0%)" in got["empty"] and "Cross-Document" not in got["empty"] and "Project ID" not in got["empty"]
    assert "**Confidence:** 0.50 (50%)" in texts(S.markdown_texts(*given[:3], detailed=True))["a/b"]


def test_json(given):
    got = {k: json.loads(v) for k, v in texts(S.json_texts(*given[:3])).items()}
    a = got["a/b"]
    assert [r["requirement_id"] for r in a["requirements"]] == ["REQ-001", "REQ-002", "REQ-003"] and a["summary"]["overall"] == 0.5 and len(a["validations"]) == 3 and len(a["items_for_review"]) == 2
    assert a["requirements"][0]["evidence_summary"] == "Strong evidence found across 2 document(s)" and got["empty"]["requirements"] == [] and got["empty"]["metadata"]["project_id"] is None


def test_checklist(given):
    projects, found, checks, snippets = given
    cells = S.checklist_cells(found, snippets, projects)
    got = texts(S.checklist_texts(TEMPLATE, S.totals(projects, found, checks), cells))
    lines = got["a/b"].split("\n")
    assert got["a/b"].startswith("\n## **Part**\n\n| Project Name | Name \\| one |\n| **Project ID** | C06-1 |\n| **Crediting period** | 10 years |\n| **Date of Submission** | 2024-01-02 |\n| **Documents Submitted:** | 2 document(s): x.pdf, y.pdf |\n[ ] Approved  [X] Not Approved\nOutcome Summary: 1/3 requirements covered. Required Actions:\n")
    assert "| row |" not in got["a/b"] and lines[-7].startswith("| General | First – ✓ | Strong evidence found across 2 document(s) | v &lt;1&gt; & \x01<br>**Primary Documentation:** [C06-1] p<br>**Supplementary:** [C06-1] q | ✓ | Confidence: 90%<br>Evidence: Some text. |")
    assert lines[-6].startswith(f"| Land | {'T' * 100}... |") and "_No evidence found_ | ✗ | Confidence: 0%<br>Human review needed |" in lines[-5]
    assert "| Project Name |  |" in got["empty"] and "0 documents" in got["empty"] and "0/0 requirements" in got["empty"]
    with pytest.raises(ValueError):
        S.checklist_texts("no table", projects, cells)


def pdf_text(data: bytes) -> list[str]:
    """Shown strings of each page, by the table of places at the end."""
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF", data)[1])
    places = [int(x[:10]) for x in data[start:].split(b"\n")[3:] if x.endswith(b" n ")]
    assert all(data[p:].startswith(b"%d 0 obj" % i) for i, p in enumerate(places, 1))
    out = []
    for p in places:
        found = re.match(rb"\d+ 0 obj\n<</Length (\d+)/Filter/FlateDecode>>stream\n", data[p:])
        if found:
            body = zlib.decompress(data[p + found.end() : p + found.end() + int(found[1])]).decode("latin-1")
            out.append("\n".join(re.sub(r"\\([\\()])", r"\1", s) for s in re.findall(r"Td \((.*)\) Tj ET", body)))
    return out


def test_pdf_pages():
    assert pdf_text(pages.pdf("# A (b) \\ c\n\n**x:** é")) == ["A (b) \\ c\n\nx: é"]
    many = pdf_text(pages.pdf("\n".join(f"line {i}" for i in range(500))))
    assert len(many) == 10 and "\n".join(many).split("\n") == [f"line {i}" for i in range(500)]
    assert max(map(len, pdf_text(pages.pdf("w" * 1000))[0].split("\n"))) == 82 and pdf_text(pages.pdf("")) == [""]


@pytest.mark.parametrize("format", ["markdown", "json", "checklist", "docx", "pdf"])
def test_files(given, tmp_path, format):
    at = tmp_path / "out"
    W.write_reports(str(at), format, *given[:3], given[3], TEMPLATE)
    name = W.C.REPORT_FILES[format]
    assert sorted(str(p.relative_to(at)) for p in at.rglob("*") if p.is_file()) == [f"a%2Fb/{name}", f"empty/{name}"]
    data = (at / "a%2Fb" / name).read_bytes()
    if format == "markdown":
        assert data.decode() == MARKDOWN
    if format == "pdf":
        text = "\n".join(pdf_text(data))
        assert "REQ-001: First - Y" in text and "Confidence: 0.90 (90%)" in text and "Citations: p, q, r (and 2 more)" in text
    if format == "docx":
        with zipfile.ZipFile(at / "a%2Fb" / name) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        w = "{%s}" % pages.W
        first, second = [[["".join(t.text or "" for t in c.iter(w + "t")) for c in r.iter(w + "tc")] for r in t.iter(w + "tr")] for t in root.iter(w + "tbl")]
        assert first[0] == ["Project Name", "Name | one"] and [r[0] for r in second] == ["Checklist", "Category", "General", "Land", "Land"]
        assert second[2][3] == "v <1> & Primary Documentation: [C06-1] pSupplementary: [C06-1] q" and second[4][3] == "No evidence found"
        assert [c.get(w + "val") for c in root.iter(w + "color")][-1] == "800080"


def test_failed_writes_leave_nothing(spark, given, tmp_path):
    with pytest.raises(ValueError, match="Unsupported format"):
        W.report_files("odt", *given[:3])
    with pytest.raises(ValueError):
        W.report_files("checklist", *given[:3], given[3])
    at, rows = tmp_path / "out", lambda *r: spark.createDataFrame(list(r), "session string, content binary")
    files = lambda: sorted((str(p.relative_to(at)), p.read_bytes()) for p in at.rglob("*") if p.is_file())
    for bad in (rows(("a", b"1"), (None, b"2")), rows(("a", b"1"), ("..", b"2")), rows(("a", b"1"), ("a", b"2"))):
        with pytest.raises(Exception):
            W.write_session_files(bad, str(at), "f")
        assert files() == []
    W.write_session_files(rows(("a", b"1"), ("b", None)), str(at), "f")
    with pytest.raises(Exception):
        W.write_session_files(rows(("a", b"3"), ("c", b"3")), str(at), "f")
    assert files() == [("a/f", b"1"), ("b/f", b"")]
    W.write_session_files(rows(("a", b"3")), str(at), "f", "overwrite")
    assert files() == [("a/f", b"3"), ("b/f", b"")]
    late = spark.range(0, 200, 1, 8).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session"), F.when(F.col("id") == 199, F.raise_error(F.lit("lost")).cast("string")).otherwise("x").cast("binary").alias("content"))
    with pytest.raises(Exception):
        W.write_session_files(late, str(at), "f")
    assert files() == [("a/f", b"3"), ("b/f", b"")] and not list(at.glob("_staging*"))
