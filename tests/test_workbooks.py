"""Workbooks read as streams and shown as capped Markdown, and documents of many sessions discovered in one job."""

import datetime as dt
import hashlib
import io
import json
import tracemalloc
import zipfile
from xml.sax.saxutils import escape

import pytest

from docengine.operators import spreadsheet
from docengine.sources import files, sheets, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def cell(value, at=""):
    ref = f' r="{at}"' if at else ""
    if isinstance(value, tuple):
        return f'<c{ref} s="{value[0]}"><v>{value[1]}</v></c>'
    if isinstance(value, str):
        return f'<c{ref} t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f"<c{ref}/>" if value is None else f"<c{ref}><v>{value}</v></c>"


def book(target, tables, styles="", settings="", strings=None):
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{escape(n)}" r:id="r{i}"/>' for i, n in enumerate(tables))
        z.writestr("xl/workbook.xml", f"<workbook {NS} {REL}>{settings}<sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(tables))) + "</Relationships>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(strings) + "</sst>")
        for i, rows in enumerate(tables.values()):
            with z.open(f"xl/worksheets/s{i}.xml", "w") as f:
                f.write(f"<worksheet {NS}><sheetData>".encode())
                for r in rows:
                    f.write((r if isinstance(r, str) else "<row>" + "".join(map(cell, r)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")


def read(tables, **more):
    target = io.BytesIO()
    book(target, tables, **more)
    return list(workbooks.read_workbook(io.BytesIO(target.getvalue()), 10_000))


def test_values_dates_and_gaps():
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="&quot;days&quot; 0.00"/><numFmt numFmtId="166" formatCode="[h]:mm"/><numFmt numFmtId="167" formatCode="[Red]0"/></numFmts><cellXfs>'
    styles += "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 164, 165, 166, 167, 22)) + "</cellXfs>"
    strings = ["<si><t>un</t></si>", "<si><r><t>sh</t></r><r><t>own</t></r><rPh><t>x</t></rPh></si>"]
    row = ['<row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#N/A</v></c><c r="AA2"><v>1e3</v></c></row>']
    dates = [[(1, 44576), (2, 44576.5), (3, 44576), (4, 1.5), (5, 7), (6, 1), (1, 0.25), (6, 61)]]
    one, two, three = read({"a": ['<row r="4"><c t="n"><v>0.1</v></c><c t="str"><v>f</v></c><c><v></v></c></row>', *[x.replace('r="2"', 'r="6"') for x in row]], "b & c": dates, "none": []}, styles=styles, strings=strings)
    assert one.rows == [[], [], [], ["0.1", "f", ""], [], ["", "shown", "", "True", "#N/A", *[""] * 21, "1000.0"]] and one.data_rows == 5
    assert two.name == "b & c" and two.rows == [["2022-01-15 00:00:00", "2022-01-15 12:00:00", "44576", "1 day, 12:00:00", "7", "1900-01-01 00:00:00", "06:00:00", "1900-03-01 00:00:00"]]
    assert (three.rows, three.data_rows, three.number, three.of) == ([], 0, 3, 3)
    (mac,) = read({"m": [[(1, 0), (1, 366.5)]]}, styles=styles, settings='<workbookPr date1904="1"/>')
    assert mac.rows == [["1904-01-01 00:00:00", "1905-01-01 12:00:00"]]
    assert str(dt.datetime(2022, 1, 15)) == "2022-01-15 00:00:00"


def test_large_sheet_in_little_memory():
    strings = [f"<si><t>text number {i} with some words</t></si>" for i in range(100_000)]
    big = io.BytesIO()
    book(big, {"big": (f'<row r="{i + 1}">' + "".join(f'<c t="s"><v>{(i * 9 + k) % 100_000}</v></c><c><v>{i}.5</v></c>' for k in range(8)) + "</row>" for i in range(60_000))}, strings=strings)
    data = io.BytesIO(big.getvalue())
    del big
    assert sum(x.file_size for x in zipfile.ZipFile(data).infolist()) > 25_000_000
    tracemalloc.start()
    (sheet,) = workbooks.read_workbook(data, 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sheet.rows) == 501 and sheet.data_rows == 59_999 and sheet.rows[3][:2] == ["text number 27 with some words", "3.5"]
    assert peak < 20_000_000


def plain(path, tables, row_cap=10_000, sheet_cap=40_000, book_cap=60_000):
    """A file's Markdown by one pass over its rows."""
    clean = lambda v: " ".join(x.strip() for x in v.strip().replace("|", "\\|").split("\n")) if v else ""
    sections, total = [], 0
    kind = "file" if path.endswith((".csv", ".tsv")) else "sheet"
    for i, (name, rows) in enumerate(tables.items(), 1):
        head = f'--- Sheet "{name}" ({i} of {len(tables)}) ---\n\n'
        if not rows:
            sections.append(f"{head}*Empty {kind}*")
            continue
        names = [clean(h) or f"col_{k}" for k, h in enumerate(rows[0])]
        lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
        data = rows[1 : row_cap + 1]
        total += len(data)
        size, kept = sum(map(len, lines)) + 1, 0
        for r in data:
            line = "| " + " | ".join([clean(c) for c in [*r, *[""] * len(names)][: len(names)]]) + " |"
            size += len(line) + 1
            if size > sheet_cap:
                break
            lines.append(line)
            kept += 1
        text = head + "\n".join(lines)
        if len(rows) - 1 > row_cap:
            text += f"\n\n*Truncated by row cap: showing first {row_cap:,} of {len(rows) - 1:,} data rows*"
        if kept < len(data):
            text += f"\n\n*Truncated by char cap ({sheet_cap:,}): kept {kept:,} of {len(data):,} rows on this {kind}*"
        sections.append(text)
    text = "\n\n".join(sections)
    if len(text) > book_cap:
        at = text.rfind("\n\n", 0, book_cap)
        at = at if at > 0 else book_cap
        text = text[:at] + f"\n\n*Truncated by workbook cap ({book_cap:,} chars): kept first {at:,} of {len(text):,} total chars across {len(tables)} sheet(s). Full data remains on disk at {path.rsplit('/', 1)[-1]}.*"
    return len(tables), total, text


def test_capped_texts(spark, tmp_path):
    plots = lambda n: [["plot_id", "hectares", "crop"], *[[f"plot-{i:07d}", f"{1 + i % 50}.5", "wheat" if i % 2 else "barley"] for i in range(n)]]
    fat = [[f"col_{k}" for k in range(20)], *[[f"r{i}_{'x' * 200}"] * 20 for i in range(250)]]
    cases = {
        "big.xlsx": {"Plots": plots(10_500)}, "small.xlsx": {"Plots": plots(500)}, "fat.xlsx": {"FatRows": fat}, "multi.xlsx": {f"sheet_{s}": [[f"col_{k}" for k in range(6)], *[[f"s{s}r{i}_{'y' * 40}"] * 6 for i in range(90)]] for s in range(5)},
        "odd.xlsx": {"none": [], "head": [["a|b", "", "c\n d"]], "short": [["x", "y"], ["1"], ["1", "2", "3"], ["a\nb", "p|q"]]}, "wide.xlsx": {"w": [["h" * 50_000, "x"], ["1", "2"]]},
    }
    for name, tables in cases.items():
        book(tmp_path / name, tables)
    (tmp_path / "flat.csv").write_text("a,b\n" + "".join(f"{i},{'z' * 60}\n" for i in range(900)))
    (tmp_path / "flat.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "head.csv").write_text("only,head\n")
    (tmp_path / "bad.xls").write_bytes(b"old format")
    flat = {"flat.csv": [["a", "b"], *[[str(i), "z" * 60] for i in range(900)]], "flat.tsv": [["a", "b"], ["1", "2"]], "head.csv": [["only", "head"]]}
    got = {r["path"].rsplit("/", 1)[-1]: r for r in spreadsheet.workbook_texts(sheets.read_sheets(spark, str(tmp_path))).collect()}
    assert got.keys() == {*cases, *flat, "bad.xls"}
    for name, tables in [*cases.items(), *((n, {n: rows}) for n, rows in flat.items())]:
        r = got[name]
        assert (r["sheet_count"], r["row_count"], r["markdown"]) == plain(name, tables), name
    assert "Truncated by row cap: showing first 10,000 of 10,500" in got["big.xlsx"]["markdown"] and "Truncated" not in got["small.xlsx"]["markdown"]
    assert "workbook cap" in got["multi.xlsx"]["markdown"] and got["bad.xls"]["error"].startswith("BadZipFile") and got["bad.xls"]["markdown"] is None
    assert (got["head.csv"]["tables_found"], got["odd.xlsx"]["tables_found"]) == (0, 2)


@pytest.fixture
def cases(tmp_path):
    for d in ("up/.hidden", "shared/sub", "old", "state/s1", "state/s2", "state/s3", "state/bad"):
        (tmp_path / d).mkdir(parents=True)
    put = lambda at, data: (tmp_path / at).write_bytes(data)
    put("up/Project Plan.pdf", b"plan")
    put("up/.hidden/x.pdf", b"hidden")
    put("up/notes.txt", b"no document")
    book(tmp_path / "shared" / "data.xlsx", {"a": [], "b": [], "c": []})
    put("shared/sub/copy of plan.pdf", b"plan")
    put("shared/broken.xlsx", b"zip no")
    put("old/lots.csv", b"a,b\n")
    source = lambda kind, key, at: {"source_type": kind, "metadata": {key: str(tmp_path / at)}}
    states = {
        "s1": {"created_at": "2024-01-01", "document_sources": [source("upload", "directory", "up"), source("path", "path", "shared"), source("path", "path", "shared/sub"), source("path", "path", "nowhere"), {"source_type": "link", "metadata": {"url": "x"}}], "project_metadata": {"documents_path": str(tmp_path / "old"), "project_name": "One", "methodology": "m"}},
        "s2": {"created_at": "2024-02-01", "project_metadata": {"documents_path": str(tmp_path / "shared")}, "statistics": {"n": 1}}, "s3": {"project_metadata": {}},
    }
    for k, v in states.items():
        put(f"state/{k}/session.json", json.dumps({"session_id": k, **v}).encode())
    put("state/bad/session.json", b"{broken")
    return tmp_path


def test_sessions_are_discovered_together(spark, cases):
    sessions = files.read_sessions(spark, str(cases / "state"))
    roots = files.session_roots(sessions)
    assert sorted((r["session"], r["kind"], r["pos"]) for r in roots.collect()) == [("s1", "legacy_path", 5), ("s1", "path", 1), ("s1", "path", 2), ("s1", "path", 3), ("s1", "upload", 0), ("s2", "legacy_path", 0)]
    rows = {(r["session"], r["filename"]): r for r in files.discover_sessions(roots).collect()}
    assert rows.keys() == {("s1", n) for n in ("Project Plan.pdf", "data.xlsx", "copy of plan.pdf", "broken.xlsx", "lots.csv")} | {("s2", n) for n in ("data.xlsx", "copy of plan.pdf", "broken.xlsx")}
    plan, copy = rows["s1", "Project Plan.pdf"], rows["s1", "copy of plan.pdf"]
    assert plan["content_hash"] == copy["content_hash"] == hashlib.sha256(b"plan").hexdigest() and plan["is_first"] and not copy["is_first"] and rows["s2", "copy of plan.pdf"]["is_first"]
    assert (copy["kind"], copy["pos"], copy["relative"], copy["size"]) == ("path", 1, "sub/copy of plan.pdf", 4) and plan["document_id"] == "DOC-" + plan["content_hash"][:8]
    assert [(rows["s1", n]["page_count"], rows["s1", n]["has_tables"]) for n in ("data.xlsx", "broken.xlsx", "lots.csv", "Project Plan.pdf")] == [(3, True), (None, False), (1, True), (None, False)]
    assert all(r["error"] is None and r["modified"] and r["created"] for r in rows.values()) and plan["classification"] == "project_plan"
    assert files.discover_sessions(roots.limit(0)).count() == 0


def test_session_list_has_all_fields(spark, cases):
    rows = files.list_sessions(spark, str(cases / "state")).collect()
    assert [r["session_id"] for r in rows] == ["s2", "s1", "s3"]
    assert rows[0].asDict().keys() == {"session_id", "project_name", "created_at", "updated_at", "status", "methodology", "workflow_progress", "statistics", "project_metadata"}
    assert rows[0]["statistics"] == {"n": "1"} and rows[1]["statistics"] == {} and rows[1]["project_name"] == "One" and rows[1]["methodology"] == "m"


def test_empty_flat_file():
    (sheet,) = sheets.delimited_sheet("/x/empty.csv", b"", 10)
    assert (sheet.name, sheet.rows, sheet.data_rows) == ("empty.csv", [], 0)


def test_lost_file_is_an_error_row(tmp_path):
    assert files.file_metadata(str(tmp_path / "gone.pdf"), "gone.pdf")[-1].startswith("FileNotFoundError")
