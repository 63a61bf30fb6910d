"""Files as tables, reports written and streams, on small files made here."""

import json
import struct
import zipfile

from pyspark.sql import functions as F

from docengine.sources import files, sheets, sinks
from docengine.streaming import discovery as stream


def test_discover_and_text(spark, tmp_path):
    root = tmp_path / "proj"
    (root / ".hidden").mkdir(parents=True)
    (root / "Project Plan.pdf").write_bytes(b"same")
    (root / "copy of plan.pdf").write_bytes(b"same")
    (root / "note.txt").write_bytes(b"x")
    (root / ".hidden" / "a.pdf").write_bytes(b"y")
    got = {r["filename"]: r for r in files.discover(spark, str(root), "s").collect()}
    assert set(got) == {"Project Plan.pdf", "copy of plan.pdf"}
    assert got["Project Plan.pdf"]["is_first"] and not got["copy of plan.pdf"]["is_first"]
    (root / "a.fast.md").write_text("--- Page 1 ---\n\none\n\n--- Page 2 ---\n\ntwo")
    (root / "Project Plan+.hq.md").write_text("text")
    t = files.text_sidecars(spark, str(root))
    assert {(r["stem"], r["quality"]) for r in t.collect()} == {("a", "fast"), ("Project Plan+", "hq")}
    assert [(r["page"], r["text"]) for r in files.pages(t).orderBy("page").collect()] == [(1, "one"), (2, "two")]


def test_checklist_and_sessions(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"methodology_id": "m", "requirements": [{"requirement_id": "REQ-001", "scope": "farm", "mandatory": True}, {"requirement_id": "REQ-002", "scope": "meta"}]}))
    assert files.read_checklist(spark, str(p)).count() == 2
    assert [r["requirement_id"] for r in files.read_checklist(spark, str(p), "farm").collect()] == ["REQ-001"]
    for i in (1, 2):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}" / "session.json").write_text(json.dumps({"session_id": f"s{i}", "created_at": f"2024-01-0{i}"}))
    assert [r["session_id"] for r in files.list_sessions(spark, str(tmp_path)).collect()] == ["s2", "s1"]


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'h,h,\n1,"x,y",\xff\n')
    (tmp_path / "b.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "bad.xls").write_bytes(b"not a zip")
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Farm" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Owner</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    rows = sheets.read_sheets(spark, str(tmp_path)).collect()
    by = lambda name: sorted((r["pos"], r["cells"]) for r in rows if r["path"].endswith(name) and r["error"] is None)
    assert by("a.csv") == [(0, ["h", "h", ""]), (1, ["1", "x,y", "�"])]
    assert by("b.tsv") == [(0, ["a", "b"]), (1, ["1", "2"])]
    assert by("w.xlsx") == [(0, ["Owner", "", "5"])]
    assert any(r["path"].endswith("bad.xls") and r["error"] for r in rows)


def shapefile(parts, kind=5, records=1):
    points = [p for part in parts for p in part]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    body = struct.pack("<i4d2i", kind, 0, 1, 4, 5, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    rows = b"".join(struct.pack(">2i", i + 1, len(body) // 2) + body for i in range(records))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(rows)) // 2) + struct.pack("<2i8d", 1000, kind, 0, 1, 4, 5, 0, 0, 0, 0) + rows


def dbf(*columns):
    rows = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in columns)
    return struct.pack("<4BIHH20x", 3, 124, 1, 1, 0, 33 + len(rows), 20) + rows + b"\r"


def test_maps(spark, tmp_path):
    feature = lambda **p: {"type": "Feature", "properties": p, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 5], [1, 1]]]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(n=1, s="x", b=True), feature(n=1.5, s=None, m=2)]}))
    (tmp_path / "none.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (tmp_path / "bad.geojson").write_text("{")
    ring = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    for name, parts, kind, n in (("plain", [ring], 5, 3), ("holed", [ring, hole], 5, 1), ("two", [ring, [(x + 9, y) for x, y in ring]], 5, 1), ("line", [ring, hole], 3, 1), ("flawed", [ring], 5, 1), ("empty", [ring], 5, 0)):
        (tmp_path / f"{name}.shp").write_bytes(shapefile(parts, kind, n))
    (tmp_path / "plain.dbf").write_bytes(dbf(("NAME", "C", 40, 0), ("AREA", "N", 19, 5), ("ID", "N", 9, 0), ("DAY", "D", 8, 0), ("OK", "L", 1, 0)))
    (tmp_path / "plain.prj").write_text('GEOGCS["WGS 84"]\n')
    (tmp_path / "flawed.dbf").write_bytes(b"\3")
    (tmp_path / "short.shp").write_bytes(b"xx")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in sheets.read_maps(spark, str(tmp_path)).collect()}
    a, p = got["a.geojson"], got["plain.shp"]
    assert (a["bounds"], a["feature_count"], a["geometry"], a["crs"], a["schema"]) == ([0, 1, 2, 5], 2, "Polygon", "EPSG:4326", {"n": "float", "s": "str", "b": "bool", "m": "int"})
    assert (p["driver"], p["crs"], p["bounds"], p["feature_count"], p["geometry"], p["error"]) == ("ESRI Shapefile", 'GEOGCS["WGS 84"]', [0, 1, 4, 5], 3, "Polygon", None)
    assert p["schema"] == {"NAME": "str:40", "AREA": "float:19.5", "ID": "int:9", "DAY": "date", "OK": "bool"}
    assert [got[f"{n}.shp"]["geometry"] for n in ("holed", "two", "line", "empty")] == ["Polygon", "MultiPolygon", "MultiLineString", None] and got["holed.shp"]["schema"] == {} and got["holed.shp"]["crs"] is None
    assert got["flawed.shp"]["error"].startswith("table: ") and got["flawed.shp"]["bounds"] is None and got["short.shp"]["error"] and got["bad.geojson"]["error"]
    assert (got["none.geojson"]["bounds"], got["none.geojson"]["feature_count"]) == (None, 0) and len(got) == 10


def test_reports(spark, tmp_path):
    counts = spark.createDataFrame([("s", 1, 2, 50)], "session string, covered long, total long, percent long")
    rows = spark.createDataFrame([("s", "REQ-002", "partial", "<b>"), ("s", "REQ-001", "covered", None)], "session string, requirement_id string, status string, snippet string")
    page = sinks.html_preview(counts, rows)
    text = page.first()["text"]
    assert text.index("REQ-001") < text.index("REQ-002") and "&lt;b&gt;" in text
    sinks.write_reports(page, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).count() == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a/plan.pdf", b"1", 1000), ("b/plan.pdf", b"1", 1060), ("c/x.txt", b"2", 1000), ("c/map.shp", b"3", 1000)]
    df = spark.createDataFrame(rows, "path string, content binary, s long").select("path", "content", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(str(src))
    q = stream.new_documents(spark.readStream.schema(df.schema).parquet(str(src))).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["classification"] for r in spark.table("found").collect()) == ["gis_shapefile", "unknown"]
