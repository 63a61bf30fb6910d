"""Spreadsheets and map files read file by file: CSV and TSV, XLSX (zipped XML), GeoJSON and shapefile headers.

Row order and blank or repeated headers matter here, so a file is one row of the binaryFile source.
"""

from __future__ import annotations

import csv
import io
import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources.workbooks import Sheet, read_workbook

#: Rows below a sheet's header that are read; how many there are is counted.
ROW_CAP = 10_000
ROWS = "path string, sheet_no int, n_sheets int, sheet string, n_rows long, pos int, cells array<string>, error string"


def delimited_sheet(path: str, data: bytes, cap: int) -> Iterator[Sheet]:
    """The one sheet of a CSV or TSV file, named like the file; bytes that are not UTF-8 are replaced."""
    text = io.TextIOWrapper(io.BytesIO(data), "utf-8", "replace", newline="")
    out, n = Sheet(1, 1, path.rsplit("/", 1)[-1]), 0
    for row in csv.reader(text, delimiter="\t" if path.lower().endswith(".tsv") else ","):
        n += 1
        if n <= cap + 1:
            out.rows.append(row)
    out.data_rows = max(n - 1, 0)
    yield out


def workbook_sheets(path: str, data: bytes, cap: int) -> Iterator[Sheet]:
    return read_workbook(io.BytesIO(data), cap)


def _reader(sheets: Callable, cap: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROWS.split(", ")]
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                try:
                    for s in sheets(path, bytes(data), cap):
                        own = (path, s.number, s.of, s.name, s.data_rows)
                        yield pd.DataFrame([(*own, pos, cells, None) for pos, cells in enumerate(s.rows)] or [(*own, None, None, None)], columns=columns)
                except Exception as e:  # one bad file is a row of its own, not the end of the job
                    yield pd.DataFrame([(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])], columns=columns)

    return run


def read_sheets(spark: SparkSession, path: str, cap: int = ROW_CAP) -> DataFrame:
    """Rows of all CSV, TSV and XLSX files under a folder, with each sheet's place and its number of rows; position 0 is a
    sheet's header, cap rows follow at most. A sheet without rows is one row without a position, a file that can't be read
    one with an error; files of no bytes are passed over by Spark's reader."""
    files = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    text, books = files("*.{csv,tsv,CSV,TSV}"), files("*.{xlsx,XLSX,xls,XLS}")
    return text.mapInPandas(_reader(delimited_sheet, cap), ROWS).unionByName(books.mapInPandas(_reader(workbook_sheets, cap), ROWS))


def _points(x) -> Iterator[tuple[float, float]]:
    if isinstance(x, list) and x and isinstance(x[0], (int, float)):
        yield x[0], x[1]
    elif isinstance(x, list):
        for y in x:
            yield from _points(y)


MAPS = "path string, driver string, crs string, bounds array<double>, feature_count long, geometry string, schema map<string,string>, error string"
#: Shapes of the file format; of two-dimensional ones the same with a third value follow 10 and 20 on. Fixed values.
SHAPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def property_type(values: list) -> str:
    """The type that holds all values of a property: int, float, bool or str."""
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int, float} and kinds:
        return "float" if float in kinds else "int"
    return "bool" if kinds == {bool} else "str"


def geojson_metadata(data: bytes) -> tuple:
    """Driver, reference system, bounds, features, geometry of the first, and types of properties of a GeoJSON file."""
    doc = json.loads(data.decode("utf-8", "replace"))
    features = doc.get("features", [doc] if doc.get("type") == "Feature" else [])
    points = [p for f in features if f.get("geometry") for p in _points(f["geometry"].get("coordinates"))]
    bounds = [float(x) for x in (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))] if points else None
    crs = ((doc.get("crs") or {}).get("properties") or {}).get("name", "EPSG:4326")
    values: dict[str, list] = {}
    for f in features:
        for k, v in (f.get("properties") or {}).items():
            values.setdefault(k, []).append(v)
    return ("GeoJSON", crs, bounds, len(features), (features[0].get("geometry") or {}).get("type") if features else None, {k: property_type(v) for k, v in values.items()})


def shape_header(data: bytes) -> tuple[list[float], int, str | None]:
    """Bounds, features and geometry of the first of a .shp file: a line or polygon of several parts is a Multi one, if the
    parts of a polygon turn the same way."""
    if struct.unpack_from(">i", data, 0)[0] != 9994:
        raise ValueError("no shapefile")
    at, n, geometry = 100, 0, None
    while at + 8 <= len(data):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        if n == 0 and size >= 4:
            kind = struct.unpack_from("<i", data, at + 8)[0] % 10
            geometry = SHAPES.get(kind)
            if kind in (3, 5):
                parts, points = struct.unpack_from("<2i", data, at + 44)
                starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
                xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
                turns = [sum(xy[2 * i] * xy[2 * i + 3] - xy[2 * i + 2] * xy[2 * i + 1] for i in range(a, b - 1)) for a, b in zip(starts, starts[1:])]
                several = parts > 1 if kind == 3 else sum(t <= 0 for t in turns) > 1
                geometry = f"Multi{geometry}" if several else geometry
        at += 8 + size
        n += 1
    return list(struct.unpack_from("<4d", data, 36)), n, geometry


def table_schema(data: bytes) -> dict[str, str]:
    """Names and types of the fields that a .dbf file's header lists."""
    out, at = {}, 32
    end = struct.unpack_from("<H", data, 8)[0]
    while at + 32 <= end and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("utf-8", "replace")
        kind, width, places = chr(data[at + 11]), data[at + 16], data[at + 17]
        numeric = f"float:{width}.{places}" if places or kind == "F" else f"int:{width}"
        out[name] = {"C": f"str:{width}", "N": numeric, "F": numeric, "D": "date", "L": "bool"}.get(kind, "str")
        at += 32
    if not out and end > 33:
        raise ValueError("no fields in a table's header")
    return out


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of GeoJSON files and shapefiles. Of a shapefile the geometry comes from .shp, the reference system from .prj and
    the schema from .dbf beside it, where there are such; one of them that can't be read makes the file an error row."""

    def each(fn: Callable, schema: str) -> Callable:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for p, data in zip(b["path"], b["content"]):
                    try:
                        rows.append((p, *fn(bytes(data)), None))
                    except Exception as e:  # one bad file is a row of its own, not the end of the job
                        rows.append((p, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:300]))
                yield pd.DataFrame(rows, columns=names)

        return run

    files = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    geojson = files("*.{geojson,GEOJSON}").mapInPandas(each(geojson_metadata, MAPS), MAPS)
    part = lambda glob, fn, columns: files(glob).mapInPandas(each(fn, f"path string, {columns}, error string"), f"path string, {columns}, error string").withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", ""))
    shapes = part("*.{shp,SHP}", shape_header, "bounds array<double>, feature_count long, geometry string").alias("s")
    tables = part("*.{dbf,DBF}", lambda data: (table_schema(data),), "schema map<string,string>").alias("t")
    systems = part("*.{prj,PRJ}", lambda data: (data.decode("utf-8").strip() or None,), "crs string").alias("p")
    both = shapes.join(tables, "stem", "left").join(systems, "stem", "left")
    error = F.coalesce("s.error", F.concat(F.lit("table: "), F.col("t.error")), F.concat(F.lit("reference system: "), F.col("p.error")))
    sound = lambda c: F.when(error.isNull(), F.col(c))
    schema = F.when(error.isNull(), F.coalesce("t.schema", F.create_map().cast("map<string,string>")))
    return geojson.unionByName(both.select("s.path", F.when(error.isNull(), "ESRI Shapefile").alias("driver"), sound("p.crs").alias("crs"), sound("s.bounds").alias("bounds"), sound("s.feature_count").alias("feature_count"), sound("s.geometry").alias("geometry"), schema.alias("schema"), error.alias("error")))
