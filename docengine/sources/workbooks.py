"""XLSX workbooks read as a stream of XML events: memory holds the rows that are kept and the strings they name, whatever the
size of a sheet. Dates come from the number formats of the style table."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import IO
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats that are dates, times or durations in every workbook. Fixed values of the file format.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
DURATION_FORMATS = {46}


@dataclass
class Sheet:
    """A sheet's place, header and first rows, and how many rows it has below its first."""

    number: int
    of: int
    name: str
    rows: list[list[str]] = field(default_factory=list)
    data_rows: int = 0


def events(stream: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, each dropped with all before it once it has been used."""
    open_ = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            open_.append(e)
            continue
        open_.pop()
        if e.tag == MAIN + tag:
            yield e
            e.clear()
            if open_:
                open_[-1].remove(e)


def column_of(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def text_of(e: ElementTree.Element) -> str:
    """The text of a string item, but for phonetic runs."""
    hidden = {id(t) for p in e.iter(MAIN + "rPh") for t in p.iter(MAIN + "t")}
    return "".join(t.text or "" for t in e.iter(MAIN + "t") if id(t) not in hidden)


def is_date_format(code: str) -> bool:
    """Whether a format shows parts of a date or time, beside quoted texts, escaped characters and what is in brackets."""
    return bool(re.search("[dmhysDMHYS]", re.sub(r'"[^"]*"|\\.|_.|\[[^\]]*\]', "", code.split(";")[0])))


def style_kinds(z: zipfile.ZipFile) -> list[str]:
    """For every cell style: date, duration or number."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(MAIN + "numFmt")}
    out = []
    for xf in root.iterfind(f"{MAIN}cellXfs/{MAIN}xf"):
        n = int(xf.get("numFmtId") or 0)
        code = codes.get(n, "")
        lasting = n in DURATION_FORMATS or bool(re.search(r"\[(h+|m+|s+)\]", code, re.I))
        out.append("duration" if lasting else "date" if (is_date_format(code) if n in codes else n in DATE_FORMATS) else "number")
    return out


def dated(serial: float, epoch: dt.datetime) -> str:
    """A serial number as a date and time, to the millisecond; below 1 a time of day. Days before March 1900 count from a day
    later, as the format takes 1900 for a leap year."""
    days, part = divmod(serial, 1)
    part = dt.timedelta(milliseconds=round(part * 86_400_000))
    first = epoch.year < 1904
    if 0 <= serial < 1 and first:
        return str((dt.datetime(1900, 1, 1) + part).time())
    if 0 < serial < 60 and first:
        days += 1
    return str(epoch + dt.timedelta(days=days) + part)


def number_text(value: str) -> str:
    """Whole numbers as they are, others by their shortest decimals."""
    return value if re.fullmatch(r"-?\d+", value) else repr(float(value))


def cell_value(c: ElementTree.Element, kinds: list[str], epoch: dt.datetime) -> str | int:
    """A cell's text; an integer stands for a shared string."""
    kind, value = c.get("t", "n"), c.findtext(MAIN + "v")
    if kind == "inlineStr":
        inline = c.find(MAIN + "is")
        return "" if inline is None else text_of(inline)
    if value is None or value == "" and kind != "str":
        return ""
    if kind == "s":
        return int(value)
    if kind == "b":
        return str(bool(int(value)))
    if kind != "n":
        return value.replace("T", " ") if kind == "d" else value
    style = int(c.get("s") or 0)
    shown = kinds[style] if style < len(kinds) else "number"
    if shown == "number":
        return number_text(value)
    try:
        return str(dt.timedelta(milliseconds=round(float(value) * 86_400_000))) if shown == "duration" else dated(float(value), epoch)
    except OverflowError:
        return number_text(value)


def sheet_rows(stream: IO[bytes], cap: int, kinds: list[str], epoch: dt.datetime) -> tuple[list[list[str | int]], int]:
    """The first row and up to cap more, with empty rows where row numbers skip some, and the number of all rows."""
    rows: list[list[str | int]] = []
    last = 0
    for row in events(stream, "row"):
        at = int(row.get("r") or last + 1)
        if len(rows) <= cap:
            rows += [[]] * (min(at - last - 1, cap + 1 - len(rows)))
            if len(rows) <= cap:
                cells: list[str | int] = []
                for c in row.iterfind(MAIN + "c"):
                    place = column_of(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (place - len(cells))
                    cells.append(cell_value(c, kinds, epoch))
                rows.append(cells)
        last = max(at, last)
    return rows, last


def read_workbook(data: IO[bytes], cap: int) -> Iterator[Sheet]:
    """Sheets in the workbook's order. Shared strings are read after a sheet, and only those its kept rows name stay."""
    with zipfile.ZipFile(data) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        settings = book.find(MAIN + "workbookPr")
        epoch = dt.datetime(1904, 1, 1) if settings is not None and settings.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        kinds, sheets = style_kinds(z), book.findall(f"{MAIN}sheets/{MAIN}sheet")
        for number, s in enumerate(sheets, 1):
            target = targets[s.get(RELATION)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
                rows, n = sheet_rows(stream, cap, kinds, epoch)
            wanted = {v for row in rows for v in row if isinstance(v, int)}
            known: dict[int, str] = {}
            if wanted:
                with z.open("xl/sharedStrings.xml") as stream:
                    for i, item in enumerate(events(stream, "si")):
                        if i in wanted:
                            known[i] = text_of(item)
            yield Sheet(number, len(sheets), s.get("name"), [[known[v] if isinstance(v, int) else v for v in row] for row in rows], max(n - 1, 0))


def count_sheets(data: IO[bytes]) -> int:
    """The number of sheets, from the workbook part alone."""
    with zipfile.ZipFile(data) as z, z.open("xl/workbook.xml") as stream:
        return sum(1 for _ in events(stream, "sheet"))
