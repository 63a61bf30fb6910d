"""One report as the bytes of a file: a DOCX table from cells, PDF pages from Markdown lines. Bytes depend on the text alone."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterable
from textwrap import wrap
from xml.sax.saxutils import escape

from docengine.constants import CELL_COLORS

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
HEADINGS = ("Category", "Requirement", "Accepted Evidence", "Submitted Material", "Approved", "Comments")
#: A4 in points with its margin, and a line's height and a character's width as parts of the font's size (Courier).
PAGE, MARGIN, LEADING, ADVANCE = (595, 842), 50, 1.35, 0.6
SIZES = (("### ", 11, True), ("## ", 14, True), ("# ", 18, True), ("", 10, False))


def _plain(text: str) -> str:
    """Without characters that XML can't hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", text)


def _cell(text: str, color: str | None = None) -> str:
    """A cell of lines; what stands between two pairs of asterisks is bold."""
    runs = []
    for i, line in enumerate(re.split(r"<br>|\n", _plain(text))):
        for k, part in enumerate(line.split("**")):
            look = ("<w:b/>" if k % 2 else "") + (f'<w:color w:val="{CELL_COLORS[color]}"/>' if color else "")
            runs.append(f'<w:r>{f"<w:rPr>{look}</w:rPr>" if look else ""}{"<w:br/>" if i and not k else ""}<w:t xml:space="preserve">{escape(part)}</w:t></w:r>')
    return f"<w:tc><w:p>{''.join(runs)}</w:p></w:tc>"


def _table(rows: Iterable[str]) -> str:
    sides = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return f"<w:tbl><w:tblPr><w:tblBorders>{sides}</w:tblBorders></w:tblPr>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>"


def docx(fields: list[tuple[str, str]], rows: list[dict]) -> bytes:
    """A document of two tables: labelled fields, and a checklist's rows under a title and the headings."""
    head = [_cell(f"**{x}**") for x in HEADINGS]
    body = [
        _cell(r["category"] or "") + _cell(r["title"] or "") + _cell(r["summary"] or "") + _cell((r["material"] or "").replace("_No evidence found_", "No evidence found"), "blue") + _cell(r["sign"] or "", r["sign_color"]) + _cell(r["comments"] or "", r["color"])
        for r in rows
    ]
    title = _cell("**Checklist**").replace("<w:tc>", '<w:tc><w:tcPr><w:gridSpan w:val="6"/></w:tcPr>')
    first = _table(_cell(f"**{k}**") + _cell(v, "blue") for k, v in fields)
    text = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W}"><w:body>{first}<w:p/>{_table([title, "".join(head), *body])}<w:p/></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in {**PARTS, "word/document.xml": text}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pdf_lines(text: str) -> list[tuple[str, int, bool]]:
    """Lines as wide as the page with their size and whether they are bold; marks of Markdown are left out."""
    out = []
    for line in text.split("\n"):
        mark, size, bold = next(s for s in SIZES if line.startswith(s[0]))
        plain = re.sub("[\x00-\x1f\x7f]", " ", line[len(mark) :].replace("**", ""))
        width = int((PAGE[0] - 2 * MARGIN) / (size * ADVANCE))
        out += [(part, size, bold) for part in wrap(plain, width, break_on_hyphens=False) or [""]]
    return out


def pdf(text: str) -> bytes:
    """Markdown of Latin-1 characters as pages of Courier."""
    pages, at, now = [], PAGE[1] - MARGIN, []
    for part, size, bold in pdf_lines(text):
        at -= size * LEADING
        if at < MARGIN:
            pages.append(now)
            at, now = PAGE[1] - MARGIN - size * LEADING, []
        shown = re.sub(r"([\\()])", r"\\\1", part)
        now.append(f"BT /F{2 if bold else 1} {size} Tf {MARGIN} {at:.2f} Td ({shown}) Tj ET")
    pages.append(now)
    n = len(pages)
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(n))
    fonts = [f"<</Type/Font/Subtype/Type1/BaseFont/{f}/Encoding/WinAnsiEncoding>>".encode() for f in ("Courier", "Courier-Bold")]
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Count {n}/Kids[{kids}]/MediaBox[0 0 {PAGE[0]} {PAGE[1]}]>>".encode(), *fonts]
    for i, lines in enumerate(pages):
        stream = zlib.compress("\n".join(lines).encode("latin-1", "replace"))
        objects += [f"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 3 0 R/F2 4 0 R>>>>/Contents {6 + 2 * i} 0 R>>".encode(), f"<</Length {len(stream)}/Filter/FlateDecode>>stream\n".encode() + stream + b"\nendstream"]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{start}\n%%EOF\n".encode())
