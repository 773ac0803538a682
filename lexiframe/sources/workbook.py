"""One worksheet of many XLSX workbooks, read in parallel.

Spark has no workbook source.  Files are listed with the ``binaryFile``
source (one row per file), and each task parses its own workbooks with the
standard library (a workbook is a zip of XML parts).  One workbook is one file,
parsed once by one task.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# The spreadsheet XML namespaces.
NS_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
NS_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS_PKG_REL = "http://schemas.openxmlformats.org/package/2006/relationships"

_CELL_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_part(zf: zipfile.ZipFile, sheet: str) -> str | None:
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rid = None
    for s in wb.iter(f"{{{NS_MAIN}}}sheet"):
        if s.get("name") == sheet:
            rid = s.get(f"{{{NS_REL}}}id")
    if rid is None:
        return None
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    for r in rels.iter(f"{{{NS_PKG_REL}}}Relationship"):
        if r.get("Id") == rid:
            target = r.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    return None


def parse_sheet(content: bytes, sheet: str):
    """Yield (row, col, value) for every non-empty cell of ``sheet`` (0-based)."""
    zf = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in zf.namelist():
        sst = ET.fromstring(zf.read("xl/sharedStrings.xml"))
        for si in sst.iter(f"{{{NS_MAIN}}}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{NS_MAIN}}}t")))
    part = _sheet_part(zf, sheet)
    if part is None:
        return
    root = ET.fromstring(zf.read(part))
    for c in root.iter(f"{{{NS_MAIN}}}c"):
        m = _CELL_REF.fullmatch(c.get("r", ""))
        if not m:
            continue
        kind = c.get("t")
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(f"{{{NS_MAIN}}}t"))
        else:
            v = c.find(f"{{{NS_MAIN}}}v")
            if v is None or v.text is None:
                continue
            value = shared[int(v.text)] if kind == "s" else v.text
        yield int(m.group(2)) - 1, _col_index(m.group(1)), value


def workbook_bytes(sheet: str, names: list[str], rows) -> bytes:
    """A workbook of one sheet with a header line; cells are inline strings."""
    def cell(col: int, row: int, value: str) -> str:
        letters, n = "", col + 1
        while n:
            n, k = divmod(n - 1, 26)
            letters = chr(65 + k) + letters
        return f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS_MAIN}" xmlns:r="{NS_REL}"><sheets><sheet name="{escape(sheet)}" '
                                      'sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{NS_PKG_REL}"><Relationship Id="rId1" '
                                                 'Target="worksheets/sheet1.xml" Type="sheet"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{NS_MAIN}"><sheetData>'.encode())
            for r, row in enumerate([names, *rows], 1):
                cells = "".join(cell(c, r, v) for c, v in enumerate(row) if v is not None)
                f.write(f'<row r="{r}">{cells}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def read_sheet(spark: SparkSession, path: str, sheet: str, columns: list[str]) -> DataFrame:
    """Rows ``(path, pos, columns...)`` of a sheet whose first row is a header;
    ``columns`` picks and orders the wanted header names (missing cells are
    NULL, a missing column is an error).  Each workbook is parsed once, by one
    task, which holds one workbook at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = list(columns)

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                header: dict[int, str] = {}
                rows: dict[int, dict[str, str]] = {}
                for r, c, v in parse_sheet(bytes(content), sheet):
                    if r == 0:
                        header[c] = v
                    else:
                        rows.setdefault(r, {})[header.get(c, "")] = v
                missing = [n for n in names if n not in header.values()]
                if missing and header:
                    raise ValueError(f"{p}: no column {', '.join(missing)} in sheet {sheet}")
                order = sorted(rows)
                yield pd.DataFrame({"path": [p] * len(order), "pos": range(len(order)),
                                    **{n: [rows[r].get(n) for r in order] for n in names}})

    schema = "path string, pos long" + "".join(f", `{n}` string" for n in names)
    return files.mapInPandas(run, schema)
