"""Workbook (``.xlsx``) scan, every sheet -> ``sheet_rows``.

One workbook per input row of a ``binaryFile`` scan; an Arrow
``mapInPandas`` opens the zip with the standard library and streams each
worksheet's XML.  No workbook package is needed.  The first non-empty row of
a sheet is its header; later rows keep their position relative to it (blank
rows in between stay, as all-null rows).  Values stay text.  A file that
cannot be read yields one row with ``error`` set and no cells.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_source import UNNAMED

SHEET_ROWS_OR_ERROR = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("sheet_pos", T.LongType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("cells", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text_of(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def read_xlsx(data: bytes):
    """Yield ``(sheet_name, sheet_pos, rows)`` with ``rows`` a list of
    ``(row_number, {col_index: text})`` in sheet order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            shared = [_text_of(si) for si in root.findall("m:si", _NS)]
        rels = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for rel in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("pr:Relationship", _NS):
                rels[rel.get("Id")] = rel.get("Target")
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        for pos, sh in enumerate(wb.findall("m:sheets/m:sheet", _NS)):
            target = rels.get(sh.get(f"{{{_NS['r']}}}id"), f"worksheets/sheet{pos + 1}.xml")
            path = target.lstrip("/") if target.startswith("/") else "xl/" + target
            rows = []
            with z.open(path) as fh:
                for _ev, el in ET.iterparse(fh):
                    if el.tag != f"{{{_NS['m']}}}row":
                        continue
                    rnum = int(el.get("r")) if el.get("r") else (rows[-1][0] + 1 if rows else 1)
                    vals = {}
                    for j, c in enumerate(el.findall("m:c", _NS)):
                        ref = c.get("r")
                        ci = _col_index(_REF.match(ref).group(1)) if ref else j
                        t = c.get("t")
                        v = c.find("m:v", _NS)
                        if t == "s" and v is not None:
                            vals[ci] = shared[int(v.text)]
                        elif t == "inlineStr":
                            vals[ci] = _text_of(c)
                        elif t == "b" and v is not None:
                            vals[ci] = "True" if v.text == "1" else "False"
                        elif v is not None and v.text is not None:
                            vals[ci] = v.text
                    rows.append((rnum, vals))
                    el.clear()
            yield sh.get("name"), pos, rows


def _sheet_records(source: str, name: str, pos: int, rows):
    rows = [(r, v) for r, v in rows if any(x is not None and x != "" for x in v.values())] or []
    if not rows:
        return []
    width = max(max(v) for _r, v in rows) + 1
    head_r, head = rows[0]
    columns = [head.get(i) or f"{UNNAMED}{i}" for i in range(width)]
    out = []
    for r, v in rows[1:]:
        out.append((source, name, pos, r - head_r - 1, columns, [v.get(i) for i in range(width)], None))
    # blank rows between data rows keep their place
    return out


def _scan(batches):
    cols = [f.name for f in SHEET_ROWS_OR_ERROR.fields]
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                for name, pos, rows in read_xlsx(bytes(content)):
                    recs = _sheet_records(path, name, pos, rows)
                    if recs:
                        present = {rec[3] for rec in recs}
                        width = len(recs[0][4])
                        last = max(present)
                        for i in range(last + 1):
                            if i not in present:
                                recs.append((path, name, pos, i, recs[0][4], [None] * width, None))
                    out.extend(recs)
            except Exception as e:
                out.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=cols)


def read_workbooks(files: DataFrame) -> DataFrame:
    """``files`` has ``path, content`` (a ``binaryFile`` scan); returns
    ``sheet_rows`` plus ``error``."""
    return files.select("path", "content").mapInPandas(_scan, SHEET_ROWS_OR_ERROR)


def sheet_rows_of(workbook_rows: DataFrame) -> DataFrame:
    return workbook_rows.where(F.col("error").isNull()).drop("error")
