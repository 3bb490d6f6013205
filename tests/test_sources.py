import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.embed import embed_chunks
from tessera.sources.csv_source import read_csv_sheets
from tessera.sources.files import archive_raw, list_files, read_files
from tessera.sources.ingest import ingest_folder, route
from tessera.sources.store import append_vectors, load_vectors, write_vectors
from tessera.sources.workbook import read_workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RNS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _col(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, sheets):
    """Minimal workbook writer for tests: ``{name: [[cell, ...], ...]}``;
    strings go to the shared table, numbers are stored as numbers."""
    shared, idx = [], {}
    sheet_xml = []
    for rows in sheets.values():
        out = []
        for r, row in enumerate(rows, start=1):
            cells = []
            for c, v in enumerate(row):
                if v is None:
                    continue
                ref = f"{_col(c)}{r}"
                if isinstance(v, (int, float)):
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                else:
                    if v not in idx:
                        idx[v] = len(shared)
                        shared.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{idx[v]}</v></c>')
            out.append(f'<row r="{r}">{"".join(cells)}</row>')
        sheet_xml.append(f'<worksheet {NS}><sheetData>{"".join(out)}</sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} {RNS}><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
                       f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
                   + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst {NS}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, x in enumerate(sheet_xml):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", x)


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.csv").write_text('id,name,,\n1,"x, y",,\n2,"say ""hi""",,z\n,,,\n')
    (d / "B.CSV").write_text("k;v\nTestNumber = 1;\nrow\nTestNumber = 2;\n")
    write_xlsx(d / "book.xlsx", {"First": [["h1", "h2"], ["TestNumber = 7;", 3], [None, None], ["tail", 4.5]],
                                 "Empty": []})
    (d / "broken.xlsx").write_bytes(b"not a zip")
    (d / "old.xls").write_bytes(b"\x00\x01")
    (d / "notes.pdf").write_bytes(b"%PDF")
    return str(d)


def test_csv_reader_per_file_headers(spark, folder):
    rows = read_csv_sheets(spark, [os.path.join(folder, "a.csv"), os.path.join(folder, "B.CSV")])
    got = {(os.path.basename(r.source), r.row_idx): (r.columns, r.cells) for r in rows.collect()}
    assert got[("a.csv", 0)] == (["id", "name", "Unnamed: 2", "Unnamed: 3"], ["1", "x, y", None, None])
    assert got[("a.csv", 1)][1] == ["2", 'say "hi"', None, "z"]
    assert got[("a.csv", 2)][1] == [None, None, None, None]
    assert got[("B.CSV", 0)] == (["k;v"], ["TestNumber = 1;"])
    assert max(i for s, i in got if s == "B.CSV") == 2


def test_workbook_reader(spark, folder):
    wb = read_workbooks(read_files(spark, folder, "*.xlsx")).collect()
    ok = sorted((r.sheet, r.row_idx, tuple(r.cells)) for r in wb if r.error is None)
    assert ok == [("First", 0, ("TestNumber = 7;", "3")), ("First", 1, (None, None)), ("First", 2, ("tail", "4.5"))]
    bad = [r for r in wb if r.error is not None]
    assert len(bad) == 1 and bad[0].source.endswith("broken.xlsx")


def test_route_names(spark):
    names = ["a.CSV", "a.b.csv", "a.pdf", "a.xls", "noext", "x.XLSX"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [(r.kind, r.status) for r in route(df).collect()]
    assert got == [("csv", "ok"), ("csv", "ok"), ("unsupported", "rejected"), ("xls", "rejected"),
                   ("unsupported", "rejected"), ("xlsx", "ok")]


def test_ingest_folder_survives_bad_files(spark, folder):
    chunks, log = ingest_folder(spark, folder, "Test Number")
    lg = {r.source: r for r in log.collect()}
    assert lg["a.csv"].status == "ok" and lg["a.csv"].n_chunks == 1
    assert lg["B.CSV"].n_chunks == 2
    assert lg["book.xlsx"].status == "ok" and lg["book.xlsx"].n_sheets == 1 and lg["book.xlsx"].n_chunks == 1
    assert lg["broken.xlsx"].status == "error"
    assert lg["old.xls"].status == "rejected" and lg["notes.pdf"].status == "rejected"
    labels = {r.section_label for r in chunks.collect()}
    assert {"TestNumber = 1;", "TestNumber = 2;", "TestNumber = 7;", "No Test Number Found"} <= labels


def test_listing_reads_no_bodies(spark, folder):
    plan = list_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_store_is_idempotent(spark, folder, tmp_path):
    chunks, _log = ingest_folder(spark, folder, "Token Count", max_tokens=50, overlap_tokens=10)
    vec = embed_chunks(chunks)
    path = str(tmp_path / "vectors")
    write_vectors(vec, path)
    n = load_vectors(spark, path).count()
    assert append_vectors(vec, path).count() == 0
    assert load_vectors(spark, path).count() == n
    raw = archive_raw(read_files(spark, folder, "*.csv"), str(tmp_path / "raw"))
    assert sorted(r.key for r in raw.collect()) == ["raw_docs/a.csv"]
    ids = [r.chunk_id for r in load_vectors(spark, path).collect()]
    assert len(ids) == len(set(ids))
    assert load_vectors(spark, path).where(F.size("embedding") != 256).count() == 0
