"""Workbooks as monthly files: cells of all kinds, beside text files, in loads and alone."""

from __future__ import annotations

import io
import zipfile

import pytest

from turnflow.sources.ledger import load_files
from turnflow.sources.ontime import header_groups, read_ontime
from turnflow.sources.sheets import sheet_rows

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = '<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="[Red]0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'


def workbook(rows: str, shared: tuple[str, ...] = (), since_1904: bool = False) -> bytes:
    """A workbook whose first sheet isn't its first part."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><workbookPr date1904="{int(since_1904)}"/><sheets><sheet name="a" sheetId="7" r:id="rId2"/><sheet name="b" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row><c t="str"><v>wrong</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{STYLES}</styleSheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
    return out.getvalue()


def lines(*rows: tuple) -> str:
    cell = lambda x: "<c/>" if x is None else f"<c><v>{x}</v></c>" if isinstance(x, int | float) else f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    return "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)


def test_cells_of_all_kinds():
    rows = (
        '<row r="1"/><row r="2"><c r="B2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="AA2" t="str"><f>A1</f><v>x</v></c></row>'
        '<row r="3"><c r="A3"><v>830</v></c><c r="B3"><v>830.0</v></c><c r="C3"><v>1.5E3</v></c><c r="D3"><v>-2.5</v></c><c r="E3"><v>1E-7</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>45292</v></c><c r="B4" s="2"><v>45292.5</v></c><c r="C4" s="3"><v>45292</v></c><c r="D4" s="1"><v>59</v></c><c r="E4" s="1"><v>61</v></c></row>'
        '<row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5" t="inlineStr"><is><r><t>a</t></r><r><t xml:space="preserve"> b</t></r></is></c><c r="D5" t="d"><v>2024-01-02</v></c></row>'
    )
    got = list(sheet_rows(workbook(rows, ("<t>Year</t>", "<r><t>Mon</t></r><r><t>th</t></r><rPh><t>no</t></rPh>"))))
    assert got == [
        {1: "Year", 2: "Month", 26: "x"},
        {0: "830", 1: "830", 2: "1500", 3: "-2.5", 4: "1e-07"},
        {0: "2024-01-01", 1: "2024-01-01 12:00:00", 2: "45292", 3: "1900-02-28", 4: "1900-03-01"},
        {0: "True", 2: "a b", 3: "2024-01-02"},
    ]
    assert list(sheet_rows(workbook('<row><c s="1"><v>0</v></c></row>', since_1904=True))) == [{0: "1904-01-01"}]
    assert list(sheet_rows(workbook(""))) == []


HEAD = ("Year", "Month", "Reporting_Airline", "Origin", "Dest", None, "DepTime")


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text("Year,Month,Reporting_Airline,Origin,Dest\n2024,1,DL,BOS,SEA\n2024,1,AA,BOS,JFK\n")
    (raw / "b [1] 50%.xlsx").write_bytes(workbook(lines(HEAD, (2024, 2, "DL", "BOS", "SEA", None, 830.0), (2024, 2, "UA", "BOS", "JFK"), (2024, 2, "AA", "BOS", "LAX"))))
    (raw / "C.XLSX").write_bytes(workbook(lines(("Month", "Year", "Dest", "Origin", "Reporting_Airline"), *[(3, 2024, "SEA", "BOS", "DL")] * 25_000)))
    (raw / "empty.xlsx").write_bytes(workbook(""))
    return raw


def test_folder_of_both(spark, folder):
    df = read_ontime(spark, str(folder), source="from")
    got = sorted((r.Month, r.Origin, r.Dest, r.Reporting_Airline, r.DepTime, r["from"].rpartition("/")[2]) for r in df.distinct().collect())
    assert got == [
        ("1", "BOS", "JFK", "AA", None, "a.csv"),
        ("1", "BOS", "SEA", "DL", None, "a.csv"),
        ("2", "BOS", "JFK", "UA", None, "b [1] 50%.xlsx"),
        ("2", "BOS", "LAX", "AA", None, "b [1] 50%.xlsx"),
        ("2", "BOS", "SEA", "DL", "830", "b [1] 50%.xlsx"),
        ("3", "BOS", "SEA", "DL", None, "C.XLSX"),
    ]
    assert df.count() == 25_005
    assert len(header_groups(spark, str(folder))) == 3 and "_c5" in df.columns
    with pytest.raises(ValueError, match="no file with a header"):
        read_ontime(spark, str(folder / "empty.xlsx"))


def test_load_of_both(spark, folder, tmp_path):
    flights = str(tmp_path / "t/flights")
    first = load_files(spark, str(folder), flights)
    told = {f.file.rpartition("/")[2]: f for f in first.files}
    assert first.loaded == 25_003 and {n: f.loaded for n, f in told.items()} == {"a.csv": 1, "b [1] 50%.xlsx": 2, "C.XLSX": 25_000, "empty.xlsx": 0}
    assert "DepTime" in told["C.XLSX"].missing and "DepTime" not in told["b [1] 50%.xlsx"].missing
    assert [f.rpartition("/")[2] for f in first.without_rows] == ["empty.xlsx"]
    assert load_files(spark, str(folder), flights).known_files == 4
    assert [r.DepTime for r in spark.read.parquet(flights).filter("DepTime IS NOT NULL").collect()] == [830]
