"""Spreadsheet workbooks (.xlsx) as tables: the first sheet of each, by its first row with a value, all text.

Spark lists the workbooks and hands each one whole to a task, as a zipped file can't be split; the format bounds a sheet at 1,048,576 rows. The
task streams the sheet's rows and sends them on in Arrow batches, so that no sheet is ever held as a tree or as a list of rows.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "*.[xX][lL][sS][xX]"
AT_ONCE = 10_000
#: The built-in number formats that show a date or a time of day with a date.
DATE_FORMATS = frozenset({14, 15, 16, 17, 22})


def is_sheet(path) -> F.Column:
    return F.lower(path).endswith(".xlsx")


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _all(tree: ElementTree.Element | None, tag: str) -> list[ElementTree.Element]:
    return [] if tree is None else [e for e in tree.iter() if _plain(e.tag) == tag]


def _text(item: ElementTree.Element) -> str:
    """The text of a string's runs; phonetic hints are no part of it."""
    if _plain(item.tag) == "rPh":
        return ""
    return (item.text or "" if _plain(item.tag) == "t" else "") + "".join(_text(child) for child in item)


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The name of the first sheet's part, and whether days count from 1904."""
    top = _tree(book, "xl/workbook.xml")
    sheet = _all(top, "sheet")[0]
    link = next(v for k, v in sheet.attrib.items() if _plain(k) == "id")
    target = next(e.get("Target") for e in _all(_tree(book, "xl/_rels/workbook.xml.rels"), "Relationship") if e.get("Id") == link)
    since_1904 = any(e.get("date1904") in ("1", "true") for e in _all(top, "workbookPr"))
    return (target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")), since_1904


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles whose numbers are dates: by a built-in format, or one of the workbook's own with a day or a year."""
    tree = _tree(book, "xl/styles.xml")
    bare = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode", "")).lower() for e in _all(tree, "numFmt")}
    dates = DATE_FORMATS | {k for k, code in bare.items() if re.search("[dy]", code)}
    cells = _all(tree, "cellXfs")
    return {i for i, e in enumerate(cells[0] if cells else []) if int(e.get("numFmtId", 0)) in dates}


def _number(text: str) -> str:
    """A number without an exponent, and without a fraction where it has none."""
    x = float(text)
    if x.is_integer() and abs(x) < 1e15:
        return str(int(x))
    return text if "e" not in text.lower() else repr(x)


def _moment(text: str, since_1904: bool) -> str:
    """A day number as a date, with the time of day if it has one. 1900 counts as a leap year, so days before its March stand one off."""
    days = float(text)
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    at = start + timedelta(seconds=round(days * 86400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _column(ref: str | None, after: int) -> int:
    """The place of a cell, from its reference or as the next one."""
    letters = re.match("[A-Z]*", (ref or "").upper()).group()
    at = 0
    for x in letters:
        at = 26 * at + ord(x) - 64
    return at - 1 if letters else after + 1


def sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """The rows of a workbook's first sheet that hold a value: column from 0 to text. Errors and empty cells have no value."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        name, since_1904 = _first_sheet(book)
        dates = _date_styles(book)
        shared = [_text(e) for e in _all(_tree(book, "xl/sharedStrings.xml"), "si")]

        def value(cell: ElementTree.Element) -> str | None:
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                return "".join(_text(e) for e in cell if _plain(e.tag) == "is") or None
            text = next((e.text for e in cell if _plain(e.tag) == "v"), None)
            if text is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(text)] or None
            if kind == "n":
                return _moment(text, since_1904) if int(cell.get("s", 0)) in dates else _number(text)
            return {"b": {"1": "True", "0": "False"}}.get(kind, {}).get(text, text)

        with book.open(name) as part:
            above: list[ElementTree.Element] = []
            for event, element in ElementTree.iterparse(part, ("start", "end")):
                if event == "start":
                    above.append(element)
                    continue
                above.pop()
                if _plain(element.tag) != "row":
                    continue
                row, at = {}, -1
                for cell in element:
                    at = _column(cell.get("r"), at)
                    text = value(cell)
                    if text is not None:
                        row[at] = text
                above[-1].remove(element)
                if row:
                    yield row


def names_of(row: dict[int, str]) -> list[str]:
    """Column names from a header row: unnamed ones by their place, repeated ones with it."""
    out: list[str] = []
    for i in range(max(row) + 1):
        name = row.get(i, "").strip() or f"_c{i}"
        out.append(f"{name}{i}" if name in out else name)
    return out


def _books(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(list(paths)).select(F.col("path").alias("file"), "content")


def sheet_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, header (the names as a JSON list) of each workbook among the files at the paths that has a row."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                row = next(sheet_rows(content.as_py()), None)
                if row is not None:
                    yield pa.record_batch([[file.as_py()], [json.dumps(names_of(row))]], ["file", "header"])

    return _books(spark, paths).mapInArrow(first, "file string, header string")


def table_rows(columns: Sequence[str]) -> Callable:
    """Batches of (file, content) to (file, columns), in batches of AT_ONCE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(file: str, rows: list[dict[int, str]]) -> pa.RecordBatch:
            cells = [pa.array([r.get(i) for r in rows], pa.string()) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *cells], names=["_file", *columns])

        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                rows, lines = [], sheet_rows(content.as_py())
                if names_of(next(lines, {0: ""})) != list(columns):
                    raise ValueError(f"{file} has other columns than {columns}")
                for row in lines:
                    rows.append(row)
                    if len(rows) == AT_ONCE:
                        yield out(file.as_py(), rows)
                        rows = []
                if rows:
                    yield out(file.as_py(), rows)

    return run


def sheet_table(books: DataFrame, columns: Sequence[str], source: str | None = None) -> DataFrame:
    """The rows of workbooks given as (file, content), all text; one whose header isn't `columns` is an error. With `source`, a column of that
    name has each row's file."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in ("_file", *columns))
    df = books.select("file", "content").mapInArrow(table_rows(columns), schema)
    return df.withColumnRenamed("_file", source) if source else df.drop("_file")


def read_sheets(spark: SparkSession, files: Sequence[str], header: str, source: str | None = None) -> DataFrame:
    """Workbooks of one header, a JSON list as `sheet_headers` gives it."""
    return sheet_table(_books(spark, files), json.loads(header), source)


#: The least parts of a workbook.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def workbooks(columns: Sequence[str], numbers: Sequence[str] = ()) -> Callable:
    """Batches of text columns to (file, content): a workbook of each batch, with the columns in `numbers` as numbers."""

    def cell(x: str | None, number: bool) -> str:
        if x is None:
            return "<c/>"
        return f"<c><v>{escape(x)}</v></c>" if number else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, batch in enumerate(batches):
            cells = [[cell(x, c in numbers) for x in batch.column(c).to_pylist()] for c in columns]
            rows = [[cell(c, False) for c in columns], *zip(*cells, strict=True)]
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                for name, text in PARTS.items():
                    book.writestr(name, text)
                sheet = "".join(f"<row>{''.join(r)}</row>" for r in rows)
                book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
            yield pa.record_batch([pa.array([f"{part}-{nth}.xlsx"]), pa.array([out.getvalue()])], ["file", "content"])

    return run


def as_workbooks(df: DataFrame, numbers: Sequence[str] = ()) -> DataFrame:
    """file, content: the rows of df, all text, as workbooks of one Arrow batch each, which no sheet's bound reaches by Spark's settings."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).mapInArrow(workbooks(df.columns, numbers), "file string, content binary")
