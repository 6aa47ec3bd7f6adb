"""Excel workbooks as tables.

Spark reads the files' bytes, from any store that it reads, and tasks unpack them: a workbook is a zip of XML, which can't be entered in the middle, so the
unit of work is a file. Its sheet is parsed as a stream, and rows go on in batches; only the texts that its cells share are held. All values are texts: whole numbers
without a decimal point, dates and times in ISO form where a cell's format says so, TRUE and FALSE; empty cells and errors are null.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 10_000
_MAIN, _LINKS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats of dates and times.
_DATES = {*range(14, 23), *range(45, 48)}


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """Elements of a part of the workbook, each freed once it was looked at; none where there is no such part."""
    if name not in book.namelist():
        return
    with book.open(name) as part:
        stack = []
        for event, e in iterparse(part, ("start", "end")):
            if event == "start":
                stack.append(e)
                continue
            stack.pop()
            if e.tag == tag:
                yield e
                e.clear()
                if stack:
                    stack[-1].remove(e)


def _text(e) -> str:
    """The text of a shared or inline string, without the readings of phonetic guides."""
    return "".join(t.text or "" for t in e.iter(_MAIN + "t")) if e.find(_MAIN + "rPh") is None else "".join(t.text or "" for x in e if x.tag != _MAIN + "rPh" for t in x.iter(_MAIN + "t"))


def _sheet_part(book: zipfile.ZipFile, sheet: str | int) -> str | None:
    """The part that holds a sheet, by its name or its place from 0; None if there is none."""
    sheets = [(e.get("name"), e.get(_LINKS + "id")) for e in _elements(book, "xl/workbook.xml", _MAIN + "sheet")]
    own = [link for name, link in sheets if name == sheet] if isinstance(sheet, str) else [link for _, link in sheets[sheet : sheet + 1]]
    targets = {e.get("Id"): e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship")}
    target = targets.get(own[0]) if own else None
    return None if target is None else target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    own = {int(e.get("numFmtId")) for e in _elements(book, "xl/styles.xml", _MAIN + "numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode") or ""), re.I)}
    for formats in _elements(book, "xl/styles.xml", _MAIN + "cellXfs"):
        return {i for i, x in enumerate(formats.iter(_MAIN + "xf")) if int(x.get("numFmtId") or 0) in _DATES | own}
    return set()


def _number(value: str, is_date: bool, base: datetime) -> str:
    x = float(value)
    if is_date:
        at = base + timedelta(days=int(x), seconds=round(x % 1 * 86400))
        return at.strftime("%Y-%m-%d" if x == int(x) else "%Y-%m-%d %H:%M:%S")
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _place(reference: str) -> int:
    """The column of a cell, from 0."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = 26 * n + ord(c) - 64
    return n - 1


def rows_of(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet; those that are empty as well, up to the last one with a cell."""
    book = zipfile.ZipFile(io.BytesIO(content))
    part = _sheet_part(book, sheet)
    if part is None:
        return
    shared, dates = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", _MAIN + "si")], _date_styles(book)
    since_1904 = any(e.get("date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", _MAIN + "workbookPr"))
    base, number = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30), 0
    for row in _elements(book, part, _MAIN + "row"):
        for _ in range(number + 1, int(row.get("r") or number + 1)):
            yield []
        number = int(row.get("r") or number + 1)
        out: list[str | None] = []
        for c in row.iter(_MAIN + "c"):
            at = _place(c.get("r")) if c.get("r") else len(out)
            out += [None] * (at + 1 - len(out))
            kind, v = c.get("t") or "n", c.find(_MAIN + "v")
            if kind == "inlineStr":
                inline = c.find(_MAIN + "is")
                value = None if inline is None else _text(inline)
            elif v is None or v.text is None or kind == "e":
                value = None
            elif kind == "s":
                value = shared[int(v.text)]
            elif kind == "b":
                value = "TRUE" if v.text == "1" else "FALSE"
            else:
                value = v.text if kind in ("str", "d") else _number(v.text, int(c.get("s") or 0) in dates, base)
            out[at] = value
        yield out


def sheets(files: DataFrame, columns: Sequence[str], sheet: str | int = 0, header: bool = True) -> DataFrame:
    """`columns` of one sheet of each file (path, content), and `row`, its number in the sheet from 1, without rows that are empty.

    With a header, the first row that isn't empty names a file's columns: those asked for are looked up there, with blanks at the ends off, and are null where a file lacks them; of equal
    names the first counts. Without one they are the first columns from the left. A file without the sheet has no rows.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(path: str, held: list) -> pa.RecordBatch:
            arrays = [pa.array([path] * len(held), pa.string()), pa.array([n for n, _ in held], pa.int32())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([r[i] for _, r in held], pa.string()) for i in range(len(names))], names=["path", "row", *names])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                places: list[int | None] | None = None if header else list(range(len(names)))
                held: list = []
                for n, row in enumerate(rows_of(content.as_py(), sheet), 1):
                    if not any(x not in (None, "") for x in row):
                        continue
                    if places is None:
                        first = [(x or "").strip() for x in row]
                        places = [first.index(c) if c in first else None for c in names]
                        continue
                    held.append((n, [row[p] if p is not None and p < len(row) else None for p in places]))
                    if len(held) == ROWS:
                        yield out(path, held)
                        held = []
                yield out(path, held)

    kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    return files.filter("content IS NOT NULL").select("path", "content").mapInArrow(run, f"path string, row int, {kinds}")


def header_of(files: DataFrame, sheet: str | int = 0) -> list[str]:
    """The column names in the first row that isn't empty of the first file, by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = next((r for r in rows_of(content.as_py(), sheet) if any(x not in (None, "") for x in r)), [])
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[(x or "").strip() for x in row]], pa.list_(pa.string()))], names=["path", "names"])

    first = files.select("path", "content").mapInArrow(run, "path string, names array<string>").agg(F.min_by("names", "path")).first()[0]
    return [c for i, c in enumerate(first or []) if c and c not in first[:i]]


def excel(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """A sheet of all workbooks of a file, folder or pattern; columns are those of the first file's header if they aren't given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    if columns is None:
        if not header:
            raise ValueError("name the columns of sheets without a header")
        columns = header_of(files, sheet)
    return sheets(files, columns, sheet, header).drop("path", "row")


#: Fixed value: rows that a sheet holds at most.
SHEET_ROWS = 1_048_576


def workbooks(df: DataFrame, group: str) -> DataFrame:
    """(path, content): a workbook for each value of a column, with one sheet of its rows and the other columns' names above. A group with more rows than a sheet holds is an error.

    Values are written as texts; nulls as no cells. Files are written wherever `content` goes.
    """
    names = [c for c in df.columns if c != group]

    def build(table: pa.Table) -> pa.Table:
        if len(table) >= SHEET_ROWS:
            raise ValueError(f"{len(table)} rows are more than a sheet holds")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
            link = lambda kind, target: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_LINKS[1:-1]}/{kind}" Target="{target}"/></Relationships>'
            book.writestr("_rels/.rels", link("officeDocument", "xl/workbook.xml"))
            book.writestr("xl/_rels/workbook.xml.rels", link("worksheet", "worksheets/sheet1.xml"))
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_LINKS[1:-1]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
            with book.open("xl/worksheets/sheet1.xml", "w") as part:
                part.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                for number, row in enumerate([names, *zip(*(table.column(c).to_pylist() for c in names), strict=True)], 1):
                    cells = "".join(f'<c r="{_letters(i)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for i, x in enumerate(row) if x is not None)
                    part.write(f'<row r="{number}">{cells}</row>'.encode())
                part.write(b"</sheetData></worksheet>")
        return pa.table({"path": [f"{table.column(group)[0].as_py()}.xlsx"], "content": pa.array([out.getvalue()], pa.binary())})

    texts = df.select(F.col(group).cast("string").alias(group), *(F.col(c).cast("string").alias(c) for c in names))
    return texts.groupBy(group).applyInArrow(build, "path string, content binary")


def _letters(place: int) -> str:
    out = ""
    while place >= 0:
        out, place = chr(65 + place % 26) + out, place // 26 - 1
    return out
