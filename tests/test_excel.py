"""Workbooks made part by part, as Excel writes them."""

import io
import zipfile

import pytest

from quartier.sources import excel as X

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
LINKS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def workbook(sheets, shared=(), styles="", props=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}>{props}<sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {LINKS}>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i == 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{x}</si>" for x in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
    return out.getvalue()


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy\\ hh:mm"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
SHEET = (
    '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t> note </t></is></c></row>'
    '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>12</v></c><c r="D3" t="str"><f>A1</f><v>a &amp; b</v></c></row>'
    '<row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" s="1"><v>45839</v></c><c r="D5" t="e"><v>#N/A</v></c></row>'
    '<row r="6"><c r="A6"/><c r="B6" s="2"><v>45839.75</v></c><c r="AA6"><v>1</v></c></row>'
    '<row><c><v>1.5</v></c><c s="3"><v>1E3</v></c></row><row r="9"><c r="A9" t="inlineStr"><is><t></t></is></c></row>'
)
SHARED = ["<t>name</t>", "<t>code</t>", "<r><t>Phường </t></r><r><t>Bến Nghé</t></r><rPh><t>no</t></rPh>"]


def test_rows():
    book = workbook({"A": SHEET, "B": '<row r="1"><c r="A1" t="b"><v>0</v></c></row>'}, SHARED, STYLES)
    assert list(X.rows_of(book)) == [
        [],
        ["name", "code", None, " note "],
        ["Phường Bến Nghé", "12", None, "a & b"],
        [],
        ["TRUE", "2025-07-01", None, None],
        [None, "2025-07-01 18:00:00", *[None] * 24, "1"],
        ["1.5", "1000"],
        [],
        [""],
    ]
    assert list(X.rows_of(book, "B")) == [["FALSE"]] and list(X.rows_of(book, "C")) == [] and list(X.rows_of(book, 1)) == [["FALSE"]]
    assert list(X.rows_of(workbook({"A": '<row r="1"><c r="A1" s="1"><v>1</v></c></row>'}, (), STYLES, '<workbookPr date1904="1"/>'))) == [["1904-01-02"]]


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "ROWS", 2)
    (tmp_path / "a.xlsx").write_bytes(workbook({"A": SHEET}, SHARED, STYLES))
    (tmp_path / "b.xlsx").write_bytes(workbook({"A": '<row><c t="inlineStr"><is><t>code</t></is></c></row>' + "".join(f"<row><c><v>{i}</v></c></row>" for i in range(5))}))
    (tmp_path / "c.xlsx").write_bytes(workbook({"A": ""}))
    (tmp_path / "other.txt").write_text("no workbook")
    got = X.excel(spark, str(tmp_path))
    assert got.columns == ["name", "code", "note"]
    want = [("Phường Bến Nghé", "12", "a & b"), ("TRUE", "2025-07-01", None), (None, "2025-07-01 18:00:00", None), ("1.5", "1000", None), *[(None, str(i), None) for i in range(5)]]
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, want))
    plain = X.excel(spark, str(tmp_path / "b.xlsx"), ["x", "y"], header=False).collect()
    assert [tuple(x) for x in plain] == [("code", None), *[(str(i), None) for i in range(5)]]
    with pytest.raises(ValueError, match="name the columns"):
        X.excel(spark, str(tmp_path), header=False)


def test_columns_with_odd_names_and_no_files(spark):
    files = spark.createDataFrame([("a", bytearray(workbook({"A": SHEET}, SHARED, STYLES))), ("b", None)], "path string, content binary")
    got = X.sheets(files, ["code", "a`b", "note"]).collect()
    assert [(x.row, x.code, x["a`b"], x.note) for x in got] == [(3, "12", None, "a & b"), (5, "2025-07-01", None, None), (6, "2025-07-01 18:00:00", None, None), (7, "1000", None, None)]
    assert X.sheets(files.limit(0), ["code"]).collect() == [] and X.header_of(files.limit(0)) == []


def test_workbooks(spark):
    rows = [("x", "a<&>\n b", None), ("x", " ", "é日"), ("y", None, "only"), (None, "null group", "z")]
    wide = spark.createDataFrame([(*r, *range(30)) for r in rows], "g string, `a b` string, c string, " + ", ".join(f"k{i} int" for i in range(30)))
    files = X.workbooks(wide, "g")
    assert sorted(x.path for x in files.collect()) == ["None.xlsx", "x.xlsx", "y.xlsx"]
    got = X.sheets(files, ["a b", "c", "k29", "k0"]).collect()
    assert sorted(map(str, ((x["a b"], x.c, x.k29, x.k0) for x in got))) == sorted(map(str, ((a, c, "29", "0") for _, a, c in rows)))
