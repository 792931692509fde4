import io
import zipfile

import pytest

from lakelore.operators import chunking
from lakelore.sources import workbooks as W

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheets, strings=(), styles=None, first1904=False, extra=()):
    """A workbook of sheets: (name, XML of its rows)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {_NS}><workbookPr{" date1904=\"1\"" if first1904 else ""}/><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {_NS}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {_NS}>{styles}</styleSheet>")
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def row(n, *cells):
    return f'<row r="{n}">{"".join(cells)}</row>'


def num(ref, v, s=0, f=None):
    return f'<c r="{ref}" s="{s}">{f"<f>{f}</f>" if f else ""}<v>{v}</v></c>'


def text(ref, i):
    return f'<c r="{ref}" t="s"><v>{i}</v></c>'


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm&quot; h &quot;"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/><numFmt numFmtId="172" formatCode="[h]:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="172"/></cellXfs>'


def test_cells():
    strings = ["<t>Name</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh>", "<t/>"]
    rows = row(1, text("A1", 0), '<c r="C1" t="inlineStr"><is><t>in line</t></is></c>') + row(
        3, text("B3", 1), '<c r="C3" t="b"><v>1</v></c>', num("D3", 3), num("E3", "3.50"), num("F3", "45000", s=1), num("G3", "45000.25", s=2), num("H3", "0.5", s=1), num("I3", "1.5", s=3), num("J3", "1.5", s=4), '<c r="K3" t="str"><f>A1</f><v>made</v></c>', '<c r="L3" t="e"><v>#DIV/0!</v></c>', text("N3", 2)
    )
    [(name, got, formulas)] = W.read_workbook(book([("S", rows + row(4, num("A4", " ") if False else '<c r="A4"/>') + row(9))], strings, STYLES))
    assert name == "S" and formulas == 1
    assert got[0] == ["Name", "", "in line"] and got[1] == []
    assert got[2] == ["", "rich text", "true", "3", "3.5", "2023-03-15T00:00:00", "2023-03-15T06:00:00", "12:00:00", "1.5", "1 day, 12:00:00", "made", "#DIV/0!", "", ""] and len(got) == 3
    [(_, later, _)] = W.read_workbook(book([("S", row(1, num("A1", 1, s=1)))], styles=STYLES, first1904=True))
    assert later == [["1904-01-02T00:00:00"]]
    assert [W.column(r) for r in ("A1", "Z9", "AA1", "XFD1")] == [0, 25, 26, 16383]


def test_sheets_that_cannot_be_read():
    good = row(1, num("A1", 1))
    for data, why in (
        (b"", "unreadable"), (b"PK no zip", "unreadable"), (b"\xd0\xcf\x11\xe0 old kind", "unreadable"), (book([("S", "")]), "empty"), (book([("S", row(1, '<c r="A1"/>'))]), "empty"),
        (book([("S", "<row><c></row>")]), "unreadable"), (book([("S", row(1, text("A1", 5)))]), "unreadable"), (book([("S", row(1, num("XFE1", 1)))]), "last column"), (book([("S", row(9_999_999, num("A1", 1)))]), "last one"),
    ):
        with pytest.raises(W.Unreadable, match=why):
            W.read_workbook(data)
    assert W.read_workbook(book([("empty", ""), ("S", good)]))[0][0] == "S"
    bomb = book([("S", good + "<!--" + "x" * 3_000_000 + "-->")])
    assert len(bomb) < 20_000
    with pytest.raises(W.Unreadable, match="too many bytes"):
        W.read_workbook(bomb, most=1 << 20)


def test_workbooks_as_documents(spark, tmp_path):
    """Sheets know their type, formulas make a financial model, and chunks keep their headers."""
    strings = ["<t>part</t>", "<t>price</t>", "<t>sum</t>"]
    lines = row(1, text("A1", 0), text("B1", 1), text("C1", 2)) + "".join(row(i, num(f"A{i}", i), num(f"B{i}", i * 2)) for i in range(2, 9))
    model = row(1, text("A1", 0), text("B1", 1)) + "".join(row(i, num(f"A{i}", i), num(f"B{i}", i, f=f"A{i}*2")) for i in range(2, 9))
    (tmp_path / "Prices 2024.xlsx").write_bytes(book([("lines", lines), ("model", model)], strings))
    (tmp_path / "broken.xlsx").write_bytes(b"PK")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    sheets = W.workbook_sheets(files).persist()
    got = {(r.path.rsplit("/", 1)[-1], r.sheet_name): r for r in sheets.collect()}
    first, second = got["Prices%202024.xlsx" if ("Prices%202024.xlsx", "lines") in got else "Prices 2024.xlsx", "lines"], next(r for r in got.values() if r.sheet_name == "model")
    assert (first.sheet_type, first.formulas, first.headers, first.rows[0]) == ("freeform", 0, ["part", "price", "sum"], ["2", "4", ""])
    assert (second.sheet_type, second.formulas) == ("financial_model", 7) and second.markdown.startswith("# model\n\n| part | price |\n| --- | --- |\n| 2 | 2 |")
    assert next(r for r in got.values() if r.sheet_name is None).parse_error.startswith("unreadable")
    docs = {r.path.rsplit("/", 1)[-1][:6]: r for r in W.workbook_documents(sheets).collect()}
    assert docs["broken"].tables == [] and docs["broken"].parse_error and [t.sheet_name for t in docs["Prices"].tables] == ["lines", "model"] and docs["Prices"].parse_error is None
    whole = W.workbook_documents(sheets).where("parse_error is null").withColumnRenamed("path", "document_id")
    chunks = chunking.chunk_documents(whole, chunking.Budget(size=20, row_overlap=1)).collect()
    assert len(chunks) > 2 and all("part" in c.text for c in chunks)
