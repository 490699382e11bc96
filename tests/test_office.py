import datetime
import zipfile

import pytest

from ledgerloom.sources import loader, office

R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rels(**links):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in links.items()) + "</Relationships>"


def cell(ref, v, kind="", style=""):
    return f'<c r="{ref}"{f" t={kind!r}" if kind else ""}{f" s={style!r}" if style else ""}><v>{v}</v></c>'.replace("'", '"')


def workbook(path):
    """Sheets in another order than their files, the first without values; dates by style, a boolean, an error, a gap."""
    sheet = lambda rows: "<worksheet><sheetData>" + "".join(f'<row r="{i}">{"".join(cs)}</row>' for i, cs in rows) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {R}><sheets><sheet name="Empty" r:id="a"/><sheet name="Campaign" r:id="b"/><sheet name="Notes" r:id="c"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels(a="worksheets/sheet3.xml", b="worksheets/sheet1.xml", c="/xl/worksheets/sheet2.xml"))
        z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>date</t></si><si><t>campaign</t></si><si><r><t>cli</t></r><r><t>cks</t></r></si><si><t>Summer</t></si></sst>")
        head = [cell("A3", 0, "s"), cell("B3", 1, "s"), cell("C3", 2, "s"), cell("E3", "on", "str"), cell("F3", "wait", "str")]
        rows = [(1, [cell("A1", "Report", "str")]), (3, head)]
        rows += [(4 + i, [cell(f"A{4 + i}", 45292 + i + 0.5 * (i == 2), style="1" if i else "3"), cell(f"B{4 + i}", 3, "s"), cell(f"C{4 + i}", 10 * i), cell(f"E{4 + i}", i % 2, "b"), cell(f"F{4 + i}", 2.5, style="2"), cell(f"G{4 + i}", "#N/A", "e")]) for i in range(3)]
        z.writestr("xl/worksheets/sheet1.xml", sheet([*rows, (9, [cell("B9", "", "str")])]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([(1, [cell("A1", "k", "str"), cell("B1", "k", "str")]), (2, [cell("A2", 1), cell("B2", 2)])]))
        z.writestr("xl/worksheets/sheet3.xml", sheet([]))
    return str(path)


def test_excel(spark, tmp_path):
    p = workbook(tmp_path / "a.xlsx")
    df = office.read_excel(spark, p, header_row=2)
    assert dict(df.dtypes) == {"date": "timestamp", "campaign": "string", "clicks": "bigint", "on": "boolean", "wait": "double"}
    got = sorted(df.collect(), key=lambda r: r.clicks)
    assert [r.date for r in got] == [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 3, 12)] and [r.on for r in got] == [False, True, False]
    assert office.read_excel(spark, p, "Campaign", 1, (0,)).columns == df.columns and office.read_excel(spark, p, 1, 2, (4,)).count() == 2
    notes = loader.load_file(spark, p, sheet="Notes")
    assert notes.success and notes.df.columns == ["k", "k_2"] and notes.df.first().asDict() == {"k": 1, "k_2": 2}
    assert [(r.part, r.rows, r.columns, r.has_data) for r in office.sheet_info(spark, p).orderBy("place").collect()] == [("Empty", 0, 0, False), ("Campaign", 5, 7, True), ("Notes", 2, 2, True)]
    assert "no table" in loader.load_file(spark, p, sheet="Absent").error


def test_days_of_both_counts():
    assert [office._day(s, False) for s in ("1", "59", "61", "45292.25")] == ["1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "2024-01-01 06:00:00"]
    assert office._day("0", True) == "1904-01-01 00:00:00"


def para(text, style=None):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={style!r}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'.replace("'", '"')


def table(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def word(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", '<w:styles xmlns:w="w"><w:style w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="dc"><dc:title>Plan</dc:title><dc:creator>Ada</dc:creator></c>')
    return str(path)


def test_word(spark, tmp_path):
    body = para("Year", "berschrift1") + para("Some text") + table([["Month", "Revenue"], ["Jan", "800"], ["Feb", ""]]) + para("Part", "Heading2") + table([["x", "x"], ["1", "2"]])
    p = word(tmp_path / "a.docx", body)
    cells = office.read_documents(spark, p)
    assert sorted(tuple(r.cells) for r in cells.where("kind = 'heading'").collect()) == [("Part", "Heading2", "2"), ("Year", "heading 1", "1")]
    s = office.document_summary(cells).first()
    assert (s.tables, s.paragraphs, s.headings, s.title, s.author) == (2, 3, 2, "Plan", "Ada")
    r = loader.load_file(spark, p)
    assert r.success and sorted((x.Month, x.Revenue) for x in r.df.collect()) == [("Feb", None), ("Jan", 800)]
    assert sorted(tuple(x) for x in office.word_table(cells, 1).collect()) == [("1", "2"), ("x", "x")] and office.word_table(cells, 1).columns == ["0", "1"]
    assert office.word_table(cells, 7).columns == ["Month", "Revenue"]
    texts = loader.load_file(spark, word(tmp_path / "b.docx", para("One") + para("Two", "Title")))
    assert sorted(tuple(x) for x in texts.df.collect()) == [(1, "One", "Normal"), (2, "Two", "Title")]


def slide(*shapes):
    return "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(shapes) + "</p:sld>"


def shape(text, kind=None):
    return f"<p:sp><p:nvSpPr><p:nvPr>{f'<p:ph type={kind!r}/>' if kind else ''}</p:nvPr></p:nvSpPr><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sp>"


def slide_rows(rows):
    return "<a:tbl>" + "".join("<a:tr>" + "".join(f"<a:tc><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:tc>" for c in r) + "</a:tr>" for r in rows) + "</a:tbl>"


CHART = "<c:chart xmlns:c='c'>" + "".join(
    f"<c:ser><c:tx><c:pt idx='0'><c:v>{n}</c:v></c:pt></c:tx><c:cat><c:pt idx='0'><c:v>Q1</c:v></c:pt><c:pt idx='1'><c:v>Q2</c:v></c:pt></c:cat><c:val>{''.join(f'<c:pt idx={i!r}><c:v>{v}</c:v></c:pt>' for i, v in vs)}</c:val></c:ser>".replace("idx=0", "idx='0'").replace("idx=1", "idx='1'")
    for n, vs in (("North", ((0, 5), (1, 7))), ("South", ((1, 9),)))) + "</c:chart>"


def slides(path, second):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:p xmlns:p="p" {R}><p:sldId id="1" r:id="x"/><p:sldId id="2" r:id="y"/></p:p>'.replace('id="1" ', "").replace('id="2" ', ""))
        z.writestr("ppt/_rels/presentation.xml.rels", rels(x="slides/slide2.xml", y="slides/slide1.xml"))
        z.writestr("ppt/slides/slide2.xml", slide(shape("Report 2024", "ctrTitle"), shape("by us")))
        z.writestr("ppt/slides/slide1.xml", slide(shape("Months", "title"), slide_rows([["Month", "Revenue", "Growth"], ["Jan", "€800K", "15%"], ["Feb", "€850K", "6%"]]), second))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rels(n="../notesSlides/notesSlide1.xml", c="../charts/chart1.xml"))
        z.writestr("ppt/notesSlides/notesSlide1.xml", slide(shape("Say this", "body"), shape("2", "sldNum")))
        z.writestr("ppt/charts/chart1.xml", CHART)
    return str(path)


def test_slides(spark, tmp_path):
    p = slides(tmp_path / "a.pptx", slide_rows([["alone"]]))
    cells = office.read_documents(spark, p)
    assert sorted((r.place, r.kind, r.cells[0]) for r in cells.where("kind in ('title', 'text', 'notes')").collect()) == [(0, "text", "by us"), (0, "title", "Report 2024"), (1, "notes", "Say this"), (1, "title", "Months")]
    assert [tuple(r) for r in office.table_of(cells, "slide2/chart1").orderBy("category").collect()] == [("Q1", "5", None), ("Q2", "7", "9")] and office.table_of(cells, "slide2/chart1").columns == ["category", "North", "South"]
    s = office.document_summary(cells).first()
    assert (s.slides, s.tables, s.charts, s.notes) == (2, 1, 1, 1)
    r = loader.load_file(spark, p)
    assert r.success and sorted(tuple(x) for x in r.df.collect()) == [("Feb", "€850K", "6%"), ("Jan", "€800K", "15%")]


def test_tables_of_same_columns_are_joined(spark, tmp_path):
    same = office.read_documents(spark, slides(tmp_path / "a.pptx", slide_rows([["Growth", "Month", "Revenue"], ["1%", "Mar", "€1K"]])))
    assert {r.Month for r in office.slide_table(same).collect()} == {"Jan", "Feb", "Mar"}
    other = office.read_documents(spark, slides(tmp_path / "b.pptx", slide_rows([["k"], ["1"], ["2"], ["3"]])))
    assert office.slide_table(other).columns == ["k"]
    with pytest.raises(ValueError):
        office.union_or_largest({})
