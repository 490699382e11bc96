import json
import zipfile

import pytest

from ledgerloom.functions.text_metrics import text_metrics
from ledgerloom.operators import narrate
from ledgerloom.sources import loader, office
from ledgerloom.streaming import rollup


def test_csv_with_locale(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("order_date;customer_id;revenue\n2024-01-05;c1;1.234,50\n2024-01-06;c2;10,25\n2024-01-07;c3;7,00\n", encoding="utf-8")
    r = loader.load_file(spark, str(p))
    assert r.success, r.error
    assert dict(r.df.dtypes) == {"order_date": "timestamp", "customer_id": "string", "revenue": "double"}
    assert r.df.agg({"revenue": "sum"}).first()[0] == 1251.75
    assert (r.mapping.date, r.mapping.revenue, r.mapping.customer) == ("order_date", "revenue", "customer_id")


def test_json_shapes(spark, tmp_path):
    rows = [{"id": 1, "user": {"name": "a", "at": {"x": 2}}, "tags": ["t"], "deep": [{"q": 1}]}]
    for name, text in (("w.json", json.dumps({"meta": {"v": 1}, "data": rows})), ("l.jsonl", "\n".join(map(json.dumps, rows))), ("a.json", json.dumps(rows))):
        p = tmp_path / name
        p.write_text(text)
        df = loader.read_json(spark, str(p))
        r = df.first()
        assert df.count() == 1 and r.user_name == "a" and r.user_at_x == 2 and r.tags == ["t"] and r.deep == '[{"q":1}]'


def test_errors_are_values(spark, tmp_path):
    assert "not supported" in loader.load_file(spark, "x.ppt").error
    assert not loader.load_file(spark, str(tmp_path / "absent.csv")).success
    with pytest.raises(ValueError):
        loader.preview(spark, "x.doc")


def sheet(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="Campaign"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si><si><t>clicks</t></si><si><t>a</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c></row><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>')


def test_office_files(spark, tmp_path):
    sheet(tmp_path / "a.xlsx")
    df = loader.load_file(spark, str(tmp_path / "a.xlsx")).df
    assert sorted((r.name or "", r.clicks) for r in df.collect()) == [("", 7), ("a", 5)]
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr>{cell("Month")}{cell("Revenue")}</w:tr><w:tr>{cell("Jan")}{cell("800")}</w:tr></w:tbl></w:body></w:document>')
    got = office.read_documents(spark, str(tmp_path / "b.docx"))
    assert [r.cells for r in got.where("kind = 'text'").collect()] == [["Title", "Normal"]]
    assert office.table_of(got).first().asDict() == {"Month": "Jan", "Revenue": "800"}
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    assert office.read_documents(spark, str(tmp_path / "bad.pptx")).first().kind == "error"


def test_many_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n3,4\n")
    df = loader.load_many(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "c.doc"], combine=True)
    assert df.count() == 2 and set(df.columns) == {"x", "y", "z", "_source_file"}
    assert loader.file_info(spark, str(tmp_path)).where("supported").count() == 2


def test_text_metrics(spark):
    text = "Revenue: €1,5 Mio (+15%)\nCustomers: 12,500 at a 3:1 ratio"
    got = {(r.kind, r.label, r.value) for r in text_metrics(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t").collect()}
    assert {("percentage", None, "+15%"), ("kpi", "Customers", "12,500"), ("ratio", None, "3:1")} <= got


def test_readings():
    assert narrate.read_ab_test(12, 0.01, 2000, 2000).recommendations == ["Implement B"]
    assert narrate.read_ab_test(12, 0.5, 10, 2000).warnings
    assert narrate.read_campaign({"ROAS": 4.5, "CTR": 0.5}).findings == ["ROAS 4.50: excellent", "CTR 0.50: low"]
    assert narrate.read_retention({1: 10, 6: 5}, 3, 30).warnings


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select timestamp_seconds(id * 600) ts, id % 2 u, if(id % 3 = 0, 'view', 'buy') k, cast(1 as double) v from range(300)").write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    for name, df in (("w", rollup.revenue_by_window(stream, "ts", "v")), ("s", rollup.funnel_by_session(stream, "u", "ts", "k", ["view", "buy"]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select sum(transactions) from w").first()[0] == 144
    assert spark.sql("select count(*) from s where view = 1 and buy = 1").first()[0] >= 0


def test_encoding_is_told_and_short_lines_stay(spark, tmp_path):
    f = tmp_path / "latin.csv"
    f.write_bytes("name,n\nM\u00fcller,1\nK\u00e4the\nAnna,2,3\nBo,4\n".encode("latin-1"))
    r = loader.load_file(spark, str(f))
    assert r.success, r.error
    assert sorted((x.name, x.n) for x in r.df.collect() if x.n) == [("Bo", 4), ("M\u00fcller", 1)]
    assert [x.name for x in r.df.where("n is null").collect()] == ["K\u00e4the"]
    assert {(x.line, x.kept) for x in loader.malformed_lines(spark, str(f)).collect()} == {("K\u00e4the", True), ("Anna,2,3", False)}
    assert loader.sniff_encoding("\u00e4".encode("utf-8") * 9) == "UTF-8" and loader.sniff_encoding(b"\xff\xfea\x00") == "UTF-16"
