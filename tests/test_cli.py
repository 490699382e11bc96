import zipfile

from ledgerloom import cli


def test_analyze_and_tables(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda name: spark)
    (tmp_path / "a.csv").write_text("region,revenue,units\n" + "".join(f"r{i % 3},{i * 10.5},{i}\n" for i in range(30)))
    assert cli.main(["analyze", str(tmp_path / "a.csv")]) == 0
    said = capsys.readouterr().out
    assert "revenue" in said and "positive" in said and "region" in said
    assert cli.main(["load", str(tmp_path / "a.csv")]) == 0 and "currency" in capsys.readouterr().out
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:tbl><w:tr>{cell("Month")}{cell("Sum")}</w:tr><w:tr>{cell("Jan")}{cell("8")}</w:tr></w:tbl></w:body></w:document>')
    assert cli.main(["tables", "-d", str(tmp_path / "b.docx")]) == 0
    said = capsys.readouterr().out
    assert "document/table1: 1 rows, Month, Sum" in said and "Jan" in said
    assert cli.main(["load", str(tmp_path / "absent.csv")]) == 1
