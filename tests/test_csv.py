import csv
import io
import random
from contextlib import contextmanager

import pytest

from ledgerloom.sources import csv_records, loader


@contextmanager
def splits_of(spark, size):
    """Files are split every ``size`` bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def serial(text, delimiter=","):
    """Rows of one serial parser, blank lines left out, as the loader fills and cuts them."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=None), delimiter=delimiter) if r and any(x.strip() for x in r) or len(r) > 1]
    width = len(rows[0])
    null = lambda x: None if x in csv_records.MISSING else x
    return sorted((tuple(map(null, [*r, *[""] * (width - len(r))])) for r in rows[1:] if len(r) <= width), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def text_columns(spark, path):
    form = loader.csv_format(spark, str(path))
    return rows_of(loader._columns(loader._records(spark, str(path), form), form)), form


@pytest.mark.parametrize("seed", range(6))
def test_same_as_serial_parser_in_many_splits(spark, tmp_path, seed):
    rnd = random.Random(seed)
    cells = ["x", "1", "", "a b", '"q"', '"a,b"', '"line\none"', '"two\n\n""lines"""', '"""', '5" pipe', ' "no"', "é" * 20, '"' + "long\n" * 30 + '"', '"end"more', "NA"]
    cells.remove('"""')
    body = "".join(",".join(rnd.choice(cells) for _ in range(rnd.choice([3, 3, 3, 3, 1, 2, 4]))) + rnd.choice(["\n", "\n", "\r\n", "\n\n"]) for _ in range(150))
    text = 'a,"b",c\n' + body
    f = tmp_path / "a.csv"
    f.write_bytes(text.encode())
    for size in (40, 333, 10**6):
        with splits_of(spark, size):
            got, form = text_columns(spark, f)
            assert got == serial(text)
            if size == 40:
                assert spark.read.text(str(f)).rdd.getNumPartitions() > 20 and form.splits.inside


def test_line_break_in_quotes_at_a_split(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('a,b\n1,"line one\nline two"\n2,"x"\n')
    for size in range(4, 30, 3):
        with splits_of(spark, size):
            df = loader.read_csv(spark, str(f))
            assert rows_of(df) == [(1, "line one\nline two"), (2, "x")] and dict(df.dtypes) == {"a": "bigint", "b": "string"}


def test_header_over_lines_and_splits(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('﻿a,"b\nb","a",\n1,2,3,4\n', encoding="utf-8")
    for size in (5, 1000):
        with splits_of(spark, size):
            df = loader.read_csv(spark, str(f))
            assert df.columns == ["a", "b\nb", "a_1", "_c3"] and rows_of(df) == [(1, 2, 3, 4)]


def test_several_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "d" / "b.csv").write_text('a,b\n2,"z"\n3,\n')
    for size in (6, 1000):
        with splits_of(spark, size):
            assert rows_of(loader.read_csv(spark, str(tmp_path / "d"))) == [(1, "x\ny"), (2, "z"), (3, None)]


def test_short_quoted_lines_stay_and_long_ones_are_listed(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('a,b,c\n"x,y,z",1\n1,2,3\n"p,q",2,3,4\n')
    assert rows_of(loader.read_csv(spark, str(f))) == [("1", 2, 3), ("x,y,z", 1, None)]
    assert {(r.line, r.kept) for r in loader.malformed_lines(spark, str(f)).collect()} == {('"x,y,z",1', True), ('"p,q",2,3,4', False)}


def test_encodings(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes("n,town\n1,Köln\n2,Fürth".encode())
    assert [r.town for r in loader.read_csv(spark, str(f)).orderBy("n").collect()] == ["Köln", "Fürth"]
    f = tmp_path / "b.csv"
    f.write_bytes(("n,town\n" + "".join(f"{i},x\n" for i in range(40)) + "40,Köln\n").encode("latin-1"))
    r = loader.load_file(spark, str(f))
    assert r.df.where("n = 40").first().town == "Köln" and r.metadata["encoding"] == "ISO-8859-1" and r.metadata["rows"] == 41
    f = tmp_path / "c.csv"
    f.write_bytes("n,town\n1,Köln\n2,Ωmega\n".encode("utf-16"))
    r = loader.load_file(spark, str(f))
    assert r.success, r.error
    assert [x.town for x in r.df.orderBy("n").collect()] == ["Köln", "Ωmega"]


def test_types(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("id,flag,amount,mixed,order_date,year,code\n" + "".join(f"{i},{'True' if i % 2 else 'false'},{i}.5,{i if i else 'x'},2024-01-0{i % 9 + 1},2024,1d\n" for i in range(9)) + ",,NA,,bad,2025,2d\n")
    r = loader.load_file(spark, str(f))
    assert dict(r.df.dtypes) == {"id": "bigint", "flag": "boolean", "amount": "double", "mixed": "string", "order_date": "timestamp", "year": "bigint", "code": "string"}
    assert r.metadata["nulled"] == {"order_date": 1} and r.metadata["rows"] == 10


def test_errors(spark, tmp_path):
    for name, text, said in (("a.csv", 'a,b\n1,"never\nclosed\n', "never closed"), ("b.csv", "", "no header")):
        (tmp_path / name).write_text(text)
        assert said in loader.load_file(spark, str(tmp_path / name)).error


def test_header_alone_and_wide_table_of_gaps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    df = loader.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a", "b"] and df.count() == 0
    header = ["_source", *(f"c{i}" for i in range(33)), '"450,000"', "last"]
    (tmp_path / "b.csv").write_text("﻿" + ",".join(header) + "\n" + "\n".join(f"t{i}" + "," * 35 + ("7" if i == 3 else "") for i in range(26)) + "\n", encoding="utf-8")
    df = loader.load_file(spark, str(tmp_path / "b.csv")).df
    assert len(df.columns) == 36 and df.columns[0] == "_source" and df.columns[34] == "450,000" and df.count() == 26
    assert df.where("last is not null").first()["last"] == 7


def test_preview_reads_the_first_lines_alone(spark, tmp_path, monkeypatch):
    f = tmp_path / "a.csv"
    f.write_text('a,b\n1,"x\ny"\n2,z\n' + "".join(f"t{i},u\n" for i in range(5000)))
    monkeypatch.setattr(csv_records, "scan_splits", None)
    df = loader.preview(spark, str(f), 2)
    assert rows_of(df) == [(1, "x\ny"), (2, "z")]


def test_decimal_commas(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('n;v\n"1";1.234,50\n2;"7,25"\n')
    assert rows_of(loader.read_csv(spark, str(f))) == [(1, 1234.5), (2, 7.25)]


@pytest.mark.parametrize(("line", "inside", "ends"), [(b'a,"b', False, True), (b'b",c', True, False), (b'b"",c', True, True), (b'a"b', False, False), (b'"a""b"', False, False), (b'x","y', True, True), (b"", True, True), (b'"a"x"y,"', False, True)])
def test_ends_inside(line, inside, ends):
    assert csv_records.ends_inside(line, inside, b",") is ends
