import json

import pytest

from ledgerloom.sources import json_records, loader

ROWS = [{"id": 1, "user": {"name": "a", "at": {"x": 2}}, "tags": ["t"], "deep": [{"q": "long " * 60}], "none": [], "v": 1.5}, {"id": 2, "user": {"name": None}, "v": 2}]


def write(tmp_path, name, value):
    p = tmp_path / name
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


@pytest.mark.parametrize(
    ("name", "value", "structure", "key"),
    [
        ("a.json", ROWS, "array", None),
        ("w.json", {"meta": {"v": 1}, "data": ROWS}, "object_with_data", "data"),
        ("p.json", json.dumps({"meta": {"v": 1}, "rows": ROWS}, indent=2), "object_with_data", "rows"),
        ("n.json", {"page": {"info": {"deep": 1}}, "found": ROWS}, "nested", "found"),
        ("l.json", "\n".join(map(json.dumps, ROWS)), "jsonlines", None),
        ("l.jsonl", "\n\n".join(map(json.dumps, ROWS)) + "\n", "jsonlines", None),
    ],
)
def test_five_shapes_give_the_same_rows(spark, tmp_path, name, value, structure, key):
    r = loader.load_file(spark, write(tmp_path, name, value))
    assert r.success, r.error
    assert (r.metadata["json_structure"], r.metadata["data_key"]) == (structure, key)
    got = {x.id: x for x in r.df.collect()}
    assert set(r.df.columns) == {"id", "user_name", "user_at_x", "tags", "deep", "none", "v"}
    assert got[1].user_name == "a" and got[1].user_at_x == 2 and got[1].tags == ["t"] and json.loads(got[1].deep) == ROWS[0]["deep"] and got[1].none == []
    assert got[2].user_name is None and got[2].user_at_x is None and got[2].v == 2.0
    assert json.loads(loader.read_json(spark, write(tmp_path, name, value), flatten=False).where("id = 1").selectExpr("to_json(user) u").first().u)["name"] == "a"


def test_single_object(spark, tmp_path):
    r = loader.load_file(spark, write(tmp_path, "o.json", {"a": 1, "b": {"c": "x"}}))
    assert r.metadata["json_structure"] == "single_object" and r.df.first().asDict() == {"a": 1, "b_c": "x"}
    assert loader.json_shape(spark, write(tmp_path, "d.json", {"a": {"b": {"c": 1}}})) == "nested"
    assert loader.read_json(spark, write(tmp_path, "d.json", {"a": {"b": {"c": 1}}})).first().asDict() == {"a_b_c": 1}


def test_mixed_types_are_text(spark, tmp_path):
    rows = [{"a": 1}, {"a": "t"}, {"a": {"z": [1]}}, {"a": None}, {"b": True}]
    for name, value in (("m.json", rows), ("m.jsonl", "\n".join(map(json.dumps, rows)))):
        got = loader.read_json(spark, write(tmp_path, name, value)).collect()
        assert sorted(x.a or "" for x in got) == ["", "", "1", "t", '{"z":[1]}'] or sorted(x.a or "" for x in got) == ["", "", "1", '{"z":[1]}', "t"]
        assert [x.b for x in got if x.b] == [True]


def test_names_lists_and_keys(spark, tmp_path):
    rows = [{"e e": 1, "a.b": {"c`d": "x"}, "a": {"b_c": 5}, "a_b": {"c": 6}, "list": [[1, 2], [3]]}]
    df = loader.read_json(spark, write(tmp_path, "k.json", rows))
    got = df.first().asDict()
    assert got["e e"] == 1 and got["a.b_c`d"] == "x" and sorted(v for k, v in got.items() if k.startswith("a_b")) == [5, 6] and got["list"] == "[[1,2],[3]]"
    assert loader.read_json(spark, write(tmp_path, "k.json", rows), list_chars=5).first()["list"] == "[[1,2"
    picked = loader.load_file(spark, write(tmp_path, "q.json", {"mine's": [{"a": 1}], "n": 1}), data_key="mine's")
    assert picked.metadata["data_key"] == "mine's" and picked.df.first().a == 1


def test_dates_and_bad_lines(spark, tmp_path):
    lines = [json.dumps({"created_at": f"2024-01-0{i + 1}", "note": "x"}) for i in range(9)] + ["no json"]
    r = loader.load_file(spark, write(tmp_path, "b.jsonl", "\n".join(lines)))
    assert dict(r.df.dtypes) == {"created_at": "timestamp", "note": "string"} and r.df.count() == 9 and r.metadata["lines_left_out"] == 1
    assert not loader.load_file(spark, write(tmp_path, "c.json", '{"a": ')).success
    assert loader.read_json(spark, write(tmp_path, "v.json", [1, "x", None])).count() == 3


def test_depth():
    from pyspark.sql import types as T

    of = T.DataType.fromDDL
    assert [json_records.depth(t) for t in (of("a int"), of("a struct<b: int>"), of("a array<struct<b: int>>"), T.ArrayType(T.NullType()), T.IntegerType())] == [1, 2, 3, 0, 0]
