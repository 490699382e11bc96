import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import cache, loader


@pytest.fixture
def kept(spark, tmp_path):
    return cache.TableCache(spark, str(tmp_path / "cache"))


def write(path, text, when=1_700_000_000):
    path.write_text(text)
    os.utime(path, (when, when))
    return str(path)


def test_the_second_load_reads_nothing_of_the_source(spark, tmp_path, kept, monkeypatch):
    p = write(tmp_path / "a.csv", "a,b\n1,x\n2,y\n")
    first = kept.load(p)
    assert sorted(map(tuple, first.df.collect())) == [(1, "x"), (2, "y")] and first.metadata["rows"] == 2
    for name in ("load_file", "content_digest"):
        monkeypatch.setattr(cache, name, None)
    os.chmod(p, 0)
    again = kept.load(p)
    assert sorted(map(tuple, again.df.collect())) == [(1, "x"), (2, "y")] and again.metadata == first.metadata and again.file_type == "csv"
    assert again.df.schema == first.df.schema and not any(f.endswith("a.csv") for f in again.df.inputFiles())
    os.chmod(p, 0o644)


def test_changed_content_misses_and_a_touched_file_hits(spark, tmp_path, kept, monkeypatch):
    p = write(tmp_path / "a.csv", "a,b\n1,x\n")
    first = kept.load(p)
    write(tmp_path / "a.csv", "a,b\n1,z\n", 1_700_000_100)
    assert kept.load(p).df.first().b == "z"
    write(tmp_path / "a.csv", "a,b\n1,x\n", 1_700_000_200)
    calls = []
    monkeypatch.setattr(cache, "load_file", lambda *a, **k: calls.append(a))
    assert kept.load(p).df.first().b == "x" and not calls  # its content is known
    monkeypatch.undo()
    assert kept.load(p, delimiter=";").df.columns == ["a,b"] and first.metadata["cache_entry"] != kept.load(p, delimiter=";").metadata["cache_entry"]


def test_results(spark, tmp_path, kept):
    p = write(tmp_path / "a.csv", "a,b\n1,x\n5,x\n")
    made = []

    def sums():
        made.append(1)
        return kept.load(p).df.groupBy("b").agg(F.sum("a").alias("s"))

    for _ in range(2):
        assert kept.result("sums", [kept.load(p)], sums, by="b").first().s == 6
    assert len(made) == 1
    kept.result("sums", [kept.load(p)], sums, by="a")
    write(tmp_path / "a.csv", "a,b\n7,x\n", 1_700_000_300)
    assert kept.result("sums", [kept.load(p)], sums, by="b").first().s == 7 and len(made) == 3
    assert {r.kind for r in kept.entries().collect()} == {"load", "result"} and kept.entries().where("bytes > 0").count() == kept.entries().count()
    kept.clear()
    assert kept.entries().count() == 0


def test_nothing_half_written_is_found(spark, tmp_path, kept):
    def fails():
        return spark.range(5).select(F.raise_error(F.lit("stop")).alias("x"))

    with pytest.raises(Exception, match="stop"):
        kept.result("broken", [], fails)
    assert kept.entries().count() == 0
    assert kept.result("broken", [], lambda: spark.range(2)).count() == 2
    missing = kept.load(str(tmp_path / "absent.csv"))
    assert not missing.success and not kept.load(write(tmp_path / "bad.csv", 'a\n"open\n')).success and kept.entries().count() == 1


def test_digest_tells_content_only(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", "x\n1\n2\n"), write(tmp_path / "b.csv", "x\n1\n2\n", 1)
    c = write(tmp_path / "c.csv", "x\n1\n3\n")
    assert cache.content_digest(spark, a) == cache.content_digest(spark, b) != cache.content_digest(spark, c)
    assert loader.load_file(spark, a).success
