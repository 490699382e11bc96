import random

import pytest

from ledgerloom.operators import association, profile, scan


def table(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([1.0, 2.0, 2.5]), 300 * rnd.gauss(0, 1) ** 3 if i % 2 else float(i % 50), None if i % 9 == 0 else rnd.random() * 10, rnd.choice("ab")) for i in range(900)]
    return spark.createDataFrame(rows + rows[:200], "a double, b double, c double, kind string")


def test_shapes_are_those_of_the_rows(spark):
    """Figures from the different values and their rows: those that numeric_summary takes from the rows."""
    df = table(spark)
    got = {r.column: r for r in scan.shapes(scan.number_kinds(df, ["a", "b", "c"]), 3.0).collect()}
    want = {r.column: r for r in profile.numeric_summary(df, ["a", "b", "c"], outliers_beyond=3.0).collect()}
    assert got.keys() == want.keys() and want["b"].outlier_count > 0
    for c, w in want.items():
        assert (got[c]["count"], got[c].iqr, got[c].outlier_count) == (w["count"], w.iqr, w.outlier_count)
        assert got[c].skewness == pytest.approx(w.skewness, abs=2e-4)
    one = spark.createDataFrame([(3.0,)] * 30, "a double")
    assert [(r["count"], r.skewness, r.iqr, r.outlier_count) for r in scan.shapes(scan.number_kinds(one, ["a"]), 3.0).collect()] == [(30, None, 0.0, 0)]


def test_scan_counts_values_once(spark, monkeypatch):
    """Missing values, quality, shapes, top values and ranks come from two stored tables; the findings are those of the parts."""
    df = table(spark)
    made = []
    for where, name in ((scan, "number_kinds"), (scan, "_kinds"), (profile, "_kinds")):
        plain = getattr(where, name)
        monkeypatch.setattr(where, name, lambda *a, plain=plain, name=name: (made.append(name), plain(*a))[1])
    scan.full_scan(df, numeric=["a", "b", "c"], categorical=["kind"]).collect()
    assert sorted(made) == ["_kinds", "number_kinds"]
    ranks = lambda **more: {(r.var1, r.var2): r.correlation for r in association.correlation_pairs(df, ["a", "b", "c"], "spearman", **more).collect()}
    assert ranks(kinds=scan.number_kinds(df, ["a", "b", "c"])) == ranks()
