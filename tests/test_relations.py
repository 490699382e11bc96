import io
import math
import random
import re
from contextlib import redirect_stdout
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.dist import f_tail
from ledgerloom.operators import relations


def table(seed=1, n=300):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        g = rnd.choice(["a", "b", "c", None])
        code = rnd.choice([1, 2, 3, None])
        x = rnd.gauss({"a": 0, "b": 1, "c": 3}.get(g, 9), 1) if rnd.random() < 0.9 else None
        rows.append((x, (x or 0) * 2 + rnd.random(), code, g, {1: "p", 2: "q"}.get(code, rnd.choice("pq")), f"id{rnd.randrange(200)}", rnd.random() < 0.5, 7, [1]))
    return rows, "x double, y double, code int, g string, h string, many string, flag boolean, same int, list array<int>"


def corr(a, b):
    pairs = [(u, v) for u, v in zip(a, b, strict=True) if u is not None and v is not None]
    mx, my = (sum(p[i] for p in pairs) / len(pairs) for i in (0, 1))
    return sum((u - mx) * (v - my) for u, v in pairs) / math.sqrt(sum((u - mx) ** 2 for u, _ in pairs) * sum((v - my) ** 2 for _, v in pairs))


def cramers(a, b):
    pairs = [(u, v) for u, v in zip(a, b, strict=True) if u is not None and v is not None]
    xs, ys, n = sorted({u for u, _ in pairs}, key=str), sorted({v for _, v in pairs}, key=str), len(pairs)
    if min(len(xs), len(ys)) < 2:
        return 0.0
    chi = 0.0
    for u in xs:
        for v in ys:
            o, e = sum(p == (u, v) for p in pairs), sum(p[0] == u for p in pairs) * sum(p[1] == v for p in pairs) / n
            chi += (abs(o - e) - (min(0.5, abs(o - e)) if len(xs) == len(ys) == 2 else 0)) ** 2 / e
    return math.sqrt(chi / (n * (min(len(xs), len(ys)) - 1)))


def anova(v, g):
    rows = [(a, b) for a, b in zip(v, g, strict=True) if a is not None]
    groups = [[a for a, b in rows if b == k] for k in {b for _, b in rows if b is not None}]
    n, k = sum(map(len, groups)), len(groups)
    if k < 2 or n <= k:
        return None
    mean, all_mean = sum(map(sum, groups)) / n, sum(a for a, _ in rows) / len(rows)
    m = [sum(x) / len(x) for x in groups]
    f = sum(len(x) * (c - mean) ** 2 for x, c in zip(groups, m, strict=True)) / (k - 1) / (sum((a - c) ** 2 for x, c in zip(groups, m, strict=True) for a in x) / (n - k))
    return f, f_tail(f, k - 1, n - k), sum(len(x) * (c - all_mean) ** 2 for x, c in zip(groups, m, strict=True)) / sum((a - all_mean) ** 2 for a, _ in rows)


def test_same_as_brute_force(spark):
    rows, schema = table()
    df = spark.createDataFrame(rows, schema).repartition(4)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    col = dict(zip(names, zip(*rows, strict=True), strict=True))
    want = {("numeric", "x", "y"): corr(col["x"], col["y"])}
    cats = ["code", "g", "h", "many", "flag", "same"]
    for a, b in combinations(cats, 2):
        if (v := cramers(col[a], col[b])) > 0.1:
            want["categorical", a, b] = v
    for v in ("x", "y"):
        for g in ("code", "g", "h", "flag", "same"):
            if (found := anova(col[v], col[g])) and found[1] < 0.05:
                want["mixed", v, g] = found[2]
    got = relations.mixed_correlations(df).collect()
    assert {(r.kind, r.var1, r.var2): r.value for r in got} == pytest.approx(want, rel=1e-9)
    assert {r.strength for r in got if r.kind == "mixed"} <= {"Large", "Medium", "Small", "Very small"}
    for r in got:
        if r.kind == "mixed":
            f, p, _ = anova(col[r.var1], col[r.var2])
            assert (r.f_statistic, r.p_value) == pytest.approx((f, p), rel=1e-6)
    s = relations.mixed_summary(df).first()
    assert (s.total_columns, s.numeric_columns, s.categorical_columns) == (9, 2, 6)
    assert s.categorical_associations_found == sum(k[0] == "categorical" for k in want) and s.numeric_correlations_found == 1
    strong = {(r.var1, r.var2): (r.is_strong, r.type, r.abs_value) for r in relations.find_all_relationships(df, 0.99).collect()}
    assert strong["x", "y"][1] == "positive" and strong["x", "g"][0]
    assert {(r.var1, r.var2) for r in relations.numeric_matrix(relations.mixed_correlations(df)).collect()} == {("x", "x"), ("y", "y"), ("x", "y"), ("y", "x")}


def test_few_values_stop_counting(spark):
    df = spark.range(1000).selectExpr("id", "id % 11 e", "id % 10 t", "cast(null as int) n", "1.5d c").repartition(7)
    assert relations.few_values(df, df.columns, 10) == {"id": 11, "e": 11, "t": 10, "n": 0, "c": 1}
    assert relations.column_kinds(df)[0] == ["id", "e"]


def test_strict_labels(spark):
    df = spark.createDataFrame([(0.5, 0.14), (0.51, 0.15), (0.3, 0.06), (0.31, 0.07), (0.1, 0.01), (0.11, 0.02)], "v double, e double")
    got = df.select(relations.cramers_strength(F.col("v")), relations.eta_strength(F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("Moderate", "Medium"), ("Strong", "Large"), ("Weak", "Small"), ("Moderate", "Medium"), ("Very weak", "Very small"), ("Weak", "Small")]


def test_edges(spark):
    empty = spark.createDataFrame([], "x double, y double, g string")
    assert [(r.kind, r.var1, r.var2) for r in relations.mixed_correlations(empty).collect()] == []
    split = spark.createDataFrame([(float(i > 10) + 0.0 * i, f"k{i > 10}", i * 1.0) for i in range(22)], "x double, g string, z double")
    got = {(r.kind, r.var1, r.var2): r for r in relations.mixed_correlations(split).collect()}
    assert got["categorical", "x", "g"].value > 0.8 and got["mixed", "z", "g"].p_value < 0.001
    with pytest.raises(ValueError):
        relations.mixed_correlations(split, ["absent"])


def test_scans_do_not_grow_with_columns(spark, tmp_path):
    """Two scans in the final plans at most, beside the pass that counts values, with four columns or with twenty."""
    spark.range(200).selectExpr(*[f"cast(hash(id, {i}) % {3 + 90 * (i % 2)} as double) c{i}" for i in range(20)]).write.parquet(str(tmp_path / "t"))
    for n in (4, 20):
        df = spark.read.parquet(str(tmp_path / "t")).select(*[f"c{i}" for i in range(n)])
        made = relations.mixed_correlations(df)
        out = io.StringIO()
        with redirect_stdout(out):
            made.explain("formatted")
        assert len(re.findall(r"Location: .*/t\]", out.getvalue())) == 0  # all from stored cells
        assert made.count() >= 0
