import io
import math
import random
import struct
from contextlib import redirect_stdout

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.quantiles import exact_quantiles, ordered_bits, quantiles_of
from ledgerloom.operators import association, campaign, funnel, profile

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0)


def test_ordered_bits_are_the_bits(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, 2.0**-1022, 2.2e-308, 1.7976931348623157e308, 0.1, 19.99]
    for e in range(-1074, 1024):
        p = math.ldexp(1.0, e)
        values += [p, math.nextafter(p, math.inf), math.nextafter(p, 0.0)]
    values += [struct.unpack("<d", struct.pack("<q", rnd.getrandbits(63)))[0] for _ in range(5000)]
    values = [v for v in values if not math.isnan(v)]
    values += [-v for v in values]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("b")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-bits if r.v < 0 else bits), r.v


def groups():
    rnd = random.Random(2)
    yield "one", [7.25]
    yield "two", [3.0, 1.0]
    yield "same", [19.99] * 500
    yield "ties", [float(rnd.randrange(5)) for _ in range(999)]
    yield "prices", [round(rnd.uniform(1, 90000), 2) for _ in range(3000)]
    yield "both", [rnd.gauss(0, 1) for _ in range(2001)]
    yield "wide", [math.exp(rnd.uniform(-300, 300)) * rnd.choice([-1, 1]) for _ in range(1500)]
    yield "close", [1.0 + i * 2.0**-52 for i in range(64)]
    yield "tiny", [i * 5e-324 for i in range(100)]


def test_same_as_duckdb(spark):
    rows = [(g, v) for g, vs in groups() for v in vs] + [("two", None), ("none", None)]
    random.Random(3).shuffle(rows)
    frame = pd.DataFrame(rows, columns=["g", "v"])  # noqa: F841  DuckDB reads it
    want = {g: q for g, q in duckdb.sql(f"SELECT g, quantile_cont(v, {list(PROBS)}) FROM frame WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY g").fetchall()}
    got = {r.g: r.q for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", PROBS).collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-320), g


def test_no_values(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert quantiles_of(none, F.col("v"), (0.5,)).first().q is None
    assert quantiles_of(none.limit(0), F.col("v"), (0.5,)).first().q is None
    assert exact_quantiles(none.selectExpr("1 g", "v"), ["g"], "v", (0.5,)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "q string, k double")
    assert {(r.q, r.m[0]) for r in exact_quantiles(df, ["q"], "k", (0.5,), "m").collect()} == {("a", 1.5), ("b", 5.0)}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_no_buffer_of_distinct_values_is_left(spark):
    """The aggregate that keeps the distinct values of a column in one buffer is in none of these plans."""
    df = spark.createDataFrame([(float(i), i % 3, f"g{i % 2}") for i in range(50)], "v double, w int, g string")
    times = df.selectExpr("timestamp_seconds(v) a", "timestamp_seconds(v + w) b")
    for made in (
        profile.numeric_summary(df), profile.describe(df), profile.distribution(df, "v"), association.group_comparison(df, "g", "v"),
        association.outlier_bounds(df, "v"), campaign.campaign_summary(df, ["v", "w"]), funnel.funnel_velocity(times, ["a", "b"]),
    ):
        assert made.count() and "percentile(" not in plan(made)
