import io
import random
from contextlib import redirect_stdout
from statistics import fmean, stdev

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import order
from ledgerloom.operators import anomaly, campaign, cohort


def rows(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(9)]), rnd.randrange(5), float(rnd.randrange(100)) if rnd.random() < 0.9 else None, i) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "d int, t int, v double, Place int").repartition(6)


def test_places(spark):
    data = rows(500)
    got = order.placed(frame(spark, data), ["d", "t"], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(500))
    keys = [(r.d is not None, r.d or 0, r.t) for r in sorted(got, key=lambda r: r["at"])]
    assert keys == sorted(keys) and sorted(r.Place for r in got) == list(range(500))
    assert order.placed(frame(spark, data).limit(0), ["d"]).count() == 0


@pytest.mark.parametrize("block", [3, 50, 10**6])
def test_trailing_windows_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(order, "BLOCK", max(block, 7))
    data = [(i, 0, v, i) for i, (_, _, v, _) in enumerate(rows(230))]
    got = order.trailing(frame(spark, data), ["d"], 7, m=F.avg("v"), n=F.count("*"))
    assert got.columns == ["d", "t", "v", "Place", "m", "n"]
    for r in got.collect():
        near = [v for _, _, v, _ in data[max(0, r.d - 6) : r.d + 1]]
        there = [v for v in near if v is not None]
        assert r.n == len(near) and r.m == (pytest.approx(fmean(there)) if there else None)


def test_campaign_anomalies_have_no_single_partition(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 20)
    data = [(i, 0, 100.0 if i == 40 else float(i % 3), i) for i in range(90)]
    made = campaign.campaign_anomalies(frame(spark, data), "d", "v")
    out = io.StringIO()
    with redirect_stdout(out):
        made.select("d", "rolling_mean").explain("formatted")
    plan = out.getvalue()
    assert "Window" in plan and plan.count("SinglePartition") <= 1  # that of the ranges
    got = {r.d: r for r in made.collect()}
    assert [d for d, r in got.items() if r.is_anomaly] == [40] and got[40].anomaly_type == "spike"
    near = [data[i][2] for i in range(34, 41)]
    assert got[40].z_score == pytest.approx((100 - fmean(near)) / stdev(near))


def test_sequences_of_all_numbers_in_one_pass(spark):
    """Twelve metrics: all take part, and the table is read once."""
    df = spark.range(100).selectExpr("date_add(date'2024-01-01', cast(id as int)) d", *[f"cast(if(id >= 93, {10 + i}, 1) as double) m{i}" for i in range(12)])
    made = anomaly.sequence_anomalies(df, "d", [f"m{i}" for i in range(12)])
    assert {r.metric: r.recent_avg for r in made.collect()} == {f"m{i}": 10.0 + i for i in range(12)}
    out = io.StringIO()
    with redirect_stdout(out):
        made.explain("formatted")
    assert out.getvalue().count("Range (") <= 4
    types = {r.title for r in anomaly.all_anomalies(df, [f"m{i}" for i in range(12)], [], "d").where("anomaly_type = 'sequence'").collect()}
    assert len(types) == 12


def test_matrix_has_every_index(spark):
    df = spark.createDataFrame([("a", "2020-01-05"), ("a", "2021-06-05"), ("b", "2020-02-01")], "c string, d string").selectExpr("c", "cast(d as timestamp) d")
    wide = cohort.retention_matrix(cohort.cohort_retention(df, "c", "d", "M"))
    assert "Period_17" in wide.columns and cohort.retention_matrix(cohort.cohort_retention(df, "c", "d", "M"), 3).columns == ["cohort", "Period_0"]
