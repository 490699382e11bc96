"""Campaigns: summaries, year over year, seasons, KPIs, rankings, rolling anomalies, half-by-half trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.order import trailing
from ledgerloom.functions.quantiles import exact_quantiles
from ledgerloom.functions.semantics import need, num, numbered, pct, period_start, ratio, settled, total, with_total


def campaign_summary(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Without groups: metric, sum, mean, median, std, min, max. With groups: m_sum, m_mean, m_count of each metric."""
    need(df, *metrics, *(by or []))
    if by:
        aggs = [a for m in metrics for a in (total(m).alias(f"{m}_sum"), F.avg(num(m)).alias(f"{m}_mean"), F.count(num(m)).alias(f"{m}_count"))]
        return df.dropna(subset=by).groupBy(*by).agg(*aggs)
    long = df.select(*[num(m).alias(m) for m in metrics]).unpivot([], metrics, "metric", "v")
    middle = exact_quantiles(long, ["metric"], "v", (0.5,)).select("metric", F.col("q")[0].alias("median"))
    return long.groupBy("metric").agg(total("v").alias("sum"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).join(middle, "metric", "left").select("metric", "sum", "mean", "median", "std", "min", "max")


def _change_pct(new, old):
    return F.coalesce(ratio(new - old, old) * 100, F.lit(0.0))


def year_over_year(df: DataFrame, date: str, metrics: list[str], current_year: int, previous_year: int, period: str = "M") -> DataFrame:
    """period_in_year (month, quarter, week or day number), and of each metric m_current, m_previous, m_change, m_change_pct.
    Periods of either year; what is missing is null, a change that can't be told is 0 per cent."""
    need(df, date, *metrics)
    key = {"D": F.dayofyear, "W": F.weekofyear, "M": F.month, "Q": F.quarter, "Y": lambda c: F.lit(1)}[period]
    year = F.year(date)
    rows = df.where(year.isin(current_year, previous_year)).withColumn("period_in_year", key(F.col(date)).cast("long"))
    one = lambda m, y: F.sum(F.when(F.year(date) == y, num(m)))
    got = rows.groupBy("period_in_year").agg(*[a for m in metrics for a in (one(m, current_year).alias(f"{m}_current"), one(m, previous_year).alias(f"{m}_previous"))])
    return got.withColumns({n: c for m in metrics for n, c in ((f"{m}_change", F.col(f"{m}_current") - F.col(f"{m}_previous")), (f"{m}_change_pct", _change_pct(F.col(f"{m}_current"), F.col(f"{m}_previous"))))})


def wave_comparison(df: DataFrame, date: str, metrics: list[str], wave_1: tuple[str, str], wave_2: tuple[str, str]) -> DataFrame:
    """Per metric: totals and daily averages of two date ranges, absolute and per cent change from the second to the
    first. Both ends count; an end means its midnight. Days are calendar days. Totals are ``settled``, whatever order they are added in."""
    need(df, date, *metrics)
    t = F.col(date).cast("timestamp")

    def inside(w: tuple[str, str]):
        return t.between(F.to_timestamp(F.lit(w[0])), F.to_timestamp(F.lit(w[1])))

    def days(w: tuple[str, str]):
        return F.datediff(F.to_date(F.lit(w[1])), F.to_date(F.lit(w[0]))) + 1

    long = df.where(inside(wave_1) | inside(wave_2)).select(inside(wave_1).alias("a"), inside(wave_2).alias("b"), *[num(m).alias(m) for m in metrics]).unpivot(["a", "b"], metrics, "metric", "v")
    got = long.groupBy("metric").agg(settled(total(F.when(F.col("a"), F.col("v")))).alias("wave_1_total"), settled(total(F.when(F.col("b"), F.col("v")))).alias("wave_2_total"))
    return got.withColumns({
        "wave_1_daily_avg": F.col("wave_1_total") / days(wave_1), "wave_2_daily_avg": F.col("wave_2_total") / days(wave_2),
        "absolute_change": F.col("wave_1_total") - F.col("wave_2_total"), "percent_change": _change_pct(F.col("wave_1_total"), F.col("wave_2_total")),
    })


def campaign_kpis(df: DataFrame, impressions: str | None = None, clicks: str | None = None, conversions: str | None = None, revenue: str | None = None, cost: str | None = None) -> DataFrame:
    """Adds CTR, CVR (per cent), CPC, CPA, ROAS and Revenue_per_Click where their columns are given; x / 0 is 0."""
    need(df, impressions, clicks, conversions, revenue, cost)
    safe = lambda a, b: F.coalesce(ratio(num(a), num(b)), F.lit(0.0))
    kpis = [("CTR", clicks, impressions, 100), ("CVR", conversions, clicks, 100), ("CPC", cost, clicks, 1), ("CPA", cost, conversions, 1), ("ROAS", revenue, cost, 1), ("Revenue_per_Click", revenue, clicks, 1)]
    return df.withColumns({n: safe(a, b) * k for n, a, b, k in kpis if a and b})


def top_campaigns(df: DataFrame, campaign: str, metric: str, top_n: int = 10, min_threshold: float | None = None) -> DataFrame:
    """campaign, total, percentage_of_total (of those that reach the threshold), rank."""
    need(df, campaign, metric)
    got = df.where(F.col(campaign).isNotNull()).groupBy(F.col(campaign).alias("campaign")).agg(total(metric).alias("total"))
    if min_threshold is not None:
        got = got.where(F.col("total") >= min_threshold)
    got = with_total(got, all__=F.sum("total")).withColumn("percentage_of_total", pct(F.col("total"), F.col("all__"))).drop("all__")
    return numbered(got, "total", ["campaign"]).where(F.col("rank") <= top_n)


def performance_by_device(df: DataFrame, device: str, metrics: list[str]) -> DataFrame:
    need(df, device, *metrics)
    got = df.where(F.col(device).isNotNull()).groupBy(device).agg(*[total(m).alias(m) for m in metrics])
    got = with_total(got, **{f"all__{m}": F.sum(m) for m in metrics})
    return got.withColumns({f"{m}_share": pct(F.col(m), F.col(f"all__{m}")) for m in metrics}).drop(*[f"all__{m}" for m in metrics])


def campaign_anomalies(df: DataFrame, date: str, metric: str, std_threshold: float = 2.0, ties: list[str] | None = None) -> DataFrame:
    """Adds rolling_mean and rolling_std of up to seven rows with the row itself, z_score, is_anomaly, anomaly_type.

    Rows are in order of date; several rows of a date need ``ties``. Windows run within blocks of the order, each with the
    last rows of the one before, for any number of rows. With seven rows |z| stays under 6/sqrt(7)."""
    need(df, date, metric, *(ties or []))
    v = num(metric)
    got = trailing(df, [date, *(ties or [])], 7, rolling_mean=F.avg(v), rolling_std=F.stddev_samp(v))
    z = F.coalesce(ratio(v - F.col("rolling_mean"), F.col("rolling_std")), F.lit(0.0))
    odd = F.abs("z_score") > std_threshold
    return got.withColumn("z_score", z).withColumns({"is_anomaly": odd, "anomaly_type": F.when(odd & (F.col("z_score") > 0), "spike").when(odd, "drop").otherwise("normal")})


def half_trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """One row: mean a day of the first and of the second half of days (a middle day counts for neither), change_pct and
    trend: growing over 10 per cent, declining under -10, else stable."""
    need(df, date, metric)
    daily = df.where(F.col(date).isNotNull()).groupBy(period_start(date, "D").alias("day")).agg(total(metric).alias("v"))
    w = Window.orderBy("day")
    daily = with_total(daily.withColumn("i", F.row_number().over(w)), n=F.count("*"))
    half = F.floor(F.col("n") / 2)
    got = daily.agg(F.avg(F.when(F.col("i") <= half, F.col("v"))).alias("first_half"), F.avg(F.when(F.col("i") > F.col("n") - half, F.col("v"))).alias("second_half"))
    change = ratio(F.col("second_half") - F.col("first_half"), F.col("first_half")) * 100
    return got.withColumns({"change_pct": change, "trend": F.when(change > 10, "growing").when(change < -10, "declining").otherwise("stable")})
