"""Revenue: totals, periods with growth, dimensions, year over year, concentration, forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import need, num, numbered, pct, period_start, ratio, total, with_total


def revenue_metrics(df: DataFrame, revenue: str, quantity: str | None = None, order_id: str | None = None, date: str | None = None) -> DataFrame:
    """One row: total_revenue, avg_order_value, total_orders, total_quantity, revenue_per_unit, period_start, period_end.

    Orders are distinct ids, else rows; without a quantity column an order counts as a unit."""
    need(df, revenue, quantity, order_id, date)
    when = F.col(date).cast("date") if date else F.lit(None).cast("date")
    got = df.agg(
        total(revenue).alias("total_revenue"), (F.count_distinct(order_id) if order_id else F.count("*")).alias("total_orders"),
        (total(quantity) if quantity else F.lit(None)).cast("double").alias("q"), F.min(when).alias("period_start"), F.max(when).alias("period_end"),
    )
    aov = F.coalesce(ratio(F.col("total_revenue"), F.col("total_orders")), F.lit(0.0))
    units = F.coalesce("q", F.col("total_orders").cast("double"))
    return got.select("total_revenue", aov.alias("avg_order_value"), "total_orders", units.alias("total_quantity"), F.coalesce(ratio(F.col("total_revenue"), units), F.lit(0.0)).alias("revenue_per_unit"), "period_start", "period_end")


def revenue_by_period(df: DataFrame, date: str, revenue: str, period: str = "M", include_growth: bool = True) -> DataFrame:
    """Per period: revenue, avg_transaction, transactions; with growth also prev_revenue, growth, growth_pct,
    cumulative_revenue and ma_3 (mean of up to three periods). Rows with null date or revenue are left out; a period
    without rows has none."""
    need(df, date, revenue)
    rows = df.select(period_start(date, period).alias("period"), num(revenue).alias("v")).dropna()
    got = rows.groupBy("period").agg(F.sum("v").alias("revenue"), F.avg("v").alias("avg_transaction"), F.count("*").alias("transactions"))
    if not include_growth:
        return got
    w = Window.orderBy("period")  # over periods, not rows
    prev = F.lag("revenue").over(w)
    return got.withColumns({
        "prev_revenue": prev, "growth": F.col("revenue") - prev, "growth_pct": pct(F.col("revenue") - prev, prev),
        "cumulative_revenue": F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0)), "ma_3": F.round(F.avg("revenue").over(w.rowsBetween(-2, 0)), 2),
    })


def revenue_by_dimension(df: DataFrame, dimension: str, revenue: str, quantity: str | None = None, top_n: int | None = None) -> DataFrame:
    """Per value: revenue, (quantity,) transactions, avg_transaction, share_pct, cumulative_share_pct (of the rounded
    shares) and rank by revenue; ties by the value. Null values are left out."""
    need(df, dimension, revenue, quantity)
    got = df.where(F.col(dimension).isNotNull()).groupBy(dimension).agg(total(revenue).alias("revenue"), *([total(quantity).alias("quantity")] if quantity else []), F.count("*").alias("transactions"))
    got = got.withColumn("avg_transaction", F.round(ratio(F.col("revenue"), F.col("transactions")), 2))
    got = with_total(got, all__=F.sum("revenue")).withColumn("share_pct", pct(F.col("revenue"), F.col("all__"))).drop("all__")
    got = numbered(got, "revenue", [dimension], running={"cumulative_share_pct": "share_pct"}).withColumn("cumulative_share_pct", F.round("cumulative_share_pct", 2))
    return got.where(F.col("rank") <= top_n) if top_n else got


def compare_periods_yoy(df: DataFrame, date: str, revenue: str, current_year: int | None = None, previous_year: int | None = None) -> DataFrame:
    """Per month of the year: current and previous revenue (0 where there is none), change, change_pct, month_name.
    Without years: the last one and the one before."""
    need(df, date, revenue)
    rows = df.select(F.year(date).alias("y"), F.month(date).alias("month"), num(revenue).alias("v")).dropna()
    last = F.broadcast(rows.agg(F.max("y").alias("last")))
    rows = rows.crossJoin(last)
    cur = F.lit(current_year) if current_year is not None else F.col("last")
    prev = F.lit(previous_year) if previous_year is not None else cur - 1
    rows = rows.where((F.col("y") == cur) | (F.col("y") == prev))
    got = rows.groupBy(F.col("month").cast("long").alias("month")).agg(total(F.when(F.col("y") == cur, F.col("v"))).alias("current_revenue"), total(F.when(F.col("y") == prev, F.col("v"))).alias("previous_revenue"))
    change = F.col("current_revenue") - F.col("previous_revenue")
    name = F.date_format(F.make_date(F.lit(2000), F.col("month").cast("int"), F.lit(1)), "MMMM")
    return got.withColumns({"change": change, "change_pct": pct(change, F.col("previous_revenue")), "month_name": name})


def growth_metrics(df: DataFrame, date: str, revenue: str, period: str = "M") -> DataFrame:
    """One row: latest_period, latest_revenue, previous_revenue, period_growth, avg_growth_rate, cagr, total_periods, trend
    (mean growth of the last three periods against that of the first three; unknown under three), total_revenue, avg_period_revenue.
    No row with fewer than two periods."""
    p = revenue_by_period(df, date, revenue, period)
    w = Window.orderBy("period")
    p = p.withColumns({"i": F.row_number().over(w), "j": F.row_number().over(Window.orderBy(F.desc("period")))})
    at = lambda c, k: F.max(F.when(F.col("j") == k, F.col(c)))
    first = F.max(F.when(F.col("i") == 1, F.col("revenue")))
    got = p.agg(
        at("period", 1).alias("latest_period"), at("revenue", 1).alias("latest_revenue"), at("revenue", 2).alias("previous_revenue"), at("growth_pct", 1).alias("period_growth"),
        F.avg("growth_pct").alias("avg_growth_rate"), first.alias("f"), F.count("*").alias("total_periods"),
        F.avg(F.when(F.col("j") <= 3, F.col("growth_pct"))).alias("late"), F.avg(F.when(F.col("i") <= 3, F.col("growth_pct"))).alias("early"),
        F.sum("revenue").alias("total_revenue"), F.avg("revenue").alias("avg_period_revenue"),
    ).where("total_periods > 1")
    cagr = F.when(F.col("f") > 0, (F.pow(F.greatest(ratio(F.col("latest_revenue"), F.col("f")), F.lit(0.0)), F.lit(1.0) / (F.col("total_periods") - 1)) - 1) * 100)
    trend = F.when(F.col("total_periods") < 3, "unknown").when(F.col("late") > F.col("early"), "accelerating").otherwise("decelerating")
    r = lambda c: F.round(c, 2).alias(c)
    return got.select("latest_period", r("latest_revenue"), r("previous_revenue"), r("period_growth"), r("avg_growth_rate"), F.round(cagr, 2).alias("cagr"), "total_periods", trend.alias("trend"), r("total_revenue"), r("avg_period_revenue"))


def _vital_few(threshold: float) -> Column:
    return (F.col("cumulative_share_pct") <= threshold) | (F.col("rank") == 1)


def vital_few_items(df: DataFrame, dimension: str, revenue: str, threshold: float = 80) -> DataFrame:
    """A row for each of the vital few of ``pareto_analysis``: rank, item, revenue, share_pct, cumulative_share_pct."""
    few = revenue_by_dimension(df, dimension, revenue).where(_vital_few(threshold))
    return few.select("rank", F.col(dimension).cast("string").alias("item"), "revenue", "share_pct", "cumulative_share_pct")


def pareto_analysis(df: DataFrame, dimension: str, revenue: str, threshold: float = 80) -> DataFrame:
    """One row on the vital few: the items in order of revenue while their cumulative share is within ``threshold``,
    at least one. ``vital_few_items`` lists them."""
    d = revenue_by_dimension(df, dimension, revenue)
    few = _vital_few(threshold)
    got = d.agg(
        F.count("*").alias("total_items"), F.sum("revenue").alias("total_revenue"), F.count_if(few).alias("vital_few_count"),
        F.sum(F.when(few, F.col("revenue"))).alias("vital_few_revenue"),
    ).where("total_items > 0")
    share, of = pct(F.col("vital_few_count"), F.col("total_items"), 10), pct(F.col("vital_few_revenue"), F.col("total_revenue"), 10)
    return got.select(
        "total_items", F.round("total_revenue", 2).alias("total_revenue"), "vital_few_count", F.round(share, 2).alias("vital_few_pct"),
        F.round("vital_few_revenue", 2).alias("vital_few_revenue"), F.round(of, 2).alias("vital_few_revenue_pct"),
        F.round(ratio(of, share), 2).alias("concentration_ratio"), ((share < 30) & (of > 70)).alias("is_concentrated"),
    )


def revenue_forecast(df: DataFrame, date: str, revenue: str, periods_ahead: int = 3, method: str = "moving_average") -> DataFrame:
    """Monthly history and ``periods_ahead`` further months with is_forecast: the mean of the last three months, or the
    last month plus the slope of a line through all, or the mean of all. Under three months: history alone."""
    if method not in ("moving_average", "linear_trend", "average"):
        raise ValueError("method is moving_average, linear_trend or average")
    hist = revenue_by_period(df, date, revenue, "M", include_growth=False)
    p = hist.withColumns({"i": F.row_number().over(Window.orderBy("period")), "j": F.row_number().over(Window.orderBy(F.desc("period")))})
    got = p.agg(
        F.max("period").alias("end"), F.count("*").alias("n"), F.avg(F.when(F.col("j") <= 3, F.col("revenue"))).alias("ma"), F.avg("revenue").alias("mean"),
        F.max(F.when(F.col("j") == 1, F.col("revenue"))).alias("last"), F.regr_slope("revenue", F.col("i").cast("double")).alias("slope"),
    ).where("n >= 3")
    ahead = got.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(periods_ahead))))
    value = {"moving_average": F.col("ma"), "linear_trend": F.col("last") + F.col("slope") * F.col("k"), "average": F.col("mean")}[method]
    made = ahead.select(F.add_months("end", F.col("k")).alias("period"), value.alias("revenue"), F.lit(None).cast("double").alias("avg_transaction"), F.lit(None).cast("long").alias("transactions"), F.lit(True).alias("is_forecast"))
    return hist.withColumn("is_forecast", F.lit(False)).unionByName(made)
