"""Cohorts by first period: retention, revenue, lifetime value, churn, reactivation, trends. Matrices are in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import need, num, pct, period_start, periods_between, ratio, total, whole_days, with_total


def _activity(df: DataFrame, customer: str, date: str, period: str, value: str | None, segment: str | None) -> DataFrame:
    """A row for each customer and period of activity, with the customer's first period: n rows, their value."""
    need(df, customer, date, value, segment)
    keys = [customer, *([segment] if segment else [])]
    rows = df.select(*keys, period_start(date, period).alias("p"), (num(value) if value else F.lit(None).cast("double")).alias("v")).dropna(subset=[*keys, "p"])
    active = rows.groupBy(*keys, "p").agg(F.sum("v").alias("v"))
    first = F.min("p").over(Window.partitionBy(*keys))
    return active.withColumn("cohort", first).withColumn("period_index", periods_between(F.col("cohort"), F.col("p"), period))


def cohort_retention(df: DataFrame, customer: str, date: str, period: str = "M", value: str | None = None, segment: str | None = None) -> DataFrame:
    """(segment,) cohort, period_index, customers, cohort_size, retention_pct (, revenue): every cohort at every index that
    any cohort (of the segment) has, 0 where nobody came. With a segment a customer's cohort is that within it."""
    a = _activity(df, customer, date, period, value, segment)
    by = [segment] if segment else []
    got = a.groupBy(*by, "cohort", "period_index").agg(F.count("*").alias("customers"), total("v").alias("revenue"))
    size = got.where("period_index = 0").select(*by, "cohort", F.col("customers").alias("cohort_size"))
    index = got.select(*by, "period_index").distinct()
    grid = size.join(index, by) if by else size.crossJoin(F.broadcast(index))  # cohorts times indices: periods only
    full = grid.join(got, [*by, "cohort", "period_index"], "left").fillna({"customers": 0, "revenue": 0.0})
    full = full.withColumn("retention_pct", pct(F.col("customers"), F.col("cohort_size")))
    return full.select(*by, "cohort", "period_index", "customers", "cohort_size", "retention_pct", *(["revenue"] if value else []))


def retention_by_index(matrix: DataFrame) -> DataFrame:
    """Mean retention of the cohorts at each index."""
    return matrix.groupBy("period_index").agg(F.round(F.avg("retention_pct"), 2).alias("avg_retention"), F.count("*").alias("cohorts"))


def retention_matrix(matrix: DataFrame, max_index: int | None = None) -> DataFrame:
    """Wide form for display: a column Period_i for each index there is (to ``max_index``, if given), percentages with one digit.
    The indices, periods at most, are asked for first."""
    found = sorted(r.period_index for r in matrix.select("period_index").distinct().collect())
    kept = [i for i in found if max_index is None or i <= max_index]
    return matrix.groupBy("cohort").pivot("period_index", kept).agg(F.round(F.first("retention_pct"), 1)).withColumnsRenamed({str(i): f"Period_{i}" for i in kept})


def cohort_metadata(matrix: DataFrame) -> DataFrame:
    """One row: total_cohorts, total_customers, avg_cohort_size, first_index, last_index."""
    sizes = matrix.where("period_index = 0").agg(F.count("*").alias("total_cohorts"), F.sum("cohort_size").alias("total_customers"), F.avg("cohort_size").alias("avg_cohort_size"))
    return sizes.crossJoin(matrix.agg(F.min("period_index").alias("first_index"), F.max("period_index").alias("last_index")))


def cohort_ltv(df: DataFrame, customer: str, date: str, value: str, period: str = "M", periods: int = 12) -> DataFrame:
    """cohort, period_index, revenue_per_customer and its running sum ltv, for the first ``periods`` indices."""
    m = cohort_retention(df, customer, date, period, value).where(F.col("period_index") < periods)
    per = ratio(F.col("revenue"), F.col("cohort_size"))
    w = Window.partitionBy("cohort").orderBy("period_index").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("cohort", "period_index", per.alias("revenue_per_customer"), F.sum(per).over(w).alias("ltv"))


def high_retention_cohorts(matrix: DataFrame, index: int = 3, threshold: float = 50) -> DataFrame:
    return matrix.where((F.col("period_index") == index) & (F.col("retention_pct") >= threshold)).select("cohort", "retention_pct")


def cohort_churn(matrix: DataFrame) -> DataFrame:
    return matrix.select("cohort", "period_index", (100 - F.col("retention_pct")).alias("churn_pct"))


def reactivation(df: DataFrame, customer: str, date: str, inactive_days: int = 90, period: str = "M") -> DataFrame:
    """cohort, period_index, reactivated (rows that follow a gap of more than ``inactive_days``), and rate_pct: 100 where
    there are any, else 0."""
    need(df, customer, date)
    rows = df.select(customer, F.col(date).cast("timestamp").alias("d")).dropna()
    mine = Window.partitionBy(customer)
    gap = whole_days(F.col("d"), F.lag("d").over(mine.orderBy("d")))
    rows = rows.withColumns({"gap": gap, "cohort": period_start(F.min("d").over(mine), period)})
    rows = rows.withColumn("period_index", periods_between(F.col("cohort"), period_start("d", period), period))
    got = rows.groupBy("cohort", "period_index").agg(F.count_if(F.col("gap") > inactive_days).alias("reactivated"))
    return got.withColumn("rate_pct", F.when(F.col("reactivated") > 0, 100.0).otherwise(0.0))


def cohort_trends(matrix: DataFrame, recent: int = 3, early: int = 3) -> DataFrame:
    """Per index the mean retention of the last and of the first cohorts, their difference, and over all the trend."""
    rank = matrix.select("cohort").distinct().select("cohort", F.row_number().over(Window.orderBy("cohort")).alias("i"), F.row_number().over(Window.orderBy(F.desc("cohort"))).alias("j"))
    got = matrix.join(F.broadcast(rank), "cohort").groupBy("period_index").agg(F.avg(F.when(F.col("j") <= recent, F.col("retention_pct"))).alias("recent_avg"), F.avg(F.when(F.col("i") <= early, F.col("retention_pct"))).alias("early_avg"))
    got = got.withColumn("difference", F.col("recent_avg") - F.col("early_avg"))
    got = with_total(got, improving=F.count_if(F.col("difference") > 0), declining=F.count_if(F.col("difference") < 0), mean__=F.avg("difference"))
    return got.withColumn("trend", F.when(F.col("mean__") > 0, "improving").otherwise("declining")).drop("mean__")
