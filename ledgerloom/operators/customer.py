"""Customers: summaries, RFM, value tiers, lifetime value, churn risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import need, num, numbered, pct, quantile_bin, ratio, total, whole_days, with_total
from ledgerloom.functions.store import stored


def customer_summary(df: DataFrame, customer: str, revenue: str, date: str | None = None, quantity: str | None = None) -> DataFrame:
    """Per customer: total_revenue, avg_order_value, total_orders, (first_order, last_order, customer_lifetime_days,
    months_active, orders_per_month,) (total_quantity,) revenue_share_pct. No months count as one."""
    need(df, customer, revenue, date, quantity)
    aggs = [total(revenue).alias("total_revenue"), F.avg(num(revenue)).alias("avg_order_value"), F.count(num(revenue)).alias("total_orders")]
    if quantity:
        aggs.append(total(quantity).alias("total_quantity"))
    if date:
        aggs += [F.min(date).alias("first_order"), F.max(date).alias("last_order")]
    got = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(*aggs)
    if date:
        days = whole_days(F.col("last_order"), F.col("first_order"))
        got = got.withColumn("customer_lifetime_days", days).withColumn("months_active", F.round(F.col("customer_lifetime_days") / 30, 1))
        months = F.when(F.col("months_active") == 0, 1.0).otherwise(F.col("months_active"))
        got = got.withColumn("orders_per_month", F.round(ratio(F.col("total_orders"), months), 2))
    return with_total(got, all__=F.sum("total_revenue")).withColumn("revenue_share_pct", pct(F.col("total_revenue"), F.col("all__"))).drop("all__")


#: Fixed values, in order: segment; lowest and highest r, f and m that it takes (None: any). The first that fits counts.
RFM_RULES = (
    ("Champions", (4, None), (4, None), (4, None)),
    ("Loyal Customers", (None, None), (4, None), (4, None)),
    ("Potential Loyalists", (4, None), (2, None), (None, None)),
    ("New Customers", (4, None), (None, 2), (None, None)),
    ("At Risk", (None, 2), (3, None), (3, None)),
    ("Can't Lose", (None, 2), (4, None), (4, None)),
    ("Hibernating", (None, 2), (None, 2), (None, None)),
    ("Need Attention", (3, None), (3, None), (None, None)),
    ("About to Sleep", (None, 3), (None, 3), (None, None)),
)


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """The segment of the first rule that fits; Other if none does."""
    made = F.lit("Other")
    for name, *bounds in reversed(RFM_RULES):
        fits = F.lit(True)
        for score, (low, high) in zip((r, f, m), bounds, strict=True):
            fits = fits & (score >= low if low is not None else F.lit(True)) & (score <= high if high is not None else F.lit(True))
        made = F.when(fits, name).otherwise(made)
    return made


def rfm_analysis(df: DataFrame, customer: str, date: str, revenue: str, reference_date: str | None = None, bins: int = 5) -> DataFrame:
    """Per customer: recency (whole days before the reference date, by default a day after the last), frequency, monetary,
    r_score, f_score, m_score, rfm_score, rfm_sum, segment.

    f and m are quantile buckets of the position in order, ties by customer; r is the bucket of recency among exact
    quantiles, the most recent highest. Rows with a null key, date or revenue are left out."""
    need(df, customer, date, revenue)
    rows = df.select(customer, F.col(date).cast("timestamp").alias("d"), num(revenue).alias("v")).dropna()
    got = rows.groupBy(customer).agg(F.max("d").alias("last"), F.count("*").alias("frequency"), F.sum("v").alias("monetary"))
    reference = F.to_timestamp(F.lit(reference_date)) if reference_date else F.max("last") + F.expr("interval 1 day")
    got = with_total(stored(got), ref=reference, n=F.count("*")).withColumn("recency", whole_days(F.col("ref"), F.col("last")))
    cuts = F.percentile("recency", F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    got = with_total(got, cuts=cuts)
    below = sum((F.when(F.col("recency") > F.col("cuts")[i], 1).otherwise(0) for i in range(bins - 1)), F.lit(0))
    got = got.withColumn("r_score", (bins - below).cast("int"))
    for value, name in (("frequency", "f_score"), ("monetary", "m_score")):
        got = numbered(got, value, [customer], ascending=True, number="i").withColumn(name, quantile_bin(F.col("i"), F.col("n"), bins)).drop("i")
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return got.select(customer, "recency", "frequency", "monetary", "r_score", "f_score", "m_score", (r * 100 + f * 10 + m).alias("rfm_score"), (r + f + m).alias("rfm_sum"), rfm_segment(r, f, m).alias("segment"))


def rfm_segment_counts(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment").agg(F.count("*").alias("customers"))


TIER_NAMES = {3: ["Low", "Medium", "High"], 4: ["Bronze", "Silver", "Gold", "Platinum"]}


def value_tiers(df: DataFrame, customer: str, revenue: str, tiers: int = 4, names: list[str] | None = None) -> DataFrame:
    """customer, total_revenue, tier, tier_order: equal quantile buckets of total revenue, ties by customer."""
    need(df, customer, revenue)
    names = names or TIER_NAMES.get(tiers) or [f"Tier {i}" for i in range(1, tiers + 1)]
    got = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(total(revenue).alias("total_revenue"))
    got = numbered(with_total(stored(got), n=F.count("*")), "total_revenue", [customer], ascending=True, number="i")
    got = got.withColumn("tier_order", quantile_bin(F.col("i"), F.col("n"), tiers))
    return got.select(customer, "total_revenue", F.element_at(F.array(*map(F.lit, names)), F.col("tier_order")).alias("tier"), "tier_order")


def tier_summary(tiers: DataFrame, customer: str) -> DataFrame:
    t = F.col("total_revenue")
    got = tiers.groupBy("tier", "tier_order").agg(F.count(customer).alias("customer_count"), F.sum(t).alias("total_revenue"), F.avg(t).alias("avg_revenue"), F.min(t).alias("min_revenue"), F.max(t).alias("max_revenue"))
    got = with_total(got, c__=F.sum("customer_count"), r__=F.sum("total_revenue"))
    return got.withColumns({"customer_share_pct": pct(F.col("customer_count"), F.col("c__")), "revenue_share_pct": pct(F.col("total_revenue"), F.col("r__"))}).drop("c__", "r__")


def lifetime_value(df: DataFrame, customer: str, date: str, revenue: str, horizon_months: int = 12) -> DataFrame:
    """Per customer: avg_order_value x orders a month of tenure (at least one month) x horizon, beside what was spent."""
    need(df, customer, date, revenue)
    rows = df.select(customer, F.col(date).cast("timestamp").alias("d"), num(revenue).alias("v")).dropna()
    got = rows.groupBy(customer).agg(F.sum("v").alias("total_revenue"), F.avg("v").alias("avg_order_value"), F.count("*").alias("order_count"), F.min("d").alias("first_order"), F.max("d").alias("last_order"))
    got = got.withColumn("tenure_days", whole_days(F.col("last_order"), F.col("first_order"))).withColumn("tenure_months", F.greatest(F.col("tenure_days") / 30, F.lit(1.0)))
    got = got.withColumn("purchase_frequency", F.col("order_count") / F.col("tenure_months"))
    return got.withColumns({"projected_clv": F.round(F.col("avg_order_value") * F.col("purchase_frequency") * horizon_months, 2), "historical_clv": F.col("total_revenue")})


def churn_risk(df: DataFrame, customer: str, date: str, revenue: str, threshold_days: int = 90) -> DataFrame:
    """Per customer: last_purchase, order_count, total_revenue, days_since_purchase (before the last purchase of all) and
    churn_risk: Active to 30 days, Cooling to 60, At Risk to the threshold, else Churned."""
    need(df, customer, date, revenue)
    rows = df.select(customer, F.col(date).cast("timestamp").alias("d"), num(revenue).alias("v")).dropna()
    got = rows.groupBy(customer).agg(F.max("d").alias("last_purchase"), F.count("*").alias("order_count"), F.sum("v").alias("total_revenue"))
    got = with_total(got, ref=F.max("last_purchase")).withColumn("days_since_purchase", whole_days(F.col("ref"), F.col("last_purchase"))).drop("ref")
    d = F.col("days_since_purchase")
    return got.withColumn("churn_risk", F.when(d <= 30, "Active").when(d <= 60, "Cooling").when(d <= threshold_days, "At Risk").otherwise("Churned"))


def churn_summary(risk: DataFrame) -> DataFrame:
    k = lambda name: F.count_if(F.col("churn_risk") == name)
    lost = F.when(F.col("churn_risk").isin("At Risk", "Churned"), F.col("total_revenue"))
    return risk.agg(F.count("*").alias("total_customers"), k("Active").alias("active"), k("Cooling").alias("cooling"), k("At Risk").alias("at_risk"), k("Churned").alias("churned"), F.coalesce(F.sum(lost), F.lit(0.0)).alias("revenue_at_risk"))
