"""Products: performance, prices, trends, baskets, categories, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import competition_rank, need, num, numbered, pct, period_start, ratio, total, with_total
from ledgerloom.functions.store import stored


def product_performance(df: DataFrame, product: str, revenue: str, quantity: str | None = None, top_n: int | None = None, sort_by: str = "revenue") -> DataFrame:
    """Per product: revenue, (quantity,) transactions, averages, shares, competition ranks, and the cumulative revenue
    share in the order of ``sort_by`` (revenue, quantity or transactions), descending; ties by product."""
    need(df, product, revenue, quantity)
    if sort_by not in ("revenue", "transactions", *(["quantity"] if quantity else [])):
        raise ValueError("sort_by is revenue, transactions, or quantity where there is one")
    got = df.where(F.col(product).isNotNull()).groupBy(product).agg(total(revenue).alias("revenue"), *([total(quantity).alias("quantity")] if quantity else []), F.count("*").alias("transactions"))
    unit = "quantity" if quantity else "transactions"
    got = got.withColumn("avg_price", F.round(ratio(F.col("revenue"), F.col(unit)), 2))
    if quantity:
        got = got.withColumn("avg_quantity_per_transaction", F.round(ratio(F.col("quantity"), F.col("transactions")), 2))
    got = got.withColumn("avg_revenue_per_transaction", F.round(ratio(F.col("revenue"), F.col("transactions")), 2))
    got = stored(got)  # a row a product, read by every rank below
    got = with_total(got, r__=F.sum("revenue"), **({"q__": F.sum("quantity")} if quantity else {}))
    got = got.withColumn("revenue_share_pct", pct(F.col("revenue"), F.col("r__")))
    if quantity:
        got = got.withColumn("quantity_share_pct", pct(F.col("quantity"), F.col("q__"))).drop("q__")
    got = competition_rank(got.drop("r__"), "revenue", "revenue_rank")
    if quantity:
        got = competition_rank(got, "quantity", "quantity_rank")
    got = numbered(got, sort_by, [product], number="position", running={"cumulative_revenue_share": "revenue_share_pct"})
    got = got.withColumn("cumulative_revenue_share", F.round("cumulative_revenue_share", 2))
    return got.where(F.col("position") <= top_n) if top_n else got


def top_products(df: DataFrame, product: str, revenue: str, n: int = 10) -> DataFrame:
    return product_performance(df, product, revenue, top_n=n)


def bottom_products(df: DataFrame, product: str, revenue: str, n: int = 10, min_transactions: int = 1) -> DataFrame:
    """The ``n`` products of least revenue among those with enough transactions."""
    return product_performance(df, product, revenue).where(F.col("transactions") >= min_transactions).orderBy("revenue", product).limit(n)


def product_comparison(df: DataFrame, product: str, revenue: str, products: list, quantity: str | None = None) -> DataFrame:
    """Performance of the named products; shares are of these alone."""
    need(df, product)
    return product_performance(df.where(F.col(product).isin(products)), product, revenue, quantity)


def price_analysis(df: DataFrame, product: str, price: str, quantity: str | None = None, revenue: str | None = None) -> DataFrame:
    """Per product: avg_price, min_price, max_price, price_std, price_count, price_range, price_cv, high_price_variation
    (over 0.2), and totals of quantity and revenue where given."""
    need(df, product, price, quantity, revenue)
    p = num(price)
    extra = [total(c).alias(n) for c, n in ((quantity, "total_quantity"), (revenue, "total_revenue")) if c]
    got = df.where(F.col(product).isNotNull()).groupBy(product).agg(F.avg(p).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.stddev_samp(p).alias("price_std"), F.count(p).alias("price_count"), *extra)
    cv = F.round(ratio(F.col("price_std"), F.col("avg_price")), 3)
    return got.withColumns({"price_range": F.col("max_price") - F.col("min_price"), "price_cv": cv, "high_price_variation": F.coalesce(cv > 0.2, F.lit(False))})


def product_trends(df: DataFrame, date: str, product: str, revenue: str, period: str = "M", top_n: int = 5) -> DataFrame:
    """(period, product, revenue, growth_pct) of the ``top_n`` products by revenue; revenue is 0 in periods without
    sales that another of them has."""
    need(df, date, product, revenue)
    by_product = df.where(F.col(product).isNotNull()).groupBy(product).agg(total(revenue).alias("revenue"))
    top = stored(by_product.orderBy(F.desc_nulls_last("revenue"), product).limit(top_n).select(product))
    rows = df.join(F.broadcast(top), product, "left_semi").where(F.col(date).isNotNull())
    got = rows.groupBy(period_start(date, period).alias("period"), product).agg(total(revenue).alias("revenue"))
    grid = got.select("period").distinct().crossJoin(F.broadcast(top))
    full = grid.join(got, ["period", product], "left").withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))
    prev = F.lag("revenue").over(Window.partitionBy(product).orderBy("period"))
    return full.withColumn("growth_pct", F.round(ratio(F.col("revenue") - prev, prev) * 100, 2))


def basket_pairs(df: DataFrame, order: str, product: str, min_support: float = 0.01) -> DataFrame:
    """product_1 < product_2, count, support_pct for pairs in at least ``min_support`` of all orders.

    A product in fewer orders than that can't be in such a pair, so it is dropped before the join on the order."""
    need(df, order, product)
    rows = stored(df.select(order, product).dropna().distinct())
    n = F.broadcast(df.agg(F.count_distinct(order).alias("n_orders")))
    least = F.floor(F.col("n_orders") * min_support)
    often = rows.groupBy(product).agg(F.count("*").alias("k")).crossJoin(n).where(F.col("k") >= least).select(product)
    kept = rows.join(often, product, "left_semi")
    a, b = kept.select(order, F.col(product).alias("product_1")), kept.select(order, F.col(product).alias("product_2"))
    pairs = a.join(b, order).where("product_1 < product_2").groupBy("product_1", "product_2").agg(F.count("*").alias("count"))
    return pairs.crossJoin(n).where(F.col("count") >= least).select("product_1", "product_2", "count", pct(F.col("count"), F.col("n_orders")).alias("support_pct"))


def category_performance(df: DataFrame, category: str, revenue: str, product: str | None = None, quantity: str | None = None) -> DataFrame:
    need(df, category, revenue, product, quantity)
    aggs = [total(revenue).alias("revenue"), *([total(quantity).alias("quantity")] if quantity else []), F.count("*").alias("transactions")]
    if product:
        aggs.append(F.count_distinct(product).alias("unique_products"))
    got = df.where(F.col(category).isNotNull()).groupBy(category).agg(*aggs)
    got = got.withColumn("avg_transaction_value", F.round(ratio(F.col("revenue"), F.col("transactions")), 2))
    if product:
        got = got.withColumn("avg_revenue_per_product", F.round(ratio(F.col("revenue"), F.col("unique_products")), 2))
    return with_total(got, all__=F.sum("revenue")).withColumn("revenue_share_pct", pct(F.col("revenue"), F.col("all__"))).drop("all__")


def performance_score(df: DataFrame, product: str, revenue: str, rating: str | None = None, return_rate: str | None = None) -> DataFrame:
    """Per product: revenue_score (share against the largest), rating_score (of 5), return_score (100 - rate), and
    performance_score with weights 0.5, 0.3, 0.2 over the scores there are."""
    need(df, product, revenue, rating, return_rate)
    aggs = [total(revenue).alias("revenue")]
    if rating:
        aggs.append(F.avg(num(rating)).alias("avg_rating"))
    if return_rate:
        aggs.append(F.avg(num(return_rate)).alias("avg_return_rate"))
    got = df.where(F.col(product).isNotNull()).groupBy(product).agg(*aggs)
    got = with_total(got, all__=F.sum("revenue")).withColumn("revenue_share_pct", pct(F.col("revenue"), F.col("all__"))).drop("all__")
    got = with_total(got, top__=F.max("revenue_share_pct")).withColumn("revenue_score", pct(F.col("revenue_share_pct"), F.col("top__"), 1)).drop("top__")
    weights: list[tuple[str, float, Column]] = [("revenue_score", 0.5, F.col("revenue_score"))]
    if rating:
        weights.append(("rating_score", 0.3, F.round(F.col("avg_rating") / 5 * 100, 1)))
    if return_rate:
        weights.append(("return_score", 0.2, F.round(100 - F.col("avg_return_rate"), 1)))
    got = got.withColumns({n: c for n, _, c in weights})
    score = sum((F.coalesce(F.col(n), F.lit(0.0)) * w for n, w, _ in weights), F.lit(0.0))
    return got.withColumn("performance_score", F.round(score / sum(w for _, w, _ in weights), 1))
