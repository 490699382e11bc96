"""Queries on revenue, products and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import customer as cu
from ledgerloom.operators import product as pr
from ledgerloom.operators import revenue as rv
from ledgerloom.plans.registry import query, rounded, table

_O, _L = "orders", "lineitem"


@query("revenue_metrics", """
SELECT round(sum(o_totalprice), 2) AS total_revenue, round(sum(o_totalprice) / count(DISTINCT o_orderkey), 2) AS avg_order_value,
  count(DISTINCT o_orderkey) AS total_orders, CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS total_quantity,
  round(sum(o_totalprice) / count(DISTINCT o_orderkey), 2) AS revenue_per_unit, min(o_orderdate)::DATE AS period_start, max(o_orderdate)::DATE AS period_end
FROM orders""", ("period_start", "period_end"))
def _(s, d):
    return rounded(rv.revenue_metrics(table(s, d, _O), "o_totalprice", order_id="o_orderkey", date="o_orderdate"))


@query("revenue_metrics_quantity", """
SELECT round(sum(l_extendedprice), 2) AS total_revenue, round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 2) AS avg_order_value,
  count(DISTINCT l_orderkey) AS total_orders, round(sum(l_quantity), 2) AS total_quantity,
  round(sum(l_extendedprice) / sum(l_quantity), 2) AS revenue_per_unit, min(l_shipdate)::DATE AS period_start, max(l_shipdate)::DATE AS period_end
FROM lineitem""", ("period_start", "period_end"))
def _(s, d):
    return rounded(rv.revenue_metrics(table(s, d, _L), "l_extendedprice", "l_quantity", "l_orderkey", "l_shipdate"))


_UNITS = {"d": "day", "w": "week", "m": "month", "q": "quarter", "y": "year"}


def _by_period(unit: str) -> str:
    return f"""
WITH p AS (SELECT date_trunc('{unit}', o_orderdate)::DATE AS period, sum(o_totalprice) AS r, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT *, lag(r) OVER (ORDER BY period) AS pr FROM p)
SELECT period, round(r, 2) AS revenue, round(a, 2) AS avg_transaction, n AS transactions, round(pr, 2) AS prev_revenue, round(r - pr, 2) AS growth,
  round((r - pr) / nullif(pr, 0) * 100, 2) AS growth_pct, round(sum(r) OVER (ORDER BY period), 2) AS cumulative_revenue,
  round(avg(r) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma_3 FROM w"""


for _p, _u in _UNITS.items():
    query(f"revenue_by_period_{_p}", _by_period(_u), ("period",))(lambda s, d, p=_p.upper(): rounded(rv.revenue_by_period(table(s, d, _O), "o_orderdate", "o_totalprice", p)))


@query("revenue_by_dimension", """
WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS r, count(*) AS n FROM orders GROUP BY 1),
h AS (SELECT *, round(r / sum(r) OVER () * 100, 2) AS s, row_number() OVER (ORDER BY r DESC, o_orderpriority) AS k FROM g)
SELECT o_orderpriority, round(r, 2) AS revenue, n AS transactions, round(r / n, 2) AS avg_transaction, s AS share_pct,
  round(sum(s) OVER (ORDER BY k), 2) AS cumulative_share_pct, k AS rank FROM h""")
def _(s, d):
    return rounded(rv.revenue_by_dimension(table(s, d, _O), "o_orderpriority", "o_totalprice"))


@query("yoy_by_month", """
WITH m AS (SELECT max(year(o_orderdate)) AS y FROM orders),
g AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS month, coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = y), 0) AS c,
  coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = y - 1), 0) AS p FROM orders, m WHERE year(o_orderdate) IN (y, y - 1) GROUP BY 1)
SELECT month, round(c, 2) AS current_revenue, round(p, 2) AS previous_revenue, round(c - p, 2) AS change,
  round((c - p) / nullif(p, 0) * 100, 2) AS change_pct, monthname(make_date(2000, month::INT, 1)) AS month_name FROM g""")
def _(s, d):
    return rounded(rv.compare_periods_yoy(table(s, d, _O), "o_orderdate", "o_totalprice"))


@query("growth_metrics", """
WITH p AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS r FROM orders GROUP BY 1),
w AS (SELECT *, round((r - lag(r) OVER (ORDER BY period)) / lag(r) OVER (ORDER BY period) * 100, 2) AS g,
  row_number() OVER (ORDER BY period) AS i, row_number() OVER (ORDER BY period DESC) AS j FROM p)
SELECT max(period) AS latest_period, round(max(r) FILTER (j = 1), 2) AS latest_revenue, round(max(r) FILTER (j = 2), 2) AS previous_revenue,
  round(max(g) FILTER (j = 1), 2) AS period_growth, round(avg(g), 2) AS avg_growth_rate,
  round((power(max(r) FILTER (j = 1) / max(r) FILTER (i = 1), 1.0 / (count(*) - 1)) - 1) * 100, 2) AS cagr, count(*) AS total_periods,
  CASE WHEN avg(g) FILTER (j <= 3) > avg(g) FILTER (i <= 3) THEN 'accelerating' ELSE 'decelerating' END AS trend,
  round(sum(r), 2) AS total_revenue, round(avg(r), 2) AS avg_period_revenue FROM w""", ("latest_period",))
def _(s, d):
    return rounded(rv.growth_metrics(table(s, d, _O), "o_orderdate", "o_totalprice"))


@query("pareto", """
WITH g AS (SELECT o_custkey, sum(o_totalprice) AS r FROM orders GROUP BY 1),
h AS (SELECT *, round(r / sum(r) OVER () * 100, 2) AS s, row_number() OVER (ORDER BY r DESC, o_custkey) AS k FROM g),
c AS (SELECT *, round(sum(s) OVER (ORDER BY k), 2) AS cs FROM h),
a AS (SELECT count(*) AS n, sum(r) AS t, count(*) FILTER (cs <= 80 OR k = 1) AS f, sum(r) FILTER (cs <= 80 OR k = 1) AS fr FROM c)
SELECT n AS total_items, round(t, 2) AS total_revenue, f AS vital_few_count, round(f / n * 100, 2) AS vital_few_pct, round(fr, 2) AS vital_few_revenue,
  round(fr / t * 100, 2) AS vital_few_revenue_pct, round((fr / t * 100) / (f / n * 100), 2) AS concentration_ratio,
  f / n * 100 < 30 AND fr / t * 100 > 70 AS is_concentrated FROM a""")
def _(s, d):
    return rv.pareto_analysis(table(s, d, _O), "o_custkey", "o_totalprice").drop("vital_few_items")


def _forecast(value: str) -> str:
    return f"""
WITH p AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS r, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY period) AS i, row_number() OVER (ORDER BY period DESC) AS j FROM p),
e AS (SELECT max(period) AS period, avg(r) FILTER (j <= 3) AS ma, avg(r) AS mean, max(r) FILTER (j = 1) AS last, regr_slope(r, i) AS slope FROM w)
SELECT period, round(r, 2) AS revenue, round(a, 2) AS avg_transaction, n AS transactions, false AS is_forecast FROM p
UNION ALL SELECT (period + to_months(k::INT))::DATE, round({value}, 2), NULL, NULL, true FROM e, range(1, 4) t(k)"""


for _m, _v in (("moving_average", "ma"), ("linear_trend", "last + slope * k"), ("average", "mean")):
    query(f"forecast_{_m}", _forecast(_v), ("period",))(lambda s, d, m=_m: rounded(rv.revenue_forecast(table(s, d, _O), "o_orderdate", "o_totalprice", 3, m)))


_ITEMS = "(SELECT l.*, p_brand, p_type, p_size / 10.0 AS rating, l_discount * 100 AS rate FROM lineitem l JOIN part ON l_partkey = p_partkey)"


def _items(s, d):
    parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", (F.col("p_size") / 10.0).alias("rating"))
    return table(s, d, _L).join(parts, "l_partkey").withColumn("rate", F.col("l_discount") * 100)


def _performance(where: str = "", order: str = "r DESC", quantity: bool = True, tail: str = "") -> str:
    q = quantity
    return f"""
WITH g AS (SELECT p_brand, sum(l_extendedprice) AS r, sum(l_quantity) AS q, count(*) AS n FROM {_ITEMS} {where} GROUP BY 1),
h AS (SELECT *, round(r / sum(r) OVER () * 100, 2) AS rs, round(q / sum(q) OVER () * 100, 2) AS qs, rank() OVER (ORDER BY r DESC) AS rr,
  rank() OVER (ORDER BY q DESC) AS qr, row_number() OVER (ORDER BY {order}, p_brand) AS k FROM g)
SELECT p_brand, round(r, 2) AS revenue, {"round(q, 2) AS quantity," if q else ""} n AS transactions, round(r / {"q" if q else "n"}, 2) AS avg_price,
  {"round(q / n, 2) AS avg_quantity_per_transaction," if q else ""} round(r / n, 2) AS avg_revenue_per_transaction, rs AS revenue_share_pct,
  {"qs AS quantity_share_pct," if q else ""} rr AS revenue_rank, {"qr AS quantity_rank," if q else ""} k AS position,
  round(sum(rs) OVER (ORDER BY k), 2) AS cumulative_revenue_share FROM h {tail}"""


@query("product_performance", _performance())
def _(s, d):
    return rounded(pr.product_performance(_items(s, d), "p_brand", "l_extendedprice", "l_quantity"))


@query("product_performance_by_quantity", _performance(order="q DESC"))
def _(s, d):
    return rounded(pr.product_performance(_items(s, d), "p_brand", "l_extendedprice", "l_quantity", sort_by="quantity"))


@query("top_products", f"SELECT * FROM ({_performance(quantity=False)}) WHERE position <= 10")
def _(s, d):
    return rounded(pr.top_products(_items(s, d), "p_brand", "l_extendedprice", 10))


@query("bottom_products", f"SELECT * FROM ({_performance(quantity=False)}) WHERE transactions >= 5 ORDER BY revenue, p_brand LIMIT 5")
def _(s, d):
    return rounded(pr.bottom_products(_items(s, d), "p_brand", "l_extendedprice", 5, 5))


@query("product_comparison", _performance("WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')"))
def _(s, d):
    return rounded(pr.product_comparison(_items(s, d), "p_brand", "l_extendedprice", ["Brand#11", "Brand#12", "Brand#21"], "l_quantity"))


@query("price_analysis", """
SELECT p_brand, round(avg(p_retailprice), 3) AS avg_price, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price, round(stddev_samp(p_retailprice), 3) AS price_std,
  count(p_retailprice) AS price_count, round(max(p_retailprice) - min(p_retailprice), 3) AS price_range, round(stddev_samp(p_retailprice) / avg(p_retailprice), 3) AS price_cv,
  coalesce(round(stddev_samp(p_retailprice) / avg(p_retailprice), 3) > 0.2, false) AS high_price_variation FROM part GROUP BY 1""")
def _(s, d):
    return rounded(pr.price_analysis(table(s, d, "part"), "p_brand", "p_retailprice"), 3)


@query("product_trends", f"""
WITH t AS (SELECT p_brand, sum(l_extendedprice) AS r FROM {_ITEMS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
g AS (SELECT date_trunc('quarter', l_shipdate)::DATE AS period, p_brand, sum(l_extendedprice) AS r FROM {_ITEMS} WHERE p_brand IN (SELECT p_brand FROM t) GROUP BY 1, 2),
f AS (SELECT a.period, t.p_brand, coalesce(g.r, 0) AS r FROM (SELECT DISTINCT period FROM g) a CROSS JOIN t LEFT JOIN g ON g.period = a.period AND g.p_brand = t.p_brand)
SELECT period, p_brand, round(r, 2) AS revenue, round((r - lag(r) OVER w) / nullif(lag(r) OVER w, 0) * 100, 2) AS growth_pct FROM f WINDOW w AS (PARTITION BY p_brand ORDER BY period)""", ("period",))
def _(s, d):
    return rounded(pr.product_trends(_items(s, d), "l_shipdate", "p_brand", "l_extendedprice", "Q"))


@query("basket", f"""
WITH i AS (SELECT DISTINCT l_orderkey, p_brand FROM {_ITEMS}), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM i),
p AS (SELECT a.p_brand AS product_1, b.p_brand AS product_2, count(*) AS count FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2)
SELECT product_1, product_2, count, round(count / n * 100, 2) AS support_pct FROM p, n WHERE count >= floor(n * 0.01)""")
def _(s, d):
    return pr.basket_pairs(_items(s, d), "l_orderkey", "p_brand", 0.01)


@query("category_performance", f"""
SELECT p_type, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_quantity), 2) AS quantity, count(*) AS transactions, count(DISTINCT l_partkey) AS unique_products,
  round(sum(l_extendedprice) / count(*), 2) AS avg_transaction_value, round(sum(l_extendedprice) / count(DISTINCT l_partkey), 2) AS avg_revenue_per_product,
  round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER () * 100, 2) AS revenue_share_pct FROM {_ITEMS} GROUP BY 1""")
def _(s, d):
    return rounded(pr.category_performance(_items(s, d), "p_type", "l_extendedprice", "l_partkey", "l_quantity"))


@query("performance_score", f"""
WITH g AS (SELECT p_brand, sum(l_extendedprice) AS r, avg(rating) AS a, avg(rate) AS b FROM {_ITEMS} GROUP BY 1),
h AS (SELECT *, round(r / sum(r) OVER () * 100, 2) AS sh FROM g),
k AS (SELECT *, round(sh / max(sh) OVER () * 100, 1) AS s1, round(a / 5 * 100, 1) AS s2, round(100 - b, 1) AS s3 FROM h)
SELECT p_brand, s1 AS revenue_score, s2 AS rating_score, s3 AS return_score, round((s1 * 0.5 + s2 * 0.3 + s3 * 0.2), 1) AS performance_score FROM k""")
def _(s, d):
    return pr.performance_score(_items(s, d), "p_brand", "l_extendedprice", "rating", "rate").select("p_brand", "revenue_score", "rating_score", "return_score", "performance_score")


@query("customer_summary", """
WITH g AS (SELECT o_custkey, sum(o_totalprice) AS r, avg(o_totalprice) AS a, count(*) AS n, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1),
h AS (SELECT *, floor((epoch_us(l) - epoch_us(f)) / 86400000000)::BIGINT AS dd FROM g)
SELECT o_custkey, round(r, 2) AS total_revenue, round(a, 2) AS avg_order_value, n AS total_orders, f AS first_order, l AS last_order, dd AS customer_lifetime_days,
  round(dd / 30, 1) AS months_active, round(n / CASE WHEN round(dd / 30, 1) = 0 THEN 1 ELSE round(dd / 30, 1) END, 2) AS orders_per_month,
  round(r / sum(r) OVER () * 100, 2) AS revenue_share_pct FROM h""")
def _(s, d):
    return rounded(cu.customer_summary(table(s, d, _O), "o_custkey", "o_totalprice", "o_orderdate"))


_RFM = """
WITH g AS (SELECT o_custkey, max(o_orderdate) AS l, count(*) AS f, sum(o_totalprice) AS m FROM orders GROUP BY 1),
x AS (SELECT *, floor((epoch_us((SELECT max(l) FROM g) + INTERVAL 1 DAY) - epoch_us(l)) / 86400000000)::BIGINT AS rec, (SELECT count(*) FROM g) AS n,
  row_number() OVER (ORDER BY f, o_custkey) AS fi, row_number() OVER (ORDER BY m, o_custkey) AS mi FROM g),
c AS (SELECT quantile_cont(rec, [0.2, 0.4, 0.6, 0.8]) AS q FROM x),
y AS (SELECT *, 5 - (rec > q[1])::INT - (rec > q[2])::INT - (rec > q[3])::INT - (rec > q[4])::INT AS r,
  greatest(1, ((fi - 1) * 5 + n - 2) // (n - 1))::INT AS fs, greatest(1, ((mi - 1) * 5 + n - 2) // (n - 1))::INT AS ms FROM x, c),
z AS (SELECT o_custkey, rec AS recency, f AS frequency, round(m, 2) AS monetary, r AS r_score, fs AS f_score, ms AS m_score, r * 100 + fs * 10 + ms AS rfm_score, r + fs + ms AS rfm_sum,
  CASE WHEN r >= 4 AND fs >= 4 AND ms >= 4 THEN 'Champions' WHEN fs >= 4 AND ms >= 4 THEN 'Loyal Customers' WHEN r >= 4 AND fs >= 2 THEN 'Potential Loyalists'
    WHEN r >= 4 AND fs <= 2 THEN 'New Customers' WHEN r <= 2 AND fs >= 3 AND ms >= 3 THEN 'At Risk' WHEN r <= 2 AND fs >= 4 AND ms >= 4 THEN 'Can''t Lose'
    WHEN r <= 2 AND fs <= 2 THEN 'Hibernating' WHEN r >= 3 AND fs >= 3 THEN 'Need Attention' WHEN r <= 3 AND fs <= 3 THEN 'About to Sleep' ELSE 'Other' END AS segment FROM y)
"""


@query("rfm", _RFM + "SELECT * FROM z")
def _(s, d):
    return rounded(cu.rfm_analysis(table(s, d, _O), "o_custkey", "o_orderdate", "o_totalprice"))


@query("rfm_segments", _RFM + "SELECT segment, count(*) AS customers FROM z GROUP BY 1")
def _(s, d):
    return cu.rfm_segment_counts(cu.rfm_analysis(table(s, d, _O), "o_custkey", "o_orderdate", "o_totalprice"))


_TIERS = """
WITH g AS (SELECT o_custkey, sum(o_totalprice) AS r FROM orders GROUP BY 1),
x AS (SELECT *, row_number() OVER (ORDER BY r, o_custkey) AS i, count(*) OVER () AS n FROM g),
t AS (SELECT *, greatest(1, ((i - 1) * 4 + n - 2) // (n - 1))::INT AS k FROM x),
u AS (SELECT o_custkey, r, ['Bronze', 'Silver', 'Gold', 'Platinum'][k] AS tier, k AS tier_order FROM t)
"""


@query("value_tiers", _TIERS + "SELECT o_custkey, round(r, 2) AS total_revenue, tier, tier_order FROM u")
def _(s, d):
    return rounded(cu.value_tiers(table(s, d, _O), "o_custkey", "o_totalprice"))


@query("tier_summary", _TIERS + """
SELECT tier, tier_order, count(*) AS customer_count, round(sum(r), 2) AS total_revenue, round(avg(r), 2) AS avg_revenue, round(min(r), 2) AS min_revenue, round(max(r), 2) AS max_revenue,
  round(count(*) / sum(count(*)) OVER () * 100, 2) AS customer_share_pct, round(sum(r) / sum(sum(r)) OVER () * 100, 2) AS revenue_share_pct FROM u GROUP BY 1, 2""")
def _(s, d):
    return rounded(cu.tier_summary(cu.value_tiers(table(s, d, _O), "o_custkey", "o_totalprice"), "o_custkey"))


@query("clv", """
WITH g AS (SELECT o_custkey, sum(o_totalprice) AS r, avg(o_totalprice) AS a, count(*) AS n, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1),
h AS (SELECT *, floor((epoch_us(l) - epoch_us(f)) / 86400000000)::BIGINT AS dd FROM g), k AS (SELECT *, greatest(dd / 30, 1) AS tm FROM h)
SELECT o_custkey, round(r, 2) AS total_revenue, round(a, 2) AS avg_order_value, n AS order_count, f AS first_order, l AS last_order, dd AS tenure_days, round(tm, 2) AS tenure_months,
  round(n / tm, 2) AS purchase_frequency, round(a * (n / tm) * 12, 2) AS projected_clv, round(r, 2) AS historical_clv FROM k""")
def _(s, d):
    return rounded(cu.lifetime_value(table(s, d, _O), "o_custkey", "o_orderdate", "o_totalprice"))


_CHURN = """
WITH g AS (SELECT o_custkey, max(o_orderdate) AS l, count(*) AS n, sum(o_totalprice) AS r FROM orders GROUP BY 1),
h AS (SELECT *, floor((epoch_us((SELECT max(l) FROM g)) - epoch_us(l)) / 86400000000)::BIGINT AS dd FROM g),
k AS (SELECT o_custkey, l AS last_purchase, n AS order_count, r, dd AS days_since_purchase,
  CASE WHEN dd <= 30 THEN 'Active' WHEN dd <= 60 THEN 'Cooling' WHEN dd <= 90 THEN 'At Risk' ELSE 'Churned' END AS churn_risk FROM h)
"""


@query("churn_risk", _CHURN + "SELECT o_custkey, last_purchase, order_count, round(r, 2) AS total_revenue, days_since_purchase, churn_risk FROM k")
def _(s, d):
    out = rounded(cu.churn_risk(table(s, d, _O), "o_custkey", "o_orderdate", "o_totalprice"))
    return out.withColumn("last_purchase", F.col("last_purchase").cast("timestamp_ntz"))


@query("churn_summary", _CHURN + """
SELECT count(*) AS total_customers, count(*) FILTER (churn_risk = 'Active') AS active, count(*) FILTER (churn_risk = 'Cooling') AS cooling, count(*) FILTER (churn_risk = 'At Risk') AS at_risk,
  count(*) FILTER (churn_risk = 'Churned') AS churned, round(coalesce(sum(r) FILTER (churn_risk IN ('At Risk', 'Churned')), 0), 2) AS revenue_at_risk FROM k""")
def _(s, d):
    return rounded(cu.churn_summary(cu.churn_risk(table(s, d, _O), "o_custkey", "o_orderdate", "o_totalprice")))
