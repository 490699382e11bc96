"""Queries on cohorts, campaigns, attribution and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import advice as ad
from ledgerloom.operators import attribution as at
from ledgerloom.operators import campaign as ca
from ledgerloom.operators import cohort as co
from ledgerloom.operators import funnel as fu
from ledgerloom.plans.registry import query, rounded, table


def _orders(s, d):
    return table(s, d, "orders")


def _segments(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return _orders(s, d).join(c, "o_custkey")


def _retention(segment: bool = False, unit: str = "quarter") -> str:
    src = "(SELECT o.*, c_mktsegment FROM orders o JOIN customer ON o_custkey = c_custkey)" if segment else "orders"
    seg = "c_mktsegment, " if segment else ""
    index = {"quarter": "4 * (year(p) - year(c)) + quarter(p) - quarter(c)", "year": "year(p) - year(c)"}[unit]
    using = "USING (c_mktsegment)" if segment else "ON true"
    return f"""
WITH a AS (SELECT {seg}o_custkey, date_trunc('{unit}', o_orderdate)::DATE AS p, sum(o_totalprice) AS v FROM {src} GROUP BY ALL),
b AS (SELECT *, min(p) OVER (PARTITION BY {seg}o_custkey) AS c FROM a),
g AS (SELECT {seg}c AS cohort, CAST({index} AS BIGINT) AS period_index, count(*) AS customers, sum(v) AS revenue FROM b GROUP BY ALL),
z AS (SELECT {seg}cohort, customers AS cohort_size FROM g WHERE period_index = 0),
m AS (SELECT {seg}cohort, period_index, coalesce(customers, 0) AS customers, cohort_size, round(coalesce(customers, 0) / cohort_size * 100, 2) AS retention_pct,
  coalesce(revenue, 0) AS revenue FROM z JOIN (SELECT DISTINCT {seg}period_index FROM g) i {using} LEFT JOIN g USING ({seg}cohort, period_index))
"""


def _matrix(s, d, **k):
    return co.cohort_retention(_orders(s, d), "o_custkey", "o_orderdate", "Q", "o_totalprice", **k)


_C = ("cohort",)


@query("cohort_retention", _retention() + "SELECT * EXCLUDE (revenue) FROM m", _C)
def _(s, d):
    return rounded(_matrix(s, d).drop("revenue"))


@query("cohort_revenue", _retention() + "SELECT cohort, period_index, round(revenue, 2) AS revenue FROM m", _C)
def _(s, d):
    return rounded(_matrix(s, d).select("cohort", "period_index", "revenue"))


@query("cohort_avg_retention", _retention() + "SELECT period_index, round(avg(retention_pct), 2) AS avg_retention, count(*) AS cohorts FROM m GROUP BY 1")
def _(s, d):
    return co.retention_by_index(_matrix(s, d))


@query("cohort_retention_by_segment", _retention(True, "year") + "SELECT * EXCLUDE (revenue) FROM m", _C)
def _(s, d):
    return rounded(co.cohort_retention(_segments(s, d), "o_custkey", "o_orderdate", "Y", segment="c_mktsegment"))


@query("cohort_ltv", _retention() + """
SELECT cohort, period_index, round(revenue / cohort_size, 6) AS revenue_per_customer, round(sum(revenue / cohort_size) OVER (PARTITION BY cohort ORDER BY period_index), 6) AS ltv
FROM m WHERE period_index < 12""", _C)
def _(s, d):
    return rounded(co.cohort_ltv(_orders(s, d), "o_custkey", "o_orderdate", "o_totalprice", "Q"), 6)


@query("cohort_high_retention", _retention() + "SELECT cohort, retention_pct FROM m WHERE period_index = 3 AND retention_pct >= 20", _C)
def _(s, d):
    return rounded(co.high_retention_cohorts(_matrix(s, d), 3, 20))


@query("cohort_churn", _retention() + "SELECT cohort, period_index, round(100 - retention_pct, 2) AS churn_pct FROM m", _C)
def _(s, d):
    return rounded(co.cohort_churn(_matrix(s, d)))


@query("cohort_metadata", _retention() + """
SELECT count(*) FILTER (period_index = 0) AS total_cohorts, CAST(sum(cohort_size) FILTER (period_index = 0) AS BIGINT) AS total_customers,
  round(avg(cohort_size) FILTER (period_index = 0), 2) AS avg_cohort_size, min(period_index) AS first_index, max(period_index) AS last_index FROM m""")
def _(s, d):
    return rounded(co.cohort_metadata(_matrix(s, d)))


_WIDE = ", ".join(f"round(max(retention_pct) FILTER (period_index = {i}), 1) AS Period_{i}" for i in range(7))


@query("cohort_matrix_wide", _retention(unit="year") + f"SELECT cohort, {_WIDE} FROM m GROUP BY 1", _C)
def _(s, d):
    """Orders of seven years: every index there is."""
    return rounded(co.retention_matrix(co.cohort_retention(_orders(s, d), "o_custkey", "o_orderdate", "Y")))


@query("cohort_reactivation", """
WITH r AS (SELECT o_custkey, o_orderdate AS t, floor((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))) / 86400000000) AS gap,
  date_trunc('quarter', min(o_orderdate) OVER (PARTITION BY o_custkey))::DATE AS cohort FROM orders),
x AS (SELECT *, CAST(4 * (year(t) - year(cohort)) + quarter(t) - quarter(cohort) AS BIGINT) AS period_index FROM r)
SELECT cohort, period_index, count(*) FILTER (gap > 90) AS reactivated, CASE WHEN count(*) FILTER (gap > 90) > 0 THEN 100.0::DOUBLE ELSE 0.0 END AS rate_pct FROM x GROUP BY 1, 2""", _C)
def _(s, d):
    return rounded(co.reactivation(_orders(s, d), "o_custkey", "o_orderdate", 90, "Q"))


@query("cohort_trends", _retention() + """
, k AS (SELECT cohort, row_number() OVER (ORDER BY cohort) AS i, row_number() OVER (ORDER BY cohort DESC) AS j FROM (SELECT DISTINCT cohort FROM m)),
t AS (SELECT period_index, avg(retention_pct) FILTER (j <= 3) AS r, avg(retention_pct) FILTER (i <= 3) AS e FROM m JOIN k USING (cohort) GROUP BY 1)
SELECT period_index, round(r, 2) AS recent_avg, round(e, 2) AS early_avg, round(r - e, 2) AS difference, count(*) FILTER (r > e) OVER () AS improving,
  count(*) FILTER (r < e) OVER () AS declining, CASE WHEN avg(r - e) OVER () > 0 THEN 'improving' ELSE 'declining' END AS trend FROM t""")
def _(s, d):
    return rounded(co.cohort_trends(_matrix(s, d)))


# events as a daily campaign table: views are impressions, clicks clicks, purchases conversions; values of purchases revenue, of errors cost
_METRICS = {"impressions": "view", "clicks": "click", "conversions": "purchase"}
_DAILY = """(SELECT date_trunc('day', ts) AS day, 'c' || (user_id % 7) AS campaign, 'dev' || (user_id % 3) AS device,
  CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS impressions, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS clicks,
  CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS conversions, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS revenue,
  coalesce(sum(value) FILTER (event_type = 'error'), 0) AS cost FROM events GROUP BY ALL)"""


def _daily(s, d):
    e, kind = table(s, d, "events"), F.col("event_type")
    user = F.col("user_id")
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), F.concat(F.lit("c"), (user % 7).cast("string")).alias("campaign"), F.concat(F.lit("dev"), (user % 3).cast("string")).alias("device")).agg(
        *[F.count_if(kind == v).cast("double").alias(m) for m, v in _METRICS.items()],
        F.coalesce(F.sum(F.when(kind == "purchase", F.col("value"))), F.lit(0.0)).alias("revenue"), F.coalesce(F.sum(F.when(kind == "error", F.col("value"))), F.lit(0.0)).alias("cost"),
    )


_ALL = list(_METRICS) + ["revenue"]


@query("campaign_summary", " UNION ALL ".join(f"""
SELECT '{m}' AS metric, round(sum({m}), 3) AS sum, round(avg({m}), 3) AS mean, round(median({m}), 3) AS median, round(stddev_samp({m}), 3) AS std, round(min({m}), 3) AS min, round(max({m}), 3) AS max FROM {_DAILY}""" for m in _ALL))
def _(s, d):
    return rounded(ca.campaign_summary(_daily(s, d), _ALL), 3)


@query("campaign_summary_grouped", f"""
SELECT campaign, device, sum(clicks) AS clicks_sum, round(avg(clicks), 3) AS clicks_mean, count(clicks) AS clicks_count,
  round(sum(revenue), 3) AS revenue_sum, round(avg(revenue), 3) AS revenue_mean, count(revenue) AS revenue_count FROM {_DAILY} GROUP BY 1, 2""")
def _(s, d):
    return rounded(ca.campaign_summary(_daily(s, d), ["clicks", "revenue"], ["campaign", "device"]), 3)


@query("campaign_yoy", """
WITH g AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS period_in_year, sum(o_totalprice) FILTER (year(o_orderdate) = 2000) AS c, sum(o_totalprice) FILTER (year(o_orderdate) = 1999) AS p
  FROM orders WHERE year(o_orderdate) IN (1999, 2000) GROUP BY 1)
SELECT period_in_year, round(c, 2) AS o_totalprice_current, round(p, 2) AS o_totalprice_previous, round(c - p, 2) AS o_totalprice_change,
  round(coalesce((c - p) / nullif(p, 0) * 100, 0), 2) AS o_totalprice_change_pct FROM g""")
def _(s, d):
    return rounded(ca.year_over_year(_orders(s, d), "o_orderdate", ["o_totalprice"], 2000, 1999))


def _wave(m: str) -> str:
    return f"""SELECT '{m}' AS metric, coalesce(sum({m}) FILTER (day BETWEEN '2024-01-15' AND '2024-01-24'), 0) AS a, coalesce(sum({m}) FILTER (day BETWEEN '2024-01-01' AND '2024-01-07'), 0) AS b FROM {_DAILY}"""


@query("campaign_waves", f"""
WITH w AS ({_wave("clicks")} UNION ALL {_wave("revenue")})
SELECT metric, round(a, 2) AS wave_1_total, round(b, 2) AS wave_2_total, round(a / 10, 2) AS wave_1_daily_avg, round(b / 7, 2) AS wave_2_daily_avg,
  round(a - b, 2) AS absolute_change, round(coalesce((a - b) / nullif(b, 0) * 100, 0), 2) AS percent_change FROM w""")
def _(s, d):
    return rounded(ca.wave_comparison(_daily(s, d), "day", ["clicks", "revenue"], ("2024-01-15", "2024-01-24"), ("2024-01-01", "2024-01-07")))


@query("campaign_kpis", f"""
WITH c AS (SELECT campaign, sum(impressions) AS i, sum(clicks) AS c, sum(conversions) AS v, round(sum(revenue), 6) AS r, round(sum(cost), 6) AS k FROM {_DAILY} GROUP BY 1)
SELECT campaign, i AS impressions, c AS clicks, v AS conversions, round(r, 3) AS revenue, round(k, 3) AS cost, round(coalesce(c / nullif(i, 0), 0) * 100, 3) AS CTR, round(coalesce(v / nullif(c, 0), 0) * 100, 3) AS CVR,
  round(coalesce(k / nullif(c, 0), 0), 3) AS CPC, round(coalesce(k / nullif(v, 0), 0), 3) AS CPA, round(coalesce(r / nullif(k, 0), 0), 3) AS ROAS, round(coalesce(r / nullif(c, 0), 0), 3) AS Revenue_per_Click FROM c""")
def _(s, d):
    sums = _daily(s, d).groupBy("campaign").agg(*[F.round(F.sum(m), 6).alias(m) for m in [*_ALL, "cost"]])
    return rounded(ca.campaign_kpis(sums, "impressions", "clicks", "conversions", "revenue", "cost"), 3)


@query("top_campaigns", f"""
WITH c AS (SELECT campaign, sum(revenue) AS t FROM {_DAILY} GROUP BY 1 HAVING sum(revenue) >= 1000),
r AS (SELECT *, round(t / sum(t) OVER () * 100, 2) AS percentage_of_total, row_number() OVER (ORDER BY t DESC, campaign) AS rank FROM c)
SELECT campaign, round(t, 2) AS total, percentage_of_total, rank FROM r WHERE rank <= 5""")
def _(s, d):
    return rounded(ca.top_campaigns(_daily(s, d), "campaign", "revenue", 5, 1000))


@query("campaign_by_device", f"""
SELECT device, sum(clicks) AS clicks, round(sum(revenue), 2) AS revenue, round(sum(clicks) / sum(sum(clicks)) OVER () * 100, 2) AS clicks_share,
  round(sum(revenue) / sum(sum(revenue)) OVER () * 100, 2) AS revenue_share FROM {_DAILY} GROUP BY 1""")
def _(s, d):
    return rounded(ca.performance_by_device(_daily(s, d), "device", ["clicks", "revenue"]))


@query("campaign_anomalies", f"""
WITH a AS (SELECT day::DATE AS day, sum(clicks) AS clicks FROM {_DAILY} GROUP BY 1),
b AS (SELECT *, avg(clicks) OVER w AS m, stddev_samp(clicks) OVER w AS sd FROM a WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, coalesce((clicks - m) / nullif(sd, 0), 0) AS z FROM b)
SELECT day, clicks, round(m, 4) AS rolling_mean, round(sd, 4) AS rolling_std, round(z, 4) AS z_score, abs(z) > 1.5 AS is_anomaly,
  CASE WHEN abs(z) > 1.5 AND z > 0 THEN 'spike' WHEN abs(z) > 1.5 THEN 'drop' ELSE 'normal' END AS anomaly_type FROM c""", ("day",))
def _(s, d):
    daily = _daily(s, d).groupBy(F.to_date("day").alias("day")).agg(F.sum("clicks").alias("clicks"))
    return rounded(ca.campaign_anomalies(daily, "day", "clicks", 1.5), 4)


@query("campaign_half_trend", """
WITH a AS (SELECT ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1), b AS (SELECT *, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM a),
c AS (SELECT avg(v) FILTER (i <= n // 2) AS f, avg(v) FILTER (i > n - n // 2) AS s FROM b)
SELECT round(f, 3) AS first_half, round(s, 3) AS second_half, round((s - f) / nullif(f, 0) * 100, 3) AS change_pct,
  CASE WHEN (s - f) / f * 100 > 10 THEN 'growing' WHEN (s - f) / f * 100 < -10 THEN 'declining' ELSE 'stable' END AS trend FROM c""")
def _(s, d):
    return rounded(ca.half_trend(table(s, d, "events"), "ts", "value"), 3)


def _touches(s, d):
    return table(s, d, "events").select("user_id", "ts", "event_id", F.concat(F.lit("ch"), (F.col("event_id") % 5).cast("string")).alias("channel"), (F.col("event_type") == "purchase").cast("int").alias("conversion"))


_ARGS = ("user_id", "channel", "conversion", "ts")
_T = "(SELECT user_id, ts, event_id, 'ch' || (event_id % 5) AS channel, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM events)"


def _end(f: str, where: str = "WHERE v > 0") -> str:
    return f"""WITH a AS (SELECT user_id, {f}(channel, (ts, event_id)) AS channel FROM {_T} {where} GROUP BY 1),
b AS (SELECT user_id, sum(v) AS v FROM {_T} WHERE v > 0 GROUP BY 1), c AS (SELECT channel, sum(v) AS x FROM a JOIN b USING (user_id) GROUP BY 1)"""


def _join(days: int, weight: str) -> str:
    return f"""WITH t AS (SELECT * FROM {_T}), j AS (SELECT c.event_id AS id, c.v AS cv, t.channel,
  floor((epoch_us(c.ts) - epoch_us(t.ts)) / 86400000000) AS dd, count(*) OVER (PARTITION BY c.event_id) AS n,
  row_number() OVER (PARTITION BY c.event_id ORDER BY t.ts, t.event_id) AS i
  FROM t c JOIN t ON t.user_id = c.user_id AND t.ts <= c.ts AND t.ts >= c.ts - INTERVAL {days} DAY WHERE c.v > 0),
w AS (SELECT *, {weight} AS wt FROM j), c AS (SELECT channel, sum(wt * cv) AS x FROM w GROUP BY 1)"""


_OUT = " SELECT channel, round(x, 4) AS attributed_conversions, round(x / sum(x) OVER () * 100, 2) AS attribution_percentage FROM c"
_LIN = _join(7, "1.0 / n")
_DEC = _join(7, "power(2.0, -dd / 3.0) / sum(power(2.0, -dd / 3.0)) OVER (PARTITION BY id)")
_POS = _join(7, "CASE WHEN n = 1 THEN 1.0 WHEN i = 1 THEN 0.4 WHEN i = n THEN 0.4 ELSE 0.2 / (n - 2) END")

for _n, _f, _q in (
    ("attribution_last_touch", lambda t: at.last_touch(t, *_ARGS, tie="event_id"), _end("arg_max")),
    ("attribution_first_touch", lambda t: at.first_touch(t, *_ARGS, tie="event_id"), _end("arg_min")),
    ("attribution_last_touch_journey", lambda t: at.last_touch(t, *_ARGS, tie="event_id", journey=True), _end("arg_max", "")),
    ("attribution_first_touch_journey", lambda t: at.first_touch(t, *_ARGS, tie="event_id", journey=True), _end("arg_min", "")),
    ("attribution_linear", lambda t: at.linear(t, *_ARGS, 7, tie="event_id"), _LIN),
    ("attribution_time_decay", lambda t: at.time_decay(t, *_ARGS, 7, 3, tie="event_id"), _DEC),
    ("attribution_position", lambda t: at.position_based(t, *_ARGS, 7, tie="event_id"), _POS),
):
    query(_n, _q + _OUT)(lambda s, d, f=_f: rounded(f(_touches(s, d)), 4))

_ONE = lambda q, n: f"(SELECT '{n}' AS model, channel, x FROM ({q} SELECT channel, x FROM c))"
_MODELS = " UNION ALL ".join("SELECT * FROM " + _ONE(q, n) for q, n in (
    (_end("arg_max"), "Last Touch"), (_end("arg_min"), "First Touch"), (_LIN, "Linear"),
    (_join(7, "power(2.0, -dd / 7.0) / sum(power(2.0, -dd / 7.0)) OVER (PARTITION BY id)"), "Time Decay"), (_POS, "Position Based")))
_PIVOT = ", ".join(f"""round(coalesce(sum(x) FILTER (model = '{m}'), 0), 4) AS "{m}\"""" for m in at.MODELS)


@query("attribution_compare", f"SELECT channel, {_PIVOT} FROM ({_MODELS}) GROUP BY 1")
def _(s, d):
    return rounded(at.compare_models(_touches(s, d), *_ARGS, 7, tie="event_id"), 4)


@query("attribution_most_disputed", f"""
SELECT channel, round(var_samp(x), 3) AS variance, round(min(x), 3) AS lowest, round(max(x), 3) AS highest FROM ({_MODELS}) GROUP BY 1 ORDER BY var_samp(x) DESC, channel LIMIT 1""")
def _(s, d):
    return rounded(at.most_disputed(at.compare_models(_touches(s, d), *_ARGS, 7, tie="event_id")), 3)


_STAGES = ["viewed", "clicked", "signed_up", "purchased"]
_KINDS = ["view", "click", "signup", "purchase"]
_USERS = "(SELECT user_id, ts::DATE AS day, 'g' || (user_id % 3) AS grp, " + ", ".join(f"CAST(bool_or(event_type = '{k}') AS BIGINT) AS {c}" for c, k in zip(_STAGES, _KINDS)) + " FROM events GROUP BY 1, 2, 3)"


def _users(s, d):
    e = table(s, d, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day"), F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("grp")).agg(*[F.max((F.col("event_type") == k).cast("int")).alias(c) for c, k in zip(_STAGES, _KINDS)])


def _funnel_sql(by: str = "", where: str = "") -> str:
    stages = " UNION ALL ".join(f"SELECT {by}{i} AS stage_index, '{c}' AS stage, sum({c}) AS c, {'count(*)' if i == 0 else f'sum({_STAGES[i - 1]})'} AS b, sum({_STAGES[0]}) AS f, sum({_STAGES[-1]}) AS l, count(*) AS t FROM u {'GROUP BY 1' if by else ''}" for i, c in enumerate(_STAGES))
    return f"""WITH u AS (SELECT * FROM {_USERS} {where}), x AS ({stages}),
f AS (SELECT {by}CAST(stage_index AS BIGINT) AS stage_index, stage, CAST(c AS BIGINT) AS count, round(coalesce(c / nullif(b, 0) * 100, 0), 4) AS conversion_rate,
  round(CASE WHEN b > 0 THEN 100 - c / b * 100 ELSE 0 END, 4) AS drop_off_rate, round(coalesce(c / nullif(f, 0) * 100, 0), 4) AS pct_of_first, round(coalesce(l / nullif(t, 0) * 100, 0), 4) AS overall_conversion FROM x)"""


@query("funnel", _funnel_sql() + " SELECT * FROM f")
def _(s, d):
    return rounded(fu.analyze_funnel(_users(s, d), _STAGES), 4)


@query("funnel_by_cohort", _funnel_sql("grp, ") + " SELECT * FROM f")
def _(s, d):
    return rounded(fu.analyze_funnel(_users(s, d), _STAGES, by=["grp"]), 4)


@query("funnel_bottlenecks", _funnel_sql() + """
, g AS (SELECT *, coalesce(lag(count) OVER (ORDER BY stage_index) - count, 0) AS users_lost FROM f)
SELECT stage, stage_index, drop_off_rate, users_lost FROM g WHERE drop_off_rate >= 5""")
def _(s, d):
    return rounded(fu.bottlenecks(fu.analyze_funnel(_users(s, d), _STAGES), 5), 4)


@query("funnel_compare", f"""
WITH a AS ({_funnel_sql("", "WHERE grp = 'g0'")} SELECT * FROM f), b AS ({_funnel_sql("", "WHERE grp = 'g1'")} SELECT * FROM f)
SELECT a.stage_index, a.stage, a.count AS A_count, b.count AS B_count, printf('%.1f%%', a.conversion_rate) AS A_rate, printf('%.1f%%', b.conversion_rate) AS B_rate, b.count - a.count AS difference
FROM a JOIN b USING (stage_index)""")
def _(s, d):
    u = _users(s, d)
    return fu.compare_funnels(fu.analyze_funnel(u.where("grp = 'g0'"), _STAGES), fu.analyze_funnel(u.where("grp = 'g1'"), _STAGES), ("A", "B"))


@query("funnel_segments", f"""
SELECT segment, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN viewed = 0 THEN 'did_not_start' END, CASE WHEN viewed = 1 AND clicked = 0 THEN 'dropped_at_clicked' END,
  CASE WHEN clicked = 1 AND signed_up = 0 THEN 'dropped_at_signed_up' END, CASE WHEN signed_up = 1 AND purchased = 0 THEN 'dropped_at_purchased' END,
  CASE WHEN viewed = 1 AND clicked = 1 AND signed_up = 1 AND purchased = 1 THEN 'completed' END], lambda x: x IS NOT NULL)) AS segment FROM {_USERS}) GROUP BY 1""")
def _(s, d):
    return fu.funnel_segments(_users(s, d), _STAGES).groupBy("segment").agg(F.count("*").alias("n"))


@query("funnel_velocity", """
WITH u AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS viewed, min(ts) FILTER (event_type = 'click') AS clicked, min(ts) FILTER (event_type = 'purchase') AS purchased FROM events GROUP BY 1),
p AS (SELECT 'viewed' AS from_stage, 'clicked' AS to_stage, (epoch_us(clicked) - epoch_us(viewed)) / 86400000000 AS days FROM u
  UNION ALL SELECT 'clicked', 'purchased', (epoch_us(purchased) - epoch_us(clicked)) / 86400000000 FROM u)
SELECT from_stage, to_stage, count(*) AS users, round(avg(days), 4) AS avg_days, round(median(days), 4) AS median_days FROM p WHERE days >= 0 GROUP BY 1, 2""")
def _(s, d):
    e = table(s, d, "events")
    t = e.groupBy("user_id").agg(*[F.min(F.when(F.col("event_type") == k, F.col("ts"))).alias(c) for c, k in (("viewed", "view"), ("clicked", "click"), ("purchased", "purchase"))])
    return rounded(fu.funnel_velocity(t, ["viewed", "clicked", "purchased"]), 4)


# recommendations: the rules met with figures


def _advice_sql(source: str, rule_set: str) -> str:
    """One SELECT a rule over a table of a row a subject."""
    marks = ("over", ">"), ("up_to", "<="), ("least", ">="), ("under", "<")
    parts = []
    for kind, rule, conditions, priority, category, impact, title, told, form, _ in ad.RULES:
        if kind == rule_set:
            holds = " AND ".join(f"{m} {mark} {b}" for m, bounds in conditions.items() for (_, mark), b in zip(marks, bounds, strict=True) if b is not None)
            digits = form[form.index("%.") + 2]
            before, after = form.split(f"%.{digits}f")
            parts.append(f"SELECT subject, '{rule}' AS rule, '{priority}' AS priority, {ad.PRIORITIES[priority]} AS o, '{category}' AS category, '{impact}' AS estimated_impact, '{title}' AS title, '{before}' || printf('%.{digits}f', round({told}, {digits})) || '{after}' AS description FROM f WHERE {holds}")
    return f"WITH f AS ({source}), r AS ({' UNION ALL '.join(parts)}) SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY o DESC, rule) AS place, rule, priority, category, estimated_impact, title, description FROM r"


_SPENT = """SELECT 'u' || (user_id % 60) AS subject, round(sum(value) FILTER (event_type = 'purchase') / sum(value) FILTER (event_type = 'error'), 6) AS roi, round(20 * sum(value) FILTER (event_type = 'error') / count(*) FILTER (event_type = 'purchase'), 6) AS cac,
  round((sum(value) FILTER (event_type = 'purchase' AND hour(ts) >= 12) / sum(value) FILTER (event_type = 'purchase' AND hour(ts) < 12) - 1) * 100, 6) AS yoy_change FROM events GROUP BY 1"""


@query("campaign_advice", _advice_sql(_SPENT, "campaign"))
def _(s, d):
    """Groups of users as campaigns; afternoons against mornings stand for the years."""
    e, v = table(s, d, "events"), F.col("value")
    bought, late = F.col("event_type") == "purchase", F.hour("ts") >= 12
    cost, pick = F.sum(F.when(F.col("event_type") == "error", v)), lambda c: F.sum(F.when(c, v))
    f = e.groupBy(F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")).alias("g")).agg(
        F.round(pick(bought) / cost, 6).alias("roi"), F.round(20 * cost / F.nullif(F.count_if(bought), F.lit(0)), 6).alias("cac"), F.round((pick(bought & late) / pick(bought & ~late) - 1) * 100, 6).alias("yoy_change"))
    return ad.recommend(ad.figures_of(f, "g", {c: c for c in ("roi", "cac", "yoy_change")}), "campaign").drop("action_items")


@query("cohort_advice", _advice_sql(_retention() + """SELECT CAST(cohort AS VARCHAR) AS subject, max(retention_pct) FILTER (period_index = 1) AS retention_1, max(retention_pct) FILTER (period_index = 6) AS retention_6,
  100 - max(retention_pct) FILTER (period_index = 1) AS churn_rate FROM m GROUP BY 1""", "cohort"))
def _(s, d):
    at_index = lambda i: F.max(F.when(F.col("period_index") == i, F.col("retention_pct")))
    f = _matrix(s, d).groupBy(F.col("cohort").cast("string").alias("c")).agg(at_index(1).alias("retention_1"), at_index(6).alias("retention_6"), (100 - at_index(1)).alias("churn_rate"))
    return ad.recommend(ad.figures_of(f, "c", {c: c for c in ("retention_1", "retention_6", "churn_rate")}), "cohort").drop("action_items")
