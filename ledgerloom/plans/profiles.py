"""Queries on profiles, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.text_metrics import text_metrics, text_table
from ledgerloom.operators import column_state as cs
from ledgerloom.operators import profile as pf
from ledgerloom.operators.association import correlation_pairs
from ledgerloom.operators.narrate import correlation_insights, segment_insights, series_insights
from ledgerloom.operators.scan import full_scan, half_changes, mean_gaps, ranked_findings, top_fifth, top_value_share
from ledgerloom.plans.registry import query, rounded, table


def _numeric(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS column, count({c}) AS count, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
  round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(quantile_cont({c}, 0.25)::DOUBLE, 4) AS q25, round(quantile_cont({c}, 0.75)::DOUBLE, 4) AS q75,
  round((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))::DOUBLE, 4) AS iqr, round(skewness({c}), 4) AS skewness, count(*) FILTER ({c} < lo OR {c} > hi) > 0 AS has_outliers, count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count,
  round(sum({c})::DOUBLE, 4) AS sum FROM {t}, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})"""


_CUSTOMER = ["c_acctbal", "c_nationkey"]


@query("numeric_summary", " UNION ALL ".join(_numeric(c, "customer") for c in _CUSTOMER))
def _(s, d):
    return pf.numeric_summary(table(s, d, "customer"), _CUSTOMER)


@query("describe", " UNION ALL ".join(f"""
SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(min({c})::DOUBLE, 2) AS min, round(quantile_cont({c}, 0.25)::DOUBLE, 2) AS q25, round(median({c}), 2) AS median,
  round(quantile_cont({c}, 0.75)::DOUBLE, 2) AS q75, round(max({c})::DOUBLE, 2) AS max FROM customer""" for c in _CUSTOMER))
def _(s, d):
    return pf.describe(table(s, d, "customer"), _CUSTOMER)


_CATS = ["p_brand", "p_type"]


@query("value_counts", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, count(*) AS n FROM part GROUP BY {c}) WHERE rank <= 3" for c in _CATS))
def _(s, d):
    return pf.value_counts(table(s, d, "part"), _CATS, 3)


@query("categorical_summary", " UNION ALL ".join(f"""
SELECT '{c}' AS column, CAST(sum(k) AS BIGINT) AS count, 0::BIGINT AS missing, 0.0::DOUBLE AS missing_pct, count(*) AS unique_count, arg_min(v, (-k, v)) AS top_value, max(k) AS top_count, round(max(k) / sum(k) * 100, 2) AS top_pct
FROM (SELECT {c} AS v, count(*) AS k FROM part GROUP BY 1)""" for c in _CATS))
def _(s, d):
    return pf.categorical_summary(table(s, d, "part"), _CATS)


@query("datetime_range", """
SELECT 'ts' AS column, min(ts) AS min, max(ts) AS max, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS range_days, count(DISTINCT ts::DATE) AS unique_dates FROM events""")
def _(s, d):
    return pf.datetime_range(table(s, d, "events"), "ts")


@query("duplicate_rows", "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates FROM lineitem")
def _(s, d):
    return pf.duplicate_rows(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"))


#: A table with gaps, repeated rows, a constant and columns of every kind, made of line items: name, kind, SQL of both sides.
_MIXED = [
    ("channel", "text", "l_returnflag"), ("quantity", "number", "CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END"), ("disc", "number", "l_discount"), ("tax_rate", "number", "l_tax * 100"),
    ("flag", "text", "CASE WHEN l_linenumber % 2 = 0 THEN 'Yes' ELSE 'No' END"), ("odd", "number", "l_linenumber % 2"), ("constant", "text", "'x'"), ("shipped", "datetime", "l_shipdate"), ("order_code", "number", "l_orderkey"),
    ("revenue", "number", "l_extendedprice"), ("day_text", "text", "CAST(CAST(l_shipdate AS DATE) AS STRING)"), ("note", "text", "repeat(l_linestatus, 60)"), ("parcel", "text", "concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber)"),
    ("nothing", "text", "CAST(CASE WHEN l_quantity < 0 THEN 'x' END AS STRING)"), ("agreed", "boolean", "l_tax > 0.04"),
]
_MIXED_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, _, e in _MIXED) + " FROM lineitem"
_DIRTY = ["channel", "flag", "constant", "nothing", "agreed", "odd"]
_DIRTY_SQL = f"SELECT {', '.join(_DIRTY)} FROM ({_MIXED_SQL})"


def _mixed(s, d):
    return table(s, d, "lineitem").selectExpr(*[f"{e} AS {c}" for c, _, e in _MIXED])


_CELLS = "WITH d AS (" + _DIRTY_SQL + "), c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS gaps, count(*) AS rows, count(DISTINCT {c}) AS kinds FROM d" for c in _DIRTY) + "), u AS (SELECT count(*) AS kinds FROM (SELECT DISTINCT * FROM d))"


@query("quick_stats", _CELLS + """
SELECT (SELECT count(*) FROM d) AS rows, (SELECT count(*) FROM d) - (SELECT kinds FROM u) AS duplicates, count(*) AS columns, 1::BIGINT AS numeric_columns, round(sum(gaps) / sum(rows) * 100, 2) AS missing_pct,
  (SELECT round(sum(odd), 2)::DOUBLE FROM d) AS total_odd, (SELECT round(avg(odd), 2) FROM d) AS avg_odd FROM c""")
def _(s, d):
    return pf.quick_stats(_mixed(s, d).select(*_DIRTY))


@query("distribution", f"""
SELECT count(value) AS count, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, round(min(value), 2) AS min, round(max(value), 2) AS max, round(max(value) - min(value), 2) AS range,
  {", ".join(f"round(quantile_cont(value, {p / 100}), 2) AS p{p}" for p in pf.PERCENTILES)}, round(skewness(value), 2) AS skewness, round(kurtosis(value), 2) AS kurtosis FROM events""")
def _(s, d):
    return pf.distribution(table(s, d, "events"), "value")


@query("compare_periods", """
WITH g AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS t, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1), h AS (SELECT *, lag(t) OVER (ORDER BY period) AS p FROM g)
SELECT period, round(t, 2) AS total, round(a, 2) AS average, n AS count, round(p, 2) AS prev_total, round(t - p, 2) AS change, round((t - p) / p * 100, 2) AS change_pct FROM h""", ("period",))
def _(s, d):
    return rounded(pf.compare_periods(table(s, d, "orders"), "o_orderdate", "o_totalprice"))


@query("top_performers", """
WITH g AS (SELECT o_custkey, sum(o_totalprice) AS t, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1), h AS (SELECT *, round(t / sum(t) OVER () * 100, 2) AS share_pct, row_number() OVER (ORDER BY t DESC, o_custkey) AS rank FROM g)
SELECT o_custkey, round(t, 2) AS total, round(a, 2) AS average, n AS count, share_pct, rank FROM h WHERE rank <= 10""")
def _(s, d):
    return rounded(pf.top_performers(table(s, d, "orders"), "o_custkey", "o_totalprice"))


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("missing_values", " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS non_null, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS unique_count FROM part" for c in _PART))
def _(s, d):
    return pf.missing_values(table(s, d, "part"))


_STEPS = "CASE WHEN {0} > {3} THEN 3 WHEN {0} > {2} THEN 2 WHEN {0} > {1} THEN 1 ELSE 0 END"


@query("data_quality", _CELLS + f"""
, q AS (SELECT any_value(rows) AS rows, round(sum(gaps) / sum(rows) * 100, 2) AS missing_pct, round((any_value(rows) - (SELECT kinds FROM u)) / any_value(rows) * 100, 2) AS duplicate_pct, count(*) FILTER (kinds <= 1) AS constant_columns FROM c),
g AS (SELECT *, {_STEPS.format("missing_pct", 10, 30, 50)} AS a, {_STEPS.format("duplicate_pct", 5, 20, 50)} AS b, CASE WHEN rows < 10 THEN 3 WHEN rows < 50 THEN 2 WHEN rows < 100 THEN 1 ELSE 0 END AS e, CASE WHEN constant_columns > 0 THEN 1 ELSE 0 END AS f FROM q)
SELECT rows, missing_pct, duplicate_pct, constant_columns, 1::BIGINT AS n_numeric, CASE greatest(a, b, e, f) WHEN 3 THEN 'critical' WHEN 2 THEN 'poor' WHEN 1 THEN 'fair' ELSE 'good' END AS level,
  array_to_string(list_filter([CASE WHEN a > 0 THEN 'missing values' END, CASE WHEN b > 0 THEN 'duplicate rows' END, CASE WHEN e > 0 THEN 'few rows' END, CASE WHEN f > 0 THEN 'constant columns' END], lambda x: x IS NOT NULL), ', ') AS warnings FROM g""")
def _(s, d):
    return pf.data_quality(_mixed(s, d).select(*_DIRTY))


def _type_sql(c: str, kind: str) -> str:
    """One row: what the rules need to know of a column, and the first that fits."""
    has = lambda words: "true" if any(w in c for w in words) else "false"
    number, text = kind == "number", kind == "text"
    lo, hi = f"lower(min({c})::VARCHAR)", f"lower(max({c})::VARCHAR)"
    words = ", ".join(f"'{w}'" for w in cs.BOOLEAN_WORDS)
    return f"""SELECT '{c}' AS column, CASE WHEN n = 0 THEN 'unknown' WHEN {str(kind == "boolean").lower()} OR u = 2 AND lo = 0 AND hi = 1 OR u <= 2 AND (lt IN ({words}) OR ht IN ({words})) THEN 'boolean'
  WHEN {str(kind == "datetime").lower()} OR dates > n * 0.8 THEN 'datetime' WHEN {has(cs.ID_WORDS)} THEN 'identifier' WHEN {str(number).lower()} AND {has(cs.CURRENCY_WORDS)} THEN 'currency'
  WHEN {str(number).lower()} AND ({has(cs.PERCENT_WORDS)} OR lo >= 0 AND hi <= 1) THEN 'percentage' WHEN {str(number).lower()} THEN 'numeric' WHEN len > 50 THEN 'text' WHEN u / n > 0.9 AND n > 20 THEN 'identifier'
  WHEN u / n < 0.5 OR u < 20 THEN 'categorical' ELSE 'text' END AS semantic_type, round((rows - n) / rows * 100, 2) AS null_pct, CASE WHEN n = 0 THEN 0 ELSE round(u / n * 100, 2) END AS unique_pct, {"round(len, 2)" if text else "NULL::DOUBLE"} AS avg_length
  FROM (SELECT count(*) AS rows, count({c}) AS n, count(DISTINCT {c}) AS u, {f"min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi" if number else "NULL::DOUBLE AS lo, NULL::DOUBLE AS hi"}, {lo} AS lt, {hi} AS ht, {f"count(try_cast({c} AS TIMESTAMP))" if text else "0"} AS dates, avg(length({c}::VARCHAR)) AS len FROM m)"""


_TYPES_SQL = f"WITH m AS ({_MIXED_SQL}) " + " UNION ALL ".join(_type_sql(c, k) for c, k, _ in _MIXED)
_TEXTS = [c for c, k, _ in _MIXED if k == "text"]


@query("semantic_types", _TYPES_SQL)
def _(s, d):
    return pf.semantic_types(_mixed(s, d)).withColumn("avg_length", F.when(F.col("column").isin(_TEXTS), F.col("avg_length")))


@query("merged_profile", f"SELECT t.column, t.semantic_type, t.null_pct FROM ({_TYPES_SQL}) t")
def _(s, d):
    """The states of four parts of the table, merged, give the types of the whole."""
    rows = _mixed(s, d)
    part = F.pmod(F.hash("order_code"), F.lit(4))
    states = [cs.column_state(rows.where(part == i)) for i in range(4)]
    merged = states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3])
    return cs.typed_states(cs.merge_states(merged)).select("column", "semantic_type", "null_pct")


@query("filtered", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-06-30' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(s, d):
    got = pf.filtered(table(s, d, "orders"), {"o_orderdate": ("1996-01-01", "1996-06-30")}, {"o_totalprice": (1000.0, 200000.0)}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]})
    return got.select("o_orderkey")


@query("clean_numeric", """
SELECT p_partkey, round(p_retailprice, 2) AS price, round(-p_size::DOUBLE, 2) AS size FROM part""")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("price"), F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("size"))
    return rounded(pf.clean_numeric(p))


@query("text_percentages", r"""
WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '([-+]?\d+(?:[.,]\d+)?\s?%)', 1)) AS v FROM pages)
SELECT page_id, trim(v) AS value, count(*) AS n FROM f GROUP BY 1, 2""")
def _(s, d):
    m = text_metrics(table(s, d, "pages"), "page_id", "html").where("kind = 'percentage'")
    return m.groupBy("page_id", "value").agg(F.count("*").alias("n"))


@query("text_kpis", r"""
WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z][A-Za-z ]{2,49})\s*[:=]\s*([$€£]?\s?[-+]?\d[\d.,]*\s?%?)', 1)) AS l,
  unnest(regexp_extract_all(html, '([A-Za-z][A-Za-z ]{2,49})\s*[:=]\s*([$€£]?\s?[-+]?\d[\d.,]*\s?%?)', 2)) AS v FROM pages)
SELECT page_id, trim(l) AS label, trim(v) AS value, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def _(s, d):
    m = text_metrics(table(s, d, "pages"), "page_id", "html").where("kind = 'kpi'")
    return m.groupBy("page_id", "label", "value").agg(F.count("*").alias("n"))


@query("text_tables", r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
c AS (SELECT doc_id, line, list_filter(regexp_split_to_array(trim(t), '\t|\s{2,}|\s*\|\s*'), lambda x: x <> '') AS cells FROM l),
d AS (SELECT * FROM c WHERE len(cells) > 1), m AS (SELECT doc_id, arg_max(k, (n, k)) AS k FROM (SELECT doc_id, len(cells) AS k, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, line, len(cells) AS n_cells, array_to_string(cells, ' / ') AS cells FROM d JOIN m USING (doc_id) WHERE len(cells) = k""")
def _(s, d):
    got = text_table(table(s, d, "documents"), "doc_id", "text")
    return got.select("doc_id", F.col("line").cast("long").alias("line"), F.size("cells").cast("long").alias("n_cells"), F.array_join("cells", " / ").alias("cells"))


@query("series_insights", """
WITH d AS (SELECT ts AS t, value AS v FROM events WHERE ts IS NOT NULL AND value IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY t, v) AS i, count(*) OVER () AS n FROM d),
s AS (SELECT count(*) AS n, avg(v) AS m, stddev_pop(v) AS s, avg(v) FILTER (i <= 7) AS f7, avg(v) FILTER (i > n - 7) AS l7, stddev_pop(v) FILTER (i <= 30) AS f30, stddev_pop(v) FILTER (i > n - 30) AS l30 FROM o),
a AS (SELECT s.*, (SELECT count(*) FROM d WHERE abs(v - s.m) > 2 * s.s) AS far, (l7 - f7) / f7 * 100 AS p FROM s)
SELECT 'trend' AS kind, CASE WHEN abs(p) > 30 THEN 'high' ELSE 'medium' END AS severity, round(p, 4) AS value FROM a WHERE abs(p) > 10 AND n >= 7
UNION ALL SELECT 'anomaly', CASE WHEN far > n * 0.1 THEN 'high' ELSE 'low' END, far::DOUBLE FROM a WHERE far > 0
UNION ALL SELECT 'volatility', 'medium', round(l30 / f30 * 100 - 100, 4) FROM a WHERE n >= 30 AND l30 > 1.5 * f30""")
def _(s, d):
    return rounded(series_insights(table(s, d, "events"), "ts", "value"), 4)


@query("correlation_insights", """
SELECT 'l_quantity' AS var1, 'price2' AS var2, round(corr(l_quantity, l_extendedprice + l_quantity * 4000), 4) AS correlation, 'positive' AS direction FROM lineitem HAVING corr(l_quantity, l_extendedprice + l_quantity * 4000) >= 0.7""")
def _(s, d):
    t = table(s, d, "lineitem").select("l_quantity", "l_tax", (F.col("l_extendedprice") + F.col("l_quantity") * 4000).alias("price2"))
    return correlation_insights(correlation_pairs(t, ["l_quantity", "l_tax", "price2"]))


_HALF = """SELECT '{c}' AS metric, round(sum(s * i / k) / sum(i), 6) AS first, round(sum(s * (1 - i / k)) / sum(k - i), 6) AS second, max(n)::BIGINT AS n FROM (
  SELECT *, greatest(0, least(k, n // 2 - (u - k))) AS i FROM (SELECT *, sum(k) OVER (ORDER BY t) AS u, sum(k) OVER () AS n FROM (SELECT l_shipdate AS t, count(*) AS k, sum({c}) AS s FROM lineitem GROUP BY 1)))"""


@query("half_changes", " UNION ALL ".join(_HALF.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(s, d):
    return rounded(half_changes(table(s, d, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice", "l_discount"]), 6)


@query("top_value_share", " UNION ALL ".join(f"""
SELECT '{c}' AS column, (SELECT count({c}) FROM lineitem) AS n, (SELECT count(DISTINCT {c}) FROM lineitem) AS kinds, v::DOUBLE AS top, round(k / (SELECT count({c}) FROM lineitem) * 100, 6) AS top_pct
FROM (SELECT {c} AS v, count(*) AS k FROM lineitem GROUP BY 1 ORDER BY k DESC, v LIMIT 1)""" for c in ("l_quantity", "l_discount")))
def _(s, d):
    return rounded(top_value_share(table(s, d, "lineitem"), ["l_quantity", "l_discount"]), 6)


@query("top_fifth", """
WITH k AS (SELECT event_type AS v, count(*) AS k FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY k DESC, v) AS i, count(*) OVER () AS kinds, sum(k) OVER () AS n FROM k)
SELECT 'event_type' AS column, max(kinds) AS kinds, max(greatest(1, floor(kinds * 0.2)))::BIGINT AS top_n, round(sum(k) FILTER (i <= greatest(1, floor(kinds * 0.2))) / max(n) * 100, 6) AS top_pct FROM r""")
def _(s, d):
    return rounded(top_fifth(table(s, d, "events"), ["event_type"]), 6)


@query("mean_gaps", """
WITH m AS (SELECT o_orderpriority AS v, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT 'o_orderpriority' AS column, arg_max(v, m) AS best, arg_min(v, m) AS worst, round(max(m) / min(m), 6) AS gap FROM m""")
def _(s, d):
    return rounded(mean_gaps(table(s, d, "orders"), ["o_orderpriority"], "o_totalprice"), 6)


@query("profile_score", """
WITH c AS (SELECT count(*) AS n, count(DISTINCT c_acctbal) / count(*) * 100 AS u, count(DISTINCT c_nationkey) AS k FROM customer)
SELECT 2 * n AS rows, 3::BIGINT AS columns, round(100 - 10 - 10 - CASE WHEN u / 2 > 95 THEN 3 ELSE 0 END, 1)::DOUBLE AS quality_score, 2::BIGINT AS n_issues, CASE WHEN u / 2 > 95 THEN 1 ELSE 0 END::BIGINT AS n_recommendations FROM c""")
def _(s, d):
    t = table(s, d, "customer").select("c_acctbal", "c_mktsegment", F.lit("x").alias("only"))
    got = pf.profile_score(t.unionByName(t))
    return got.select("rows", "columns", "quality_score", F.size("issues").cast("long").alias("n_issues"), F.size("recommendations").cast("long").alias("n_recommendations"))


@query("column_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS column, '{k}' AS semantic_type, count({c}) AS non_null, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_pct, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*) * 100, 2) AS unique_pct,
  {f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, round(median({c})::DOUBLE, 4) AS median, round(stddev_samp({c}), 4) AS std" if k != "categorical" else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std"} FROM part""" for c, k in (("p_brand", "categorical"), ("p_size", "numeric"), ("p_retailprice", "currency"))))
def _(s, d):
    return pf.column_profile(table(s, d, "part").select("p_brand", "p_size", "p_retailprice")).drop("sample_values")


@query("dataset_summary", """
SELECT count(*) AS rows, 4::BIGINT AS columns, 'o_custkey, o_totalprice' AS numeric_columns, 'o_orderstatus' AS categorical_columns, 'o_orderdate' AS datetime_columns, 0::BIGINT AS total_missing, 0.0::DOUBLE AS total_missing_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_totalprice, o_orderstatus, o_orderdate FROM orders)) AS duplicate_rows FROM orders""")
def _(s, d):
    return pf.dataset_summary(table(s, d, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"))


@query("summary_insights", """
WITH c AS (SELECT count(*) AS n, count(DISTINCT o_orderdate) AS u, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days, skewness(o_totalprice) AS sk,
  quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders), f AS (SELECT count(*) AS k FROM orders, c WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)),
d AS (SELECT count(*) - count(DISTINCT (o_totalprice, o_orderdate)) AS k FROM orders)
SELECT 'large' AS kind, NULL::VARCHAR AS column, n::DOUBLE AS value FROM c WHERE n > 100000 UNION ALL SELECT 'small', NULL, n FROM c WHERE n < 100 UNION ALL SELECT 'duplicates', NULL, k FROM d WHERE k > 0
UNION ALL SELECT 'outliers', 'o_totalprice', round(k / n * 100, 4) FROM c, f WHERE k / n > 0.05 UNION ALL SELECT 'skewed', 'o_totalprice', round(sk, 4) FROM c WHERE abs(sk) > 2
UNION ALL SELECT 'long', 'o_orderdate', round(days / 365, 4) FROM c WHERE days > 365 UNION ALL SELECT 'short', 'o_orderdate', days FROM c WHERE days < 7""")
def _(s, d):
    return rounded(pf.summary_insights(table(s, d, "orders").select("o_totalprice", "o_orderdate")), 4)


@query("segment_insights", """
WITH g AS (SELECT c_mktsegment AS s, sum(c_acctbal) AS t FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY t DESC, s) AS k, avg(t) OVER () AS m FROM g)
SELECT count(*) AS segments, round(sum(t) FILTER (k <= 3) / sum(t) * 100, 4) AS top3_share_pct, count(*) FILTER (t < 0.3 * m) AS weak_segments FROM r""")
def _(s, d):
    return rounded(segment_insights(table(s, d, "customer"), "c_mktsegment", "c_acctbal"), 4)


@query("full_scan")
def _(s, d):
    return ranked_findings(full_scan(table(s, d, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]))
