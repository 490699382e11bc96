"""Queries on experiments, association and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import anomaly as an
from ledgerloom.operators import association as ass
from ledgerloom.operators import experiment as ex
from ledgerloom.operators import relations as rel
from ledgerloom.plans.tails import beta_sql
from ledgerloom.plans.registry import query, rounded, table


def _ab(s, d, k=2):
    e = table(s, d, "events")
    return e.select(F.concat(F.lit("v"), (F.col("user_id") % k).cast("string")).alias("variant"), "value", (F.col("event_type") == "purchase").cast("int").alias("bought"))


def _welch(k: int) -> str:
    return f"""WITH g AS (SELECT 'v' || (user_id % {k}) AS variant, count(*) AS n, avg(value) AS m, var_samp(value) AS s2 FROM events WHERE value IS NOT NULL GROUP BY 1),
w AS (SELECT b.variant, b.n, b.m, a.n AS na, a.m AS ma, a.s2 AS sa, b.s2 AS sb, (b.m - a.m) / a.m * 100 AS lift, (b.m - a.m) / sqrt(a.s2 / a.n + b.s2 / b.n) AS t,
  power(a.s2 / a.n + b.s2 / b.n, 2) / (power(a.s2 / a.n, 2) / (a.n - 1) + power(b.s2 / b.n, 2) / (b.n - 1)) AS dof,
  (b.m - a.m) / sqrt(((a.n - 1) * a.s2 + (b.n - 1) * b.s2) / (a.n + b.n - 2)) AS dd FROM g b JOIN g a ON a.variant = 'v0' AND b.variant <> 'v0')"""


def _tested(k: int) -> str:
    """The variants with Welch's two-sided p value: I_x(dof / 2, 1 / 2) at x = dof / (dof + t^2)."""
    rows = beta_sql("(SELECT *, dof / 2 AS a, 0.5 AS b, dof / (dof + t * t) AS x FROM w)", "variant, n, m, na, ma, sa, sb, lift, t, dof, dd")
    return _welch(k) + f", pv AS ({rows}), told AS (SELECT *, p < 0.05 AS won, CASE WHEN p < 0.05 AND lift > 0 THEN 'Implement ' || variant WHEN p < 0.05 THEN 'Keep v0' ELSE 'No significant difference; collect more data' END AS advice FROM pv)"


_CI = ["variant_a_ci_low", "variant_a_ci_high", "variant_b_ci_low", "variant_b_ci_high"]


@query("ab_test", _tested(2) + """
SELECT 'v0' AS variant_a_name, variant AS variant_b_name, na AS variant_a_count, n AS variant_b_count, round(ma, 5) AS variant_a_mean, round(m, 5) AS variant_b_mean,
  round(sqrt(sa), 5) AS variant_a_std, round(sqrt(sb), 5) AS variant_b_std, round(lift, 5) AS lift_percentage, round(t, 5) AS t_statistic, round(p, 5) AS p_value, 0.95::DOUBLE AS confidence_level, won AS is_significant, round(dd, 5) AS cohens_d,
  CASE WHEN abs(dd) < 0.2 THEN 'negligible' WHEN abs(dd) < 0.5 THEN 'small' WHEN abs(dd) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size, advice AS recommendation FROM told""")
def _(s, d):
    return rounded(ex.ab_test(_ab(s, d), "variant", "value", "v0", "v1").drop(*_CI), 5)


@query("ab_test_full")
def _(s, d):
    return ex.ab_test(_ab(s, d), "variant", "value", "v0", "v1")


@query("multi_variant", _tested(4) + " SELECT variant, n AS sample_size, round(m, 5) AS mean, round(lift, 5) AS lift_pct, round(p, 5) AS p_value, won AS is_significant, advice AS recommendation, round(dd, 5) AS effect_size, round(t, 5) AS t_statistic, round(dof, 3) AS dof FROM told")
def _(s, d):
    r = ex.multi_variant_test(_ab(s, d, 4), "variant", "value", "v0")
    return rounded(r.withColumn("dof", F.round("dof", 3)), 5)


@query("sequential_test")
def _(s, d):
    return ex.sequential_test(_ab(s, d), "variant", "value", "v0", "v1")


@query("conversion_rates", """
WITH g AS (SELECT count(*) FILTER (user_id % 2 = 0) AS na, count(*) FILTER (user_id % 2 = 1) AS nb, CAST(count(*) FILTER (user_id % 2 = 0 AND event_type = 'purchase') AS DOUBLE) AS ca,
  CAST(count(*) FILTER (user_id % 2 = 1 AND event_type = 'purchase') AS DOUBLE) AS cb FROM events), h AS (SELECT *, ca / na AS ra, cb / nb AS rb, (ca + cb) / (na + nb) AS p FROM g)
SELECT ca AS conversions_a, na AS total_a, cb AS conversions_b, nb AS total_b, round(ra, 6) AS conversion_rate_a, round(rb, 6) AS conversion_rate_b, round((rb - ra) / ra * 100, 6) AS lift_percentage,
  round((rb - ra) / sqrt(p * (1 - p) * (1 / na + 1 / nb)), 6) AS z_statistic FROM h""")
def _(s, d):
    return rounded(ex.conversion_rates(_ab(s, d), "variant", "bought", "v0", "v1").drop("p_value", "is_significant"), 6)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


def _corr_sql(table_: str = "lineitem") -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 4) AS correlation FROM {table_}" for a, b in _PAIRS)


@query("correlation_pearson", _corr_sql())
def _(s, d):
    return ass.correlation_pairs(table(s, d, "lineitem"), _NUM)


@query("correlation_spearman", " UNION ALL ".join(f"""
SELECT '{a}' AS var1, '{b}' AS var2, round(corr(ra, rb), 4) AS correlation FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM lineitem)""" for a, b in _PAIRS))
def _(s, d):
    return ass.correlation_pairs(table(s, d, "lineitem"), _NUM, "spearman")


def _kendall_sql(many: str, few: str) -> str:
    """tau-b of a column and one of few values: at each value of the first, the rows before it of each value of the second."""
    return f"""(WITH pts AS (SELECT {many} AS a, {few} AS b, count(*) AS n FROM lineitem WHERE {many} IS NOT NULL AND {few} IS NOT NULL GROUP BY 1, 2),
  lv AS (SELECT DISTINCT b AS l FROM pts),
  grid AS (SELECT x.a, l, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT a FROM pts) x CROSS JOIN lv LEFT JOIN pts ON pts.a = x.a AND pts.b = l GROUP BY 1, 2),
  cum AS (SELECT a, l, n, coalesce(sum(n) OVER (PARTITION BY l ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM grid),
  sides AS (SELECT n, coalesce(sum(c) OVER (PARTITION BY a ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    coalesce(sum(c) OVER (PARTITION BY a ORDER BY l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS above FROM cum),
  s AS (SELECT sum(n * (below - above))::DOUBLE AS s FROM sides),
  tie AS (SELECT sum(n * (n - 1.0) / 2)::DOUBLE AS ta FROM (SELECT sum(n)::DOUBLE AS n FROM pts GROUP BY a)), tib AS (SELECT sum(n * (n - 1.0) / 2)::DOUBLE AS tb FROM (SELECT sum(n)::DOUBLE AS n FROM pts GROUP BY b)),
  p AS (SELECT sum(n)::DOUBLE * (sum(n)::DOUBLE - 1) / 2 AS p FROM pts)
  SELECT round(s / sqrt((p - ta) * (p - tb)), 4) FROM s, tie, tib, p)"""


@query("correlation_kendall", " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, {_kendall_sql('l_extendedprice', b if a == 'l_extendedprice' else a) if 'l_extendedprice' in (a, b) else _kendall_sql(a, b)} AS correlation"
    for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def _(s, d):
    return ass.correlation_pairs(table(s, d, "lineitem"), _NUM, "kendall")


@query("strong_correlations", f"""
SELECT *, CASE WHEN abs(correlation) >= 0.9 THEN 'very strong' WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({_corr_sql()}) WHERE abs(correlation) >= 0.001""")
def _(s, d):
    return ass.strong_correlations(table(s, d, "lineitem"), 0.001, columns=_NUM)


_LABEL = "CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' WHEN abs(r) >= 0.2 THEN 'Weak' END"


@query("correlation_with_target", f"""
WITH c AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, corr({c}, l_extendedprice) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))})
SELECT variable, round(r, 6) AS correlation, round(abs(r), 6) AS abs_correlation, coalesce({_LABEL} || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END || ' relationship', 'Very weak or no relationship') AS interpretation FROM c""")
def _(s, d):
    return rounded(ass.correlation_with_target(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 6)


@query("crosstab", """
SELECT coalesce(l_returnflag, 'Total') AS row, coalesce(l_linestatus, 'Total') AS col, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _(s, d):
    return ass.cross_tabulation(table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("crosstab_mean", """
WITH c AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT coalesce(l_returnflag, 'Total') AS row, coalesce(l_linestatus, 'Total') AS col, round(sum(v), 4) AS value FROM c GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _(s, d):
    return rounded(ass.cross_tabulation(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "mean"), 4)


@query("crosstab_normalized", """
WITH c AS (SELECT l_returnflag AS row, l_linestatus AS col, count(*) AS v FROM lineitem GROUP BY 1, 2) SELECT row, col, round(v / sum(v) OVER (PARTITION BY row), 6) AS value FROM c""")
def _(s, d):
    return rounded(ass.cross_tabulation(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", normalize="index"), 6)


@query("group_comparison", """
WITH o AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem),
g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, median(l_extendedprice) AS md FROM lineitem GROUP BY 1)
SELECT l_returnflag, n AS count, round(a, 3) AS mean, round(sd, 3) AS std, round(lo, 3) AS min, round(hi, 3) AS max, round(md, 3) AS median, round(a - m, 3) AS diff_from_overall,
  round((a - m) / m * 100, 2) AS diff_pct, round(sd / a, 3) AS cv, round((a - m) / s, 3) AS effect_size FROM g, o""")
def _(s, d):
    return rounded(ass.group_comparison(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice"), 3)


@query("outliers_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), r AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
SELECT 'value' AS column, 'iqr' AS method, 1.5::DOUBLE AS threshold, count(value) AS total_values, count(*) FILTER (value < lo OR value > hi) AS outlier_count,
  round(count(*) FILTER (value < lo OR value > hi) / count(value) * 100, 2) AS outlier_pct, round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound FROM events, r""")
def _(s, d):
    return ass.detect_outliers(table(s, d, "events"), "value")


@query("outliers_zscore", """
WITH r AS (SELECT avg(value) - 1.5 * stddev_samp(value) AS lo, avg(value) + 1.5 * stddev_samp(value) AS hi FROM events)
SELECT 'value' AS column, 'zscore' AS method, 1.5::DOUBLE AS threshold, count(value) AS total_values, count(*) FILTER (value < lo OR value > hi) AS outlier_count,
  round(count(*) FILTER (value < lo OR value > hi) / count(value) * 100, 2) AS outlier_pct, round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound FROM events, r""")
def _(s, d):
    return ass.detect_outliers(table(s, d, "events"), "value", "zscore")


@query("outlier_rows", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def _(s, d):
    return ass.outlier_rows(table(s, d, "events"), "value").select("event_id", "value")


_CHI = """WITH c AS (SELECT event_type AS x, 'g' || (user_id % 4) AS y, CAST(count(*) AS DOUBLE) AS o FROM events GROUP BY 1, 2),
e AS (SELECT *, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e FROM c)"""


@query("cramers_v", _CHI + """
SELECT CAST(sum(o) AS BIGINT) AS n, round(sum(o * o / e) - sum(o), 5) AS chi_square, round(sqrt((sum(o * o / e) - sum(o)) / (sum(o) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))), 6) AS cramers_v FROM e""")
def _(s, d):
    e = table(s, d, "events").withColumn("g", F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")))
    r = ass.cramers_v(e, "event_type", "g")
    return r.select("n", F.round("chi_square", 5).alias("chi_square"), F.round("cramers_v", 6).alias("cramers_v"))


@query("cramers_v_corrected", """
WITH b AS (SELECT CASE WHEN event_type = 'purchase' THEN 'a' ELSE 'b' END AS x, CASE WHEN user_id % 2 = 0 THEN 'c' ELSE 'd' END AS y FROM events),
c AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS o FROM b GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e FROM c),
k AS (SELECT sum(o) AS n, sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS q FROM e)
SELECT CAST(n AS BIGINT) AS n, round(q, 5) AS chi_square, round(sqrt(q / n), 6) AS cramers_v FROM k""")
def _(s, d):
    e = table(s, d, "events").select(F.when(F.col("event_type") == "purchase", "a").otherwise("b").alias("x"), F.when(F.col("user_id") % 2 == 0, "c").otherwise("d").alias("y"))
    return ass.cramers_v(e, "x", "y", True).select("n", F.round("chi_square", 5).alias("chi_square"), F.round("cramers_v", 6).alias("cramers_v"))


@query("eta_squared", """
WITH g AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, var_pop(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1),
t AS (SELECT *, sum(n) OVER () AS na, sum(n * m) OVER () / sum(n) OVER () AS mm FROM g), s AS (SELECT count(*) AS k, any_value(na) AS n, sum(n * power(m - mm, 2)) AS b, sum(n * v) AS w FROM t)
{eta}""".format(eta="SELECT groups, CAST(n AS BIGINT) AS n, round(f, 5) AS f_statistic, round(p, 8) AS p_value, round(eta, 6) AS eta_squared FROM (" + beta_sql(
    "(SELECT *, (n - groups) / 2 AS a, (groups - 1) / 2 AS b, (n - groups) / (n - groups + (groups - 1) * f) AS x FROM (SELECT k AS groups, n, (b / (k - 1)) / (w / (n - k)) AS f, b / (b + w) AS eta FROM s))", "groups, n, f, eta") + ")"))
def _(s, d):
    r = ass.eta_squared(table(s, d, "events"), "event_type", "value")
    return r.select("groups", "n", F.round("f_statistic", 5).alias("f_statistic"), F.round("p_value", 8).alias("p_value"), F.round("eta_squared", 6).alias("eta_squared"))


def _eta(c: str) -> str:
    return f"""SELECT '{c}' AS feature, 'eta_squared' AS method, round(b / (b + w), 4) AS strength, CASE WHEN b / (b + w) >= 0.14 THEN 'Large effect size' WHEN b / (b + w) >= 0.06 THEN 'Medium effect size'
  WHEN b / (b + w) >= 0.01 THEN 'Small effect size' ELSE 'Negligible effect' END AS interpretation FROM (SELECT sum(n * power(m - (SELECT avg(l_extendedprice) FROM lineitem), 2)) AS b, sum(n * v) AS w
  FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY {c}))"""


def _pearson(c: str) -> str:
    return f"""SELECT '{c}' AS feature, 'pearson_correlation' AS method, round(r, 4) AS strength, coalesce({_LABEL} || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END || ' relationship', 'Very weak or no relationship') AS interpretation
  FROM (SELECT corr({c}, l_extendedprice) AS r FROM lineitem)"""


@query("multi_variable_analysis", " UNION ALL ".join([_pearson("l_quantity"), _pearson("l_discount"), _eta("l_returnflag"), _eta("l_linestatus")]))
def _(s, d):
    return ass.multi_variable_analysis(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"])


_REL = """rel AS (SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
  CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size, CASE WHEN l_returnflag = 'R' OR (l_quantity > 40 AND l_tax < 0.04) THEN 'yes' WHEN l_discount > 0.01 THEN 'no' END AS mark FROM lineitem)"""
_REL_NUM, _REL_CAT = ["l_quantity", "l_extendedprice", "l_discount"], ["l_linenumber", "l_tax", "l_returnflag", "l_linestatus", "size", "mark"]


def _rel_table(s, d):
    q = F.col("l_quantity")
    mark = F.when((F.col("l_returnflag") == "R") | (q > 40) & (F.col("l_tax") < 0.04), "yes").when(F.col("l_discount") > 0.01, "no")
    return table(s, d, "lineitem").select("l_linenumber", *_REL_NUM, "l_tax", "l_returnflag", "l_linestatus", F.when(q > 25, "big").otherwise("small").alias("size"), mark.alias("mark"))


def _rel_number(a: str, b: str) -> str:
    return f"SELECT 'numeric' AS kind, '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS value, NULL::DOUBLE AS f_statistic, NULL::DOUBLE AS p_value, NULL AS strength FROM rel"


def _rel_category(a: str, b: str) -> str:
    return f"""SELECT 'categorical', '{a}', '{b}', v, NULL, NULL, CASE WHEN v > 0.5 THEN 'Strong' WHEN v > 0.3 THEN 'Moderate' ELSE 'Weak' END FROM (
  SELECT sqrt(CASE WHEN count(DISTINCT x) = 2 AND count(DISTINCT y) = 2 THEN sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) ELSE sum(power(o - e, 2) / e) END / (sum(o) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))) AS v
  FROM (SELECT *, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e FROM (
    SELECT x, y, coalesce(o, 0)::DOUBLE AS o FROM (SELECT DISTINCT {a} AS x FROM rel WHERE {a} IS NOT NULL AND {b} IS NOT NULL) CROSS JOIN (SELECT DISTINCT {b} AS y FROM rel WHERE {a} IS NOT NULL AND {b} IS NOT NULL)
    LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*) AS o FROM rel GROUP BY 1, 2) USING (x, y)))) WHERE v > 0.1"""


def _rel_mixed(v: str, g: str) -> str:
    return f"""SELECT 'mixed', '{v}', '{g}', eta, f, p, CASE WHEN eta > 0.14 THEN 'Large' WHEN eta > 0.06 THEN 'Medium' WHEN eta > 0.01 THEN 'Small' ELSE 'Very small' END FROM (
  {beta_sql(f"""(SELECT *, (n - k) / 2.0 AS a, (k - 1) / 2.0 AS b, (n - k) / (n - k + (k - 1) * f) AS x FROM (
    SELECT count(*)::DOUBLE AS k, sum(n) AS n, (sum(n * power(m - mean, 2)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f, sum(n * power(m - am, 2)) / any_value(total) AS eta
    FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS mean, (SELECT avg({v}) FROM rel) AS am, (SELECT count({v}) * var_pop({v}) FROM rel) AS total
      FROM (SELECT count({v})::DOUBLE AS n, avg({v}) AS m, var_pop({v}) AS s FROM rel WHERE {g} IS NOT NULL GROUP BY {g}))))""", "eta, f")}) WHERE p < 0.05"""


_REL_ROWS = "WITH " + _REL + ", found AS (" + " UNION ALL ".join(
    [_rel_number(a, b) for i, a in enumerate(_REL_NUM) for b in _REL_NUM[i + 1 :]] + [_rel_category(a, b) for i, a in enumerate(_REL_CAT) for b in _REL_CAT[i + 1 :]] + [_rel_mixed(v, g) for v in _REL_NUM for g in _REL_CAT]) + ")"


@query("find_all_relationships", _REL_ROWS + """
SELECT kind, var1, var2, round(value, 6) AS value, round(f_statistic, 4) AS f_statistic, round(p_value, 8) AS p_value, strength, round(abs(value), 6) AS abs_value,
  CASE WHEN kind = 'numeric' THEN CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END END AS type, abs(value) >= 0.3 OR kind = 'mixed' AS is_strong FROM found""")
def _(s, d):
    got = rel.find_all_relationships(_rel_table(s, d))
    digits = {"value": 6, "f_statistic": 4, "p_value": 8, "abs_value": 6}
    return got.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("relationship_summary", _REL_ROWS + f"""
SELECT 9::BIGINT AS total_columns, {len(_REL_NUM)}::BIGINT AS numeric_columns, {len(_REL_CAT)}::BIGINT AS categorical_columns, count(*) FILTER (kind = 'numeric' AND abs(value) > 0.3) AS numeric_correlations_found,
  count(*) FILTER (kind = 'categorical') AS categorical_associations_found, count(*) FILTER (kind = 'mixed') AS numeric_categorical_relationships FROM found""")
def _(s, d):
    return rel.mixed_summary(_rel_table(s, d))


@query("value_anomalies", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events), a AS (SELECT event_id, value AS v, m, sd, abs(value - m) / sd AS z, abs((value - m) / m * 100) AS d FROM events, s WHERE value IS NOT NULL)
SELECT 'value' AS anomaly_type, CASE WHEN d > 100 THEN 'critical' WHEN d > 50 THEN 'high' WHEN d > 30 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN v > m THEN 'Unusual Spike in value' ELSE 'Unusual Drop in value' END AS title, round(v, 4) AS detected_value, round(m, 4) AS expected_value, round(d, 4) AS deviation_pct, CAST(event_id AS VARCHAR) AS row
FROM a WHERE z > 2.5 AND d >= 20""")
def _(s, d):
    a = an.value_anomalies(table(s, d, "events"), ["value"], key="event_id")
    return rounded(a.select("anomaly_type", "severity", "title", "detected_value", "expected_value", "deviation_pct", F.col("context")["row"].alias("row")), 4)


@query("rare_combinations", """
WITH b AS (SELECT event_type, 'h' || hour(ts) AS h FROM events), c AS (SELECT event_type AS value1, h AS value2, count(*) AS count FROM b GROUP BY 1, 2),
f AS (SELECT *, count / sum(count) OVER () AS frequency, row_number() OVER (ORDER BY count, value1, value2) AS k FROM c)
SELECT 'event_type' AS col1, 'h' AS col2, value1, value2, count, round(frequency, 8) AS frequency FROM f WHERE frequency < 0.01 AND k <= 3""")
def _(s, d):
    e = table(s, d, "events").select("event_type", F.concat(F.lit("h"), F.hour("ts").cast("string")).alias("h"))
    return rounded(an.rare_combinations(e, ["event_type", "h"], max_values=30), 8)


@query("odd_category_means", """
WITH o AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem),
g AS (SELECT 'q' || CAST(l_quantity AS INT) AS c, count(*) AS n, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1)
SELECT 'q' AS category_column, c AS category_value, 'l_extendedprice' AS numeric_column, n AS count, round(a, 4) AS mean, round(m, 4) AS overall_mean, round(abs(a - m) / (s / sqrt(n)), 4) AS z,
  round(abs((a - m) / m) * 100, 4) AS deviation_pct FROM g, o WHERE n >= 5 AND abs(a - m) / (s / sqrt(n)) > 2.5 AND abs((a - m) / m) * 100 > 5""")
def _(s, d):
    e = table(s, d, "lineitem").select(F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("q"), "l_extendedprice")
    return rounded(an.odd_category_means(e, ["q"], ["l_extendedprice"], min_deviation_pct=5), 4)


@query("sequence_anomalies", """
WITH o AS (SELECT value AS v, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS i FROM events WHERE value IS NOT NULL), a AS (
  SELECT avg(v) FILTER (i <= 7) AS r, avg(v) FILTER (i BETWEEN 8 AND 14) AS p, avg(v) FILTER (i BETWEEN 15 AND 21) AS o FROM o)
SELECT 'value' AS metric, round(r, 4) AS recent_avg, round(p, 4) AS previous_avg, round((r - p) / abs(p) * 100, 4) AS change_pct,
  CASE WHEN abs((r - p) / abs(p) * 100) > 100 THEN 'critical' WHEN abs((r - p) / abs(p) * 100) > 50 THEN 'high' ELSE 'medium' END AS severity FROM a WHERE abs((r - p) / abs(p) * 100) >= 1""")
def _(s, d):
    return rounded(an.sequence_anomalies(table(s, d, "events"), "ts", ["value"], min_change_pct=1, ties=["event_id"]).select("metric", "recent_avg", "previous_avg", "change_pct", "severity"), 4)


@query("anomalies_prioritized")
def _(s, d):
    e = table(s, d, "events").withColumn("h", F.concat(F.lit("h"), F.hour("ts").cast("string")))
    return an.prioritized(an.unique_anomalies(an.all_anomalies(e, ["value"], ["event_type", "h"], "ts", "medium", "event_id", ["event_id"]))).drop("context")
