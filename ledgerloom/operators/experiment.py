"""Experiments: Welch tests between variants, sample sizes, sequential looks, conversion rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dist import normal_quantile, normal_two_sided, t_critical, t_p_value
from ledgerloom.functions.semantics import need, num, ratio


def _moments(df: DataFrame, variant: str, metric: str) -> DataFrame:
    need(df, variant, metric)
    rows = df.select(F.col(variant).cast("string").alias("variant"), num(metric).alias("v")).dropna()
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))


def _against(moments: DataFrame, control: str, confidence: float) -> DataFrame:
    """Every other variant (b) beside the control (a), with Welch's test from counts, means and variances alone."""
    side = lambda d, x: d.select(*[F.col(c).alias(f"{c}_{x}") for c in ("variant", "n", "m", "s2")])
    a = F.broadcast(side(moments.where(F.col("variant") == control), "a"))  # one row
    p = side(moments.where(F.col("variant") != control), "b").crossJoin(a)
    ea, eb = ratio(F.col("s2_a"), F.col("n_a")), ratio(F.col("s2_b"), F.col("n_b"))
    diff = F.col("m_b") - F.col("m_a")
    df = ratio((ea + eb) * (ea + eb), ratio(ea * ea, F.col("n_a") - 1) + ratio(eb * eb, F.col("n_b") - 1))
    pooled = F.sqrt(ratio((F.col("n_a") - 1) * F.col("s2_a") + (F.col("n_b") - 1) * F.col("s2_b"), F.col("n_a") + F.col("n_b") - 2))
    p = p.withColumns({"t_statistic": ratio(diff, F.sqrt(ea + eb)), "dof": df, "lift_percentage": F.coalesce(ratio(diff, F.col("m_a")) * 100, F.lit(0.0)), "cohens_d": F.coalesce(ratio(diff, pooled), F.lit(0.0))})
    p = p.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("dof")))
    p = p.withColumn("is_significant", F.coalesce(F.col("p_value") < 1 - confidence, F.lit(False)))
    level = F.lit(1 - (1 - confidence) / 2)
    for x, e in (("a", ea), ("b", eb)):
        reach = t_critical(level, F.col(f"n_{x}") - 1) * F.sqrt(e)
        p = p.withColumns({f"variant_{x}_ci_low": F.col(f"m_{x}") - reach, f"variant_{x}_ci_high": F.col(f"m_{x}") + reach})
    return p


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def _recommendation() -> Column:
    won, lift = F.col("is_significant"), F.col("lift_percentage")
    return (
        F.when(won & (lift > 0), F.concat(F.lit("Implement "), F.col("variant_b")))
        .when(won, F.concat(F.lit("Keep "), F.col("variant_a")))
        .otherwise(F.lit("No significant difference; collect more data"))
    )


def ab_test(df: DataFrame, variant: str, metric: str, a: str, b: str, confidence: float = 0.95) -> DataFrame:
    """One row: names, counts, means and standard deviations of both variants, lift, Welch's t and p value, Cohen's d with
    its label, both t confidence intervals, and a recommendation."""
    m = _moments(df, variant, metric).where(F.col("variant").isin(a, b))
    p = _against(m, a, confidence)
    return p.select(
        F.col("variant_a").alias("variant_a_name"), F.col("variant_b").alias("variant_b_name"), F.col("n_a").alias("variant_a_count"), F.col("n_b").alias("variant_b_count"),
        F.col("m_a").alias("variant_a_mean"), F.col("m_b").alias("variant_b_mean"), F.sqrt("s2_a").alias("variant_a_std"), F.sqrt("s2_b").alias("variant_b_std"),
        "lift_percentage", "t_statistic", "p_value", F.lit(confidence).alias("confidence_level"), "is_significant", "cohens_d", effect_label(F.col("cohens_d")).alias("effect_size"),
        "variant_a_ci_low", "variant_a_ci_high", "variant_b_ci_low", "variant_b_ci_high", _recommendation().alias("recommendation"),
    )


def multi_variant_test(df: DataFrame, variant: str, metric: str, control: str, confidence: float = 0.95) -> DataFrame:
    """Each other variant against the control, from one aggregation: variant, sample_size, mean, lift_pct, p_value,
    is_significant, effect_size, recommendation."""
    p = _against(_moments(df, variant, metric), control, confidence)
    return p.select(F.col("variant_b").alias("variant"), F.col("n_b").alias("sample_size"), F.col("m_b").alias("mean"), F.col("lift_percentage").alias("lift_pct"), "p_value", "is_significant", F.col("cohens_d").alias("effect_size"), _recommendation().alias("recommendation"), "t_statistic", "dof")


def sequential_test(df: DataFrame, variant: str, metric: str, a: str, b: str, alpha: float = 0.05, looks: int = 10) -> DataFrame:
    """One row: whether a winner or loser is certain at ``alpha`` shared over ``looks``, else that the test goes on."""
    r = ab_test(df, variant, metric, a, b)
    sure = F.coalesce(F.col("p_value") < alpha / looks, F.lit(False))
    return r.select(
        (sure & (F.col("lift_percentage") > 0)).alias("can_stop_for_winner"), (sure & (F.col("lift_percentage") < 0)).alias("can_stop_for_loser"), (~sure).alias("should_continue"),
        F.col("p_value").alias("current_p_value"), F.lit(alpha / looks).alias("adjusted_alpha"), (F.col("variant_a_count") + F.col("variant_b_count")).alias("current_sample_size"),
    )


def sample_size(baseline: float, minimum_effect: float, confidence: float = 0.95, power: float = 0.8) -> int:
    """Rows a variant for a relative effect on a rate, by the two-proportion z formula."""
    p1, p2 = baseline, baseline * (1 + minimum_effect)
    za, zb = normal_quantile(1 - (1 - confidence) / 2), normal_quantile(power)
    mid = (p1 + p2) / 2
    return math.ceil((za * math.sqrt(2 * mid * (1 - mid)) + zb * math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))) ** 2 / (p2 - p1) ** 2)


def conversion_rate_test(conversions_a: int, total_a: int, conversions_b: int, total_b: int, confidence: float = 0.95) -> dict:
    """Pooled two-proportion z test of four counts."""
    ra, rb = (conversions_a / total_a if total_a else 0.0), (conversions_b / total_b if total_b else 0.0)
    pooled = (conversions_a + conversions_b) / (total_a + total_b) if total_a + total_b else 0.0
    se = math.sqrt(pooled * (1 - pooled) * (1 / total_a + 1 / total_b)) if total_a and total_b else 0.0
    z = (rb - ra) / se if se else 0.0
    p = normal_two_sided(z)
    return {"conversion_rate_a": ra, "conversion_rate_b": rb, "lift_percentage": (rb - ra) / ra * 100 if ra else 0.0, "z_statistic": z, "p_value": p, "is_significant": p < 1 - confidence, "confidence_level": confidence, "conversions_a": conversions_a, "total_a": total_a, "conversions_b": conversions_b, "total_b": total_b}


def conversion_rates(df: DataFrame, variant: str, converted: str, a: str, b: str, confidence: float = 0.95) -> DataFrame:
    """The same test on rows: one aggregation, one row."""
    from ledgerloom.functions.dist import z_p_value

    need(df, variant, converted)
    v = F.col(variant).cast("string")
    k = lambda x: F.coalesce(F.sum(F.when(v == x, num(converted))), F.lit(0.0))
    got = df.agg(k(a).alias("conversions_a"), F.count_if(v == a).alias("total_a"), k(b).alias("conversions_b"), F.count_if(v == b).alias("total_b"))
    ra, rb = ratio(F.col("conversions_a"), F.col("total_a")), ratio(F.col("conversions_b"), F.col("total_b"))
    pooled = ratio(F.col("conversions_a") + F.col("conversions_b"), F.col("total_a") + F.col("total_b"))
    se = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), F.col("total_a")) + ratio(F.lit(1), F.col("total_b"))))
    got = got.withColumns({"conversion_rate_a": ra, "conversion_rate_b": rb, "lift_percentage": ratio(rb - ra, ra) * 100, "z_statistic": F.coalesce(ratio(rb - ra, se), F.lit(0.0))})
    got = got.withColumn("p_value", z_p_value(F.col("z_statistic")))
    return got.withColumn("is_significant", F.col("p_value") < 1 - confidence)
