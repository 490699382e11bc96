"""Plain-language readings of aggregated results: rules on a few figures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import micros, need, num, numbered, ratio


@dataclass
class Reading:
    summary: str
    findings: list[str] = field(default_factory=list)
    recommendations: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


#: Least figure and what it is called, from good to bad.
ROAS_STEPS, CTR_STEPS, CVR_STEPS = ((4, "excellent"), (2, "good"), (1, "break-even")), ((3, "strong"), (1, "average")), ((3, "strong"), (1, "average"))


def _step(v: float, steps: tuple, rest: str) -> str:
    return next((name for least, name in steps if v >= least), rest)


def read_ab_test(lift: float, p_value: float, n_a: int, n_b: int, confidence: float = 0.95) -> Reading:
    sure = p_value < 1 - confidence
    r = Reading(f"B {'beats' if lift > 0 else 'trails'} A by {abs(lift):.1f}%" if sure else "No significant difference")
    r.findings.append(f"p = {p_value:.4f}")
    if sure and lift > 10:
        r.recommendations.append("Implement B")
    elif sure and lift > 0:
        r.recommendations.append("B is better by little; weigh its cost")
    elif sure:
        r.recommendations.append("Keep A")
    else:
        r.recommendations.append("Collect more data")
    if min(n_a, n_b) < 1000:
        r.warnings.append("Under 1,000 rows in a variant")
    return r


def read_retention(avg_by_index: dict[int, float], cohorts: int, customers: int) -> Reading:
    r = Reading(f"{cohorts} cohorts, {customers} customers")
    first = avg_by_index.get(1)
    if first is not None:
        r.findings.append(f"{first:.1f}% come back after one period")
        if first < 20:
            r.warnings.append("Most customers don't come back; look at onboarding")
        elif first < 50:
            r.recommendations.append("Engage customers soon after the first purchase")
    late = avg_by_index.get(6)
    if late is not None and late < 20:
        r.recommendations.append("Build a loyalty programme for the long run")
    return r


def read_correlation(a: str, b: str, value: float, n: int) -> Reading:
    size = _step(abs(value), ((0.7, "strong"), (0.4, "moderate"), (0.2, "weak")), "no")
    r = Reading(f"{size} {'positive' if value > 0 else 'negative'} relation of {a} and {b}" if size != "no" else f"{a} and {b} are not related")
    if n < 30:
        r.warnings.append("Under 30 rows")
    if size == "strong":
        r.recommendations.append("Correlation is not cause: test before acting")
    return r


def read_campaign(kpis: dict[str, float]) -> Reading:
    r = Reading("Campaign figures")
    for name, steps in (("ROAS", ROAS_STEPS), ("CTR", CTR_STEPS), ("CVR", CVR_STEPS)):
        if (v := kpis.get(name)) is not None:
            grade = _step(v, steps, "low" if name != "ROAS" else "loss-making")
            r.findings.append(f"{name} {v:.2f}: {grade}")
            if grade in ("low", "loss-making"):
                r.recommendations.append(f"Raise {name} or move the budget")
    return r


def read_revenue(recent: float, earlier: float, total: float, std: float, mean: float, n: int) -> Reading:
    """Of a revenue series: means of the last and the first seven values, sum, sample deviation, mean, rows."""
    growth = (recent - earlier) / earlier * 100 if earlier > 0 else 0.0
    cv = std / mean * 100 if mean > 0 else 0.0
    word = _step(growth, ((20 + 1e-12, "Strong growth"), (1e-12, "Growth"), (-10 + 1e-12, "Stable")), "Decline")
    r = Reading(f"{word}: revenue {growth:+.1f}%", [f"Recent mean {recent:,.0f}", f"Earlier mean {earlier:,.0f}", f"Total {total:,.0f}"])
    if cv > 30:
        r.findings.append(f"Volatile: coefficient of variation {cv:.0f}%")
    elif cv < 10:
        r.findings.append(f"Steady: coefficient of variation {cv:.0f}%")
    if growth > 10:
        r.recommendations += ["Find what drives the growth and put more into it", "See that the infrastructure keeps up"]
    elif growth < -10:
        r.recommendations += ["Look into the decline at once", "Review feedback and churn", "Consider promotions"]
    else:
        r.recommendations += ["Work on margins and efficiency", "Try new ways to grow"]
    if cv > 40:
        r.warnings.append("Revenue can hardly be foretold")
    if n < 30:
        r.warnings.append("Under 30 rows")
    return r


def _ends(d: DataFrame, n: int, name: str) -> DataFrame:
    """One row: mean and population deviation of the first and of the last ``n`` rows in order of time."""
    part = lambda order, k: d.orderBy(*order).limit(n).agg(F.avg("v").alias(f"{k}_mean{name}"), F.stddev_pop("v").alias(f"{k}_std{name}"))
    return part(("t", "v"), "first").crossJoin(part((F.desc("t"), F.desc("v")), "last"))


def series_insights(df: DataFrame, date: str, value: str) -> DataFrame:
    """Rows kind, severity, value of what is told of a series in order of time (equal times: by value). trend: change of the mean of
    the last seven rows against the first seven, in per cent, over 10 (high over 30; from seven rows on). anomaly:
    rows beyond two population deviations (high over a tenth of all). volatility: deviation of the last 30 rows against the
    first 30, over 1.5 times (from 30 rows on). Both ends are small top-n sorts; rows without time or value are left out."""
    need(df, date, value)
    d = df.select(micros(date).alias("t"), num(value).alias("v")).dropna()
    s = d.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    far = d.crossJoin(F.broadcast(s.select("m", "s"))).agg(F.count_if((F.col("s") > 0) & (F.abs(F.col("v") - F.col("m")) > 2 * F.col("s"))).alias("far"))
    one = s.crossJoin(far).crossJoin(_ends(d, 7, "7")).crossJoin(_ends(d, 30, "30"))
    change = F.coalesce(ratio(F.col("last_mean7") - F.col("first_mean7"), F.col("first_mean7")) * 100, F.lit(0.0))
    told = F.array(
        F.when((F.col("n") >= 7) & (F.abs(change) > 10), F.struct(F.lit("trend").alias("kind"), F.when(F.abs(change) > 30, "high").otherwise("medium").alias("severity"), change.alias("value"))),
        F.when(F.col("far") > 0, F.struct(F.lit("anomaly").alias("kind"), F.when(F.col("far") > F.col("n") * 0.1, "high").otherwise("low").alias("severity"), F.col("far").cast("double").alias("value"))),
        F.when((F.col("n") >= 30) & (F.col("last_std30") > 1.5 * F.col("first_std30")), F.struct(F.lit("volatility").alias("kind"), F.lit("medium").alias("severity"), (ratio(F.col("last_std30"), F.col("first_std30")) * 100 - 100).alias("value"))),
    )
    return one.select(F.explode(F.filter(told, lambda x: x.isNotNull())).alias("x")).select("x.*")


def revenue_reading(df: DataFrame, date: str, revenue: str) -> Reading:
    """``read_revenue`` of the rows in order of time."""
    need(df, date, revenue)
    d = df.select(micros(date).alias("t"), num(revenue).alias("v")).dropna()
    s = d.agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).crossJoin(_ends(d, 7, "7")).first()
    return read_revenue(s.last_mean7 or 0.0, s.first_mean7 or 0.0, s.total or 0.0, s.std or 0.0, s["mean"] or 0.0, s.n)


def correlation_insights(pairs: DataFrame, threshold: float = 0.7, most: int | None = 3) -> DataFrame:
    """var1, var2, correlation, direction of the pairs (in the order of their names) of at least ``threshold``, ``most`` of them."""
    got = pairs.where(F.abs("correlation") >= threshold).withColumn("direction", F.when(F.col("correlation") > 0, "positive").otherwise("negative"))
    got = got.select("var1", "var2", "correlation", "direction").orderBy("var1", "var2")
    return got.limit(most) if most else got


def segment_insights(df: DataFrame, segment: str, value: str) -> DataFrame:
    """One row: segments, top3_share_pct (over 60: concentrated), weak_segments (under 30 per cent of the mean)."""
    need(df, segment, value)
    g = df.where(F.col(segment).isNotNull()).groupBy(segment).agg(F.coalesce(F.sum(num(value)), F.lit(0.0)).alias("t"))
    g = numbered(g, "t", [segment])
    mean = F.broadcast(g.agg(F.avg("t").alias("mean")))
    return g.crossJoin(mean).agg(F.count("*").alias("segments"), (ratio(F.sum(F.when(F.col("rank") <= 3, F.col("t"))), F.sum("t")) * 100).alias("top3_share_pct"), F.count_if(F.col("t") < 0.3 * F.col("mean")).alias("weak_segments"))
