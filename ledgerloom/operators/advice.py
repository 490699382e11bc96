"""Recommendations: rules kept as a table, met with measured figures by an interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import need

#: The order of priorities.
PRIORITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1}

#: Of each rule its set, name, conditions (metric: over, up to and with, from and with, under; null is no bound),
#: priority, category and impact; then our texts: title, the metric that the detail tells with its format, and what to do.
RULES = (
    ("ab_test", "strong_lift", {"significant": (0.5, None, None, None), "lift_pct": (10, None, None, None)}, "critical", "optimization", "high", "Roll out the winner now", "lift_pct", "%.1f per cent more", ("switch all traffic", "watch the figures afterwards", "write down what was learned")),
    ("ab_test", "modest_lift", {"significant": (0.5, None, None, None), "lift_pct": (0, 10, None, None)}, "high", "optimization", "medium", "Roll out step by step", "lift_pct", "%.1f per cent more", ("a tenth, half, then all of the traffic", "watch the main figures", "keep a way back")),
    ("ab_test", "small_sample", {"significant": (None, None, None, 0.5), "sample_size": (None, None, None, 1000)}, "medium", "investigation", "medium", "Collect more data", "sample_size", "%.0f in the sample", ("run on to a thousand a variant", "bring in more channels", "check the set-up")),
    ("ab_test", "no_difference", {"significant": (None, None, None, 0.5), "sample_size": (None, None, 1000, None)}, "medium", "investigation", "low", "Try something more different", "sample_size", "no difference in a sample of %.0f", ("think of bolder variants", "test another part", "see whether the metric can tell")),
    ("ab_test", "negative_lift", {"significant": (0.5, None, None, None), "lift_pct": (None, None, None, 0)}, "critical", "reduction", "high", "Keep the old variant", "lift_pct", "%.1f per cent", ("drop the new one", "find out why it did worse", "tell the others")),
    ("cohort", "weak_start", {"retention_1": (None, None, None, 50)}, "critical", "optimization", "high", "Mend the first steps of new customers", "retention_1", "%.0f per cent come back in the next period", ("make the start simpler", "guide new users", "write to them", "ask those who left")),
    ("cohort", "weak_later", {"retention_6": (0, None, None, 20)}, "high", "optimization", "high", "Give reasons to stay", "retention_6", "%.0f per cent are left by period 6", ("reward loyalty", "offer news", "win sleepers back", "look at the cohorts that stay")),
    ("cohort", "high_churn", {"churn_rate": (50, None, None, None)}, "critical", "investigation", "high", "Look into the churn", "churn_rate", "%.0f per cent leave", ("look for patterns", "talk to those who left", "compare with competitors", "test incentives")),
    ("campaign", "low_roi", {"roi": (None, None, None, 2)}, "high", "optimization", "high", "Get more out of the budget", "roi", "returns of %.1f", ("move budget to what works", "test new messages", "sharpen the targeting", "cut what does worst")),
    ("campaign", "high_roi", {"roi": (5, None, None, None)}, "high", "expansion", "high", "Put more into what works", "roi", "returns of %.1f", ("raise the best budgets", "reach similar people", "try similar channels", "write down why it works")),
    ("campaign", "decline", {"yoy_change": (None, None, None, -10)}, "critical", "investigation", "high", "Stop the decline", "yoy_change", "%.0f per cent against last year", ("find the cause", "renew what is shown", "check targeting and bids", "try other ways")),
    ("campaign", "costly_customers", {"cac": (100, None, None, None)}, "medium", "optimization", "medium", "Win customers at less cost", "cac", "%.2f a customer", ("use referrals", "better landing pages", "waste less reach", "work nearer to the purchase")),
)


def rule_table(spark: SparkSession) -> DataFrame:
    """A row a condition: rule_set, rule, metric, over, up_to, least, under, conditions (of the rule), and what the rule tells."""
    rows = [
        (kind, rule, metric, *[None if b is None else float(b) for b in bounds], len(conditions), priority, category, impact, title, metric == told, form, list(actions))
        for kind, rule, conditions, priority, category, impact, title, told, form, actions in RULES for metric, bounds in conditions.items()
    ]
    return spark.createDataFrame(rows, "rule_set string, rule string, metric string, over double, up_to double, least double, under double, conditions int, priority string, category string, estimated_impact string, title string, tells boolean, form string, action_items array<string>")


def recommend(figures: DataFrame, rule_set: str, subject: str = "subject", rules: DataFrame | None = None) -> DataFrame:
    """subject, rule, priority, category, estimated_impact, title, description, action_items, place: what the rules of a set say of the
    figures (subject, metric, value; one value a metric). A rule speaks if the values of all its metrics lie in its intervals.
    place: within the subject by priority, then rule.

    The rules (``rule_table`` or one of the same columns) are some dozens and go to every task; figures are met where they are
    and only those in an interval are grouped. Null and NaN figures meet no rule."""
    need(figures, subject, "metric", "value")
    rules = (rules or rule_table(figures.sparkSession)).where(F.col("rule_set") == rule_set)
    v = F.col("value").cast("double")
    inside = F.lit(True)
    for bound, holds in (("over", v > F.col("over")), ("up_to", v <= F.col("up_to")), ("least", v >= F.col("least")), ("under", v < F.col("under"))):
        inside = inside & F.coalesce(holds, F.col(bound).isNull())
    met = figures.select(F.col(subject).alias("subject"), "metric", "value").where(v.isNotNull() & ~F.isnan(v)).join(F.broadcast(rules), "metric").where(inside)
    got = met.groupBy("subject", "rule").agg(
        F.count_distinct("metric").alias("n"), F.first("conditions").alias("conditions"), *[F.first(c).alias(c) for c in ("priority", "category", "estimated_impact", "title", "action_items")],
        F.max(F.when(F.col("tells"), v)).alias("told"), F.max(F.when(F.col("tells"), F.col("form"))).alias("form"),
    ).where("n = conditions")
    got = got.withColumn("description", _formatted(F.col("form"), F.col("told")))
    order = F.coalesce(*[F.when(F.col("priority") == p, k) for p, k in PRIORITIES.items()], F.lit(0))
    listed = F.array_sort(F.collect_list(F.struct((-order).alias("o"), "rule", "priority", "category", "estimated_impact", "title", "description", "action_items")))
    rows = got.groupBy("subject").agg(listed.alias("r")).select("subject", F.posexplode("r").alias("place", "r"))
    return rows.select(F.col("subject").alias(subject), (F.col("place") + 1).cast("long").alias("place"), *[F.col(f"r.{c}") for c in ("rule", "priority", "category", "estimated_impact", "title", "description", "action_items")])


def _formatted(form, value):
    """The text of a form with its one figure, of no, one or two digits."""
    out = F.lit(None).cast("string")
    for mark, digits in (("%.0f", 0), ("%.1f", 1), ("%.2f", 2)):
        out = F.when(form.contains(mark), F.replace(form, F.lit(mark), F.format_string(mark, F.round(value, digits)))).otherwise(out)
    return out


def figures_of(df: DataFrame, subject: str, metrics: dict[str, str]) -> DataFrame:
    """(subject, metric, value) rows of a table with a row a subject: metric name to column."""
    need(df, subject, *metrics.values())
    return df.select(F.col(subject).alias("subject"), *[F.col(c).cast("double").alias(m) for m, c in metrics.items()]).unpivot(["subject"], list(metrics), "metric", "value")
