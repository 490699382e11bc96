"""Anomalies: single values, rare combinations and odd category means, breaks in sequences; one schema for all."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import need, num, ratio

#: anomaly_type, severity, title, description and figures; context holds what only one kind has.
FIELDS = ("anomaly_type", "severity", "title", "description", "detected_value", "expected_value", "deviation_pct", "context")
#: Least deviation for the severities of each kind, in per cent.
VALUE_SEVERITY = ((100, "critical"), (50, "high"), (30, "medium"))
#: Z threshold and least deviation of the sensitivities.
SENSITIVITY = {"low": (3.0, 50), "medium": (2.5, 30), "high": (2.0, 20)}
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def severity_of(deviation: Column, steps: tuple = VALUE_SEVERITY, rest: str = "low") -> Column:
    out = F.lit(rest)
    for least, name in reversed(steps):
        out = F.when(deviation > least, name).otherwise(out)
    return out


def _context(**items: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in items]), F.array(*[v.cast("string") for v in items.values()]))


def value_anomalies(df: DataFrame, columns: list[str], sensitivity: float = 2.5, min_impact_pct: float = 20, key: str | None = None) -> DataFrame:
    """Values more than ``sensitivity`` standard deviations and ``min_impact_pct`` per cent from their column's mean; of
    columns with ten values and some variation. ``key`` names the row in the context."""
    need(df, *columns, key)
    ids = F.col(key).cast("string") if key else F.lit(None).cast("string")
    long = df.select(ids.alias("row"), *[num(c).alias(c) for c in columns]).unpivot(["row"], columns, "column", "v").where("v is not null")
    stats = F.broadcast(long.groupBy("column").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).where("n >= 10 and s > 0"))  # a row a column
    z = F.abs(F.col("v") - F.col("m")) / F.col("s")
    deviation = F.coalesce(F.abs(ratio(F.col("v") - F.col("m"), F.col("m")) * 100), F.lit(0.0))
    got = long.join(stats, "column").withColumns({"z": z, "d": deviation}).where((F.col("z") > sensitivity) & (F.col("d") >= min_impact_pct))
    up = F.col("v") > F.col("m")
    return got.select(
        F.lit("value").alias("anomaly_type"), severity_of(F.col("d")).alias("severity"), F.concat(F.when(up, "Unusual Spike in ").otherwise("Unusual Drop in "), "column").alias("title"),
        F.format_string("%s = %.2f (expected: %.2f +- %.2f)", "column", "v", "m", "s").alias("description"), F.col("v").alias("detected_value"), F.col("m").alias("expected_value"), F.col("d").alias("deviation_pct"),
        _context(column=F.col("column"), row=F.col("row"), z_score=F.round("z", 6), is_spike=up).alias("context"),
    )


def rare_combinations(df: DataFrame, columns: list[str], max_values: int = 20, min_support: float = 0.01, per_pair: int = 3) -> DataFrame:
    """Of each pair of columns with at most ``max_values`` values the ``per_pair`` rarest combinations under
    ``min_support``: col1, col2, value1, value2, count, frequency. Pairs of more values go before anything is ranked."""
    need(df, *columns)
    pairs = list(combinations(range(len(columns)), 2))
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(columns[i]).cast("string").alias("value1"), F.col(columns[j]).cast("string").alias("value2")) for i, j in pairs]))
    cells = df.select(made.alias("p")).select("p.*").dropna().groupBy("i", "j", "value1", "value2").agg(F.count("*").alias("count"))
    w = Window.partitionBy("i", "j")
    kinds = [F.count_distinct(c) <= max_values for c in ("value1", "value2")]
    few = cells.groupBy("i", "j").agg(F.sum("count").alias("total"), (kinds[0] & kinds[1]).alias("few")).where("few")  # a row a pair
    got = cells.join(F.broadcast(few), ["i", "j"]).withColumn("frequency", F.col("count") / F.col("total")).where(F.col("frequency") < min_support)
    got = got.withColumn("k", F.row_number().over(w.orderBy("count", "value1", "value2"))).where(F.col("k") <= per_pair)
    name = F.array(*map(F.lit, columns))
    return got.select(name[F.col("i")].alias("col1"), name[F.col("j")].alias("col2"), "value1", "value2", "count", "frequency")


def odd_category_means(df: DataFrame, categorical: list[str], numeric: list[str], min_count: int = 5, z_threshold: float = 2.5, min_deviation_pct: float = 30) -> DataFrame:
    """Categories whose mean is more than ``z_threshold`` standard errors and ``min_deviation_pct`` per cent from the mean of
    all: category_column, category_value, numeric_column, mean, overall_mean, z, deviation_pct, count."""
    need(df, *categorical, *numeric)
    long = df.select(*[F.col(c).cast("string").alias(f"k_{c}") for c in categorical], *[num(c).alias(c) for c in numeric]).unpivot([f"k_{c}" for c in categorical], numeric, "numeric_column", "v").where("v is not null")
    overall = F.broadcast(long.groupBy("numeric_column").agg(F.avg("v").alias("overall_mean"), F.stddev_samp("v").alias("s")))  # a row a column
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category_column"), F.col(f"k_{c}").alias("category_value")) for c in categorical]))
    groups = long.select("numeric_column", "v", each.alias("g")).select("numeric_column", "v", "g.*").where("category_value is not null")
    got = groups.groupBy("category_column", "category_value", "numeric_column").agg(F.count("*").alias("count"), F.avg("v").alias("mean")).where(F.col("count") >= min_count).join(overall, "numeric_column")
    z = F.coalesce(ratio(F.abs(F.col("mean") - F.col("overall_mean")), F.col("s") / F.sqrt("count")), F.lit(0.0))
    d = F.coalesce(F.abs(ratio(F.col("mean") - F.col("overall_mean"), F.col("overall_mean"))) * 100, F.lit(0.0))
    return got.withColumns({"z": z, "deviation_pct": d}).where((F.col("z") > z_threshold) & (F.col("deviation_pct") > min_deviation_pct)).drop("s")


def pattern_anomalies(df: DataFrame, categorical: list[str], numeric: list[str], max_values: int = 20, min_support: float = 0.01) -> DataFrame:
    """Rare combinations and odd category means of all columns in the common schema."""
    rare = rare_combinations(df, categorical, max_values, min_support).select(
        F.lit("pattern").alias("anomaly_type"), F.lit("medium").alias("severity"), F.concat(F.lit("Rare Combination: "), "col1", F.lit(" + "), "col2").alias("title"),
        F.concat("col1", F.lit("="), "value1", F.lit(", "), "col2", F.lit("="), "value2").alias("description"), F.col("frequency").alias("detected_value"), F.lit(float(min_support)).alias("expected_value"),
        F.round((1 - F.col("frequency") / min_support) * 100, 6).alias("deviation_pct"), _context(count=F.col("count")).alias("context"),
    ) if len(categorical) > 1 else None
    odd = odd_category_means(df, categorical, numeric).select(
        F.lit("pattern").alias("anomaly_type"), severity_of(F.col("deviation_pct"), ((100, "critical"), (50, "high")), "medium").alias("severity"), F.concat(F.lit("Unusual "), "numeric_column", F.lit(" for "), "category_column", F.lit("="), "category_value").alias("title"),
        F.format_string("mean %.2f against %.2f", "mean", "overall_mean").alias("description"), F.col("mean").alias("detected_value"), F.col("overall_mean").alias("expected_value"), "deviation_pct",
        _context(sample_size=F.col("count")).alias("context"),
    )
    return odd if rare is None else rare.unionByName(odd)


def sequence_anomalies(df: DataFrame, date: str, metrics: list[str], window: int = 7, min_change_pct: float = 30, ties: list[str] | None = None) -> DataFrame:
    """Mean of the last ``window`` rows by date against the rows before them: metric, recent_avg, previous_avg, change_pct,
    severity, pattern (accelerating if the window before changed the same way, new if it did the other way, else sudden).

    One pass for all metrics: rows become (metric, value) rows, of which each task hands on a metric's last 3 x window only."""
    need(df, date, *metrics, *(ties or []))
    keys = {"d__": F.col(date), **{f"t{i}__": F.col(t) for i, t in enumerate(ties or [])}}
    long = df.where(F.col(date).isNotNull()).select(*[c.alias(k) for k, c in keys.items()], *[num(m).alias(m) for m in metrics]).unpivot(list(keys), metrics, "metric", "v").where("v is not null")
    last = long.withColumn("i", F.row_number().over(Window.partitionBy("metric").orderBy(*[F.col(k).desc() for k in keys]))).where(F.col("i") <= 3 * window)
    part, d = F.floor((F.col("i") - 1) / window), F.col("d__")
    avg = lambda k: F.avg(F.when(part == k, F.col("v")))
    got = last.groupBy("metric").agg(avg(0).alias("recent_avg"), avg(1).alias("previous_avg"), avg(2).alias("older_avg"), F.count("*").alias("n"), F.min(F.when(part == 0, d)).alias("start"), F.max(d).alias("end"))
    change = ratio(F.col("recent_avg") - F.col("previous_avg"), F.abs("previous_avg")) * 100
    before = ratio(F.col("previous_avg") - F.col("older_avg"), F.abs("older_avg")) * 100
    got = got.where(F.col("n") >= 2 * window).withColumns({"change_pct": change, "before_pct": before}).where(F.abs("change_pct") >= min_change_pct)
    same = F.signum("before_pct") == F.signum("change_pct")
    pattern = F.when(F.col("before_pct").isNull(), "sudden").when(same & (F.abs("before_pct") > 10), "accelerating").when(~same & (F.abs("before_pct") > 10), "new").otherwise("sudden")
    return got.select("metric", "recent_avg", "previous_avg", "change_pct", severity_of(F.abs("change_pct"), ((100, "critical"), (50, "high")), "medium").alias("severity"), pattern.alias("pattern"), F.col("start").alias("recent_period_start"), F.col("end").alias("recent_period_end"))


def all_anomalies(df: DataFrame, numeric: list[str], categorical: list[str], date: str | None = None, sensitivity: str = "medium", key: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """All kinds in the common schema; sequences of all numbers where there is a date."""
    z, impact = SENSITIVITY[sensitivity]
    got = value_anomalies(df, numeric, z, impact, key)
    if categorical:
        got = got.unionByName(pattern_anomalies(df, categorical, numeric))
    if date:
        seq = sequence_anomalies(df, date, numeric, ties=ties).select(
            F.lit("sequence").alias("anomaly_type"), "severity", F.concat(F.when(F.col("change_pct") > 0, "Upward").otherwise("Downward"), F.lit(" Shift in "), "metric").alias("title"),
            F.format_string("%.2f after %.2f", "recent_avg", "previous_avg").alias("description"), F.col("recent_avg").alias("detected_value"), F.col("previous_avg").alias("expected_value"), F.abs("change_pct").alias("deviation_pct"),
            _context(pattern=F.col("pattern")).alias("context"),
        )
        got = got.unionByName(seq)
    return got


def _rank() -> Column:
    out = F.lit(0)
    for name, r in RANK.items():
        out = F.when(F.col("severity") == name, r).otherwise(out)
    return out


def prioritized(anomalies: DataFrame, limit: int | None = None) -> DataFrame:
    """By severity, then deviation, both descending; ``limit`` for a report's top."""
    got = anomalies.orderBy(_rank().desc(), F.desc("deviation_pct"), "title", "description")
    return got.limit(limit) if limit else got


def unique_anomalies(anomalies: DataFrame) -> DataFrame:
    """One row for each type and title, that of highest severity and deviation, with the number of all."""
    best = F.max_by(F.struct(*[c for c in anomalies.columns if c not in ("anomaly_type", "title")]), F.struct(_rank(), "deviation_pct", "description"))
    return anomalies.groupBy("anomaly_type", "title").agg(best.alias("b"), F.count("*").alias("occurrences")).select("anomaly_type", "title", "b.*", "occurrences")
