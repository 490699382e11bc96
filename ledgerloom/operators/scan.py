"""One-shot scan of a table: findings on quality, trends, distributions, correlations, categories, anomalies, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.quantiles import exact_quantiles
from ledgerloom.functions.semantics import need, num, ratio
from ledgerloom.functions.store import stored
from ledgerloom.operators.anomaly import RANK, all_anomalies, unique_anomalies
from ledgerloom.operators.association import correlation_pairs
from ledgerloom.operators.profile import QUARTILES, _kinds, column_roles, data_quality, missing_values

#: A rise of columns with these in their names is bad.
COST_WORDS = ("cost", "expense", "discount", "refund", "churn", "cancel")
_FIELDS = ("category", "severity", "direction", "title", "detail")


def _finding(category: str, severity: Column, direction: Column, title: Column, detail: Column) -> list[Column]:
    return [c.alias(n) for n, c in zip(_FIELDS, (F.lit(category), severity, direction, title, detail), strict=True)]


def half_changes(df: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """metric, first, second, n: means of both halves of a metric's rows in the order of a time or number column; of an odd number
    the middle row is in the second. Rows of the time at the middle, whose order is not told, are split alike: the
    halves get them by their mean, as many as they lack. Times are summed up first; only those of one day (or 1/64 of a
    doubling of a number) are in one window."""
    need(df, order, *metrics)
    time = dict(df.dtypes)[order] in ("timestamp", "timestamp_ntz", "date")
    at = F.unix_micros(F.col(order).cast("timestamp")).cast("double") if time else F.col(order).cast("double")
    d = df.select(at.alias("at"), *[num(m).alias(m) for m in metrics]).where("at is not null").unpivot(["at"], metrics, "metric", "v").where("v is not null")
    one = d.groupBy("metric", "at").agg(F.count("*").alias("k"), F.sum("v").alias("s"))
    bin_ = F.floor(F.col("at") / 86_400_000_000).cast("long") if time else (F.signum("at") * F.floor(F.log2(F.abs("at") + 1) * 64)).cast("long")
    one = one.withColumn("bin", bin_)
    bins = one.groupBy("metric", "bin").agg(F.sum("k").alias("kb"))
    before = Window.partitionBy("metric").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("metric", "bin", F.coalesce(F.sum("kb").over(before), F.lit(0)).alias("start"), F.sum("kb").over(Window.partitionBy("metric")).alias("n"))
    inside = Window.partitionBy("metric", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn("upto", F.sum("k").over(inside)).join(F.broadcast(starts), ["metric", "bin"])
    end = F.col("start") + F.col("upto")
    in_first = F.greatest(F.lit(0), F.least(F.col("k"), F.floor(F.col("n") / 2) - (end - F.col("k"))))
    share = in_first / F.col("k")
    got = one.groupBy("metric").agg(
        F.sum(F.col("s") * share).alias("a"), F.sum(in_first).alias("na"), F.sum(F.col("s") * (1 - share)).alias("b"), F.sum(F.col("k") - in_first).alias("nb"), F.max("n").alias("n")
    )
    return got.select("metric", ratio(F.col("a"), F.col("na")).alias("first"), ratio(F.col("b"), F.col("nb")).alias("second"), "n")


def number_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, v, k: the different values of numbers, without missing ones, and their rows."""
    need(df, *columns)
    return df.select(*[num(c).alias(c) for c in columns]).unpivot([], columns, "column", "v").where("v is not null").groupBy("column", "v").agg(F.count("*").alias("k"))


def shapes(kinds: DataFrame, beyond: float) -> DataFrame:
    """column, count, skewness, iqr, outlier_count (beyond ``beyond`` x iqr from the quartiles) as of ``numeric_summary``, from the
    different values and their rows (``number_kinds``)."""
    v, k, n = F.col("v"), F.col("k"), F.col("count")
    one = kinds.groupBy("column").agg(F.sum("k").alias("count"), (F.sum(v * k) / F.sum("k")).alias("mean"))
    one = stored(one.join(exact_quantiles(kinds, ["column"], "v", QUARTILES, times="k"), "column"), little=True)
    low, high = F.col("q")[0], F.col("q")[2]
    reach = (high - low) * beyond
    off = v - F.col("mean")
    got = kinds.join(F.broadcast(one), "column").groupBy("column", "count", (high - low).alias("iqr")).agg(
        F.sum(k * off * off).alias("m2"), F.sum(k * off * off * off).alias("m3"), F.coalesce(F.sum(F.when((v < low - reach) | (v > high + reach), k)), F.lit(0)).alias("outlier_count")
    )
    skew = ratio(F.sqrt(n) * F.col("m3"), F.pow("m2", 1.5)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return got.select("column", "count", F.round(F.when(n > 2, skew), 4).alias("skewness"), F.round("iqr", 4).alias("iqr"), "outlier_count")


def top_value_share(df: DataFrame, columns: list[str], kinds: DataFrame | None = None) -> DataFrame:
    """column, n, kinds, top (value of most rows, the smallest of several), top_pct: of numbers, without missing ones."""
    counts = number_kinds(df, columns) if kinds is None else kinds
    got = counts.groupBy("column").agg(F.sum("k").alias("n"), F.count("*").alias("kinds"), F.min(F.struct((-F.col("k")).alias("k"), "v")).alias("t"))
    return got.select("column", "n", "kinds", F.col("t.v").alias("top"), (-F.col("t.k") / F.col("n") * 100).alias("top_pct"))


def top_fifth(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, kinds, top_n, top_pct of columns of 2 to 50 values: the share of rows of the most frequent fifth of the values."""
    need(df, *columns)
    counts = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "v").where("v is not null").groupBy("column", "v").agg(F.count("*").alias("k"))
    few = counts.groupBy("column").agg(F.count("*").alias("kinds"), F.sum("k").alias("n")).where("kinds between 2 and 50")
    few = few.withColumn("top_n", F.greatest(F.lit(1), F.floor(F.col("kinds") * 0.2).cast("long")))
    ranked = counts.join(F.broadcast(few), "column").withColumn("i", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("k"), "v")))
    return ranked.groupBy("column", "kinds", "top_n").agg((F.sum(F.when(F.col("i") <= F.col("top_n"), F.col("k"))) / F.first("n") * 100).alias("top_pct"))


def mean_gaps(df: DataFrame, columns: list[str], revenue: str) -> DataFrame:
    """column, best, worst, gap: largest by smallest mean of ``revenue`` over the values of a column of 2 to 50, if that is positive."""
    need(df, revenue, *columns)
    long = df.select(num(revenue).alias("r"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["r"], columns, "column", "v").where("v is not null")
    means = long.groupBy("column", "v").agg(F.avg("r").alias("m"))
    got = means.groupBy("column").agg(F.count("*").alias("kinds"), F.count("m").alias("k"), F.max(F.when(F.col("m").isNotNull(), F.struct("m", "v"))).alias("hi"), F.min(F.when(F.col("m").isNotNull(), F.struct("m", "v"))).alias("lo"))
    return got.where("kinds between 2 and 50 and k >= 2 and lo.m > 0").select("column", F.col("hi.v").alias("best"), F.col("lo.v").alias("worst"), (F.col("hi.m") / F.col("lo.m")).alias("gap"))


def full_scan(df: DataFrame, date: str | None = None, numeric: list[str] | None = None, categorical: list[str] | None = None, revenue: str | None = None, anomalies: bool = True) -> DataFrame:
    """category, severity, direction, title, detail of all findings. Numbers and categories are by default those of the
    schema, without ids; all of them take part. ``revenue``: the column whose means are compared over categories. The different
    values of each column and their rows are counted and stored once; quality, missing values, shapes, top values and ranks come from them."""
    roles = column_roles(df)
    numeric, categorical = numeric or roles.numeric, categorical or roles.categorical
    date = date or (roles.date[0] if roles.date else None)
    need(df, date, revenue, *numeric, *categorical)
    neutral, parts = F.lit("neutral"), []
    cells = stored(_kinds(df))
    q = data_quality(df, cells).where("warnings <> ''")
    parts.append(q.select(*_finding("Data quality", F.when(F.col("level") == "critical", "high").when(F.col("level") == "poor", "medium").otherwise("low"), F.lit("negative"), F.lit("Data quality"), F.col("warnings"))))
    m = missing_values(df, cells).where("missing_pct > 10")
    parts.append(m.select(*_finding("Missing", F.when(F.col("missing_pct") > 50, "high").otherwise("medium"), F.lit("negative"), F.concat(F.lit("Missing values in "), "column"), F.format_string("%.2f%% missing", "missing_pct"))))
    if date and numeric:
        t = half_changes(df, date, numeric).where("n >= 10").withColumn("p", ratio(F.col("second") - F.col("first"), F.abs("first")) * 100).where("abs(p) >= 5")
        cost = F.lower("metric").rlike("|".join(COST_WORDS))
        good = (F.col("p") > 0) != cost
        parts.append(t.select(*_finding("Trend", F.when(F.abs("p") > 25, "high").when(F.abs("p") > 10, "medium").otherwise("low"), F.when(good, "positive").otherwise("negative"), F.concat("metric", F.when(F.col("p") > 0, " is rising").otherwise(" is falling")), F.format_string("%+.1f%% from the first to the second half", "p"))))
    if numeric:
        kinds = stored(number_kinds(df, numeric))
        s = shapes(kinds, 3.0).where("count >= 20")
        parts.append(s.where("abs(skewness) > 3").select(*_finding("Distribution", F.lit("medium"), neutral, F.concat("column", F.lit(" is skewed")), F.format_string("skewness %.1f", "skewness"))))
        share = F.col("outlier_count") / F.col("count") * 100
        parts.append(s.where((F.col("iqr") > 0) & (share > 0.5)).select(*_finding("Outliers", F.when(share >= 5, "high").otherwise("medium"), neutral, F.concat("column", F.lit(" has extreme outliers")), F.format_string("%d, %.1f%% of the values", "outlier_count", share))))
        v = top_value_share(df, numeric, kinds).where("n >= 20 and kinds < n * 0.5 and top_pct > 50")
        parts.append(v.select(*_finding("Concentration", F.lit("medium"), neutral, F.concat("column", F.lit(" has one dominant value")), F.format_string("%.0f%% of the values", "top_pct"))))
    if len(numeric) > 1:
        c = correlation_pairs(df, numeric, "spearman", kinds=kinds).where("abs(correlation) > 0.6")
        strong = F.abs("correlation") > 0.85
        parts.append(c.select(*_finding("Correlation", F.when(strong, "medium").otherwise("low"), F.when(strong & (F.col("correlation") > 0), "positive").otherwise("neutral"), F.concat("var1", F.lit(" and "), "var2"), F.format_string("rank correlation %.2f", "correlation"))))
    if categorical:
        k = top_fifth(df, categorical).where("top_pct > 80")
        parts.append(k.select(*_finding("Concentration", F.lit("low"), neutral, F.concat("column", F.lit(" is concentrated")), F.format_string("top %d of %d values: %.0f%% of the rows", "top_n", "kinds", "top_pct"))))
    if categorical and revenue:
        g = mean_gaps(df, categorical, revenue).where("gap > 5")
        parts.append(g.select(*_finding("Disparity", F.when(F.col("gap") > 10, "high").otherwise("medium"), neutral, F.concat(F.col("column"), F.lit(f" divides {revenue}")), F.format_string("%s has %.1f times the mean of %s", "best", "gap", "worst"))))
    if numeric and anomalies:
        a = unique_anomalies(all_anomalies(df, numeric, categorical, date))
        parts.append(a.select(*_finding("Anomaly", F.when(F.col("severity") == "critical", "high").otherwise(F.col("severity")), neutral, F.col("title"), F.concat("description", F.lit(" (of "), F.col("occurrences").cast("string"), F.lit(")")))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked_findings(findings: DataFrame) -> DataFrame:
    """With their place: by severity, then negative before neutral before positive, then title. Findings are few."""
    sev = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in RANK.items()], F.lit(0))
    way = F.when(F.col("direction") == "negative", 0).when(F.col("direction") == "neutral", 1).otherwise(2)
    return findings.withColumn("place", F.row_number().over(Window.orderBy(sev.desc(), way, "title", "detail")))
