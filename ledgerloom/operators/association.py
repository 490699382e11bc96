"""Association between columns: correlations, contingency, group differences, outliers; matrices in long form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dist import f_p_value
from ledgerloom.functions.quantiles import exact_quantiles, quantiles_of
from ledgerloom.functions.semantics import categorical_columns, need, num, numbered, numeric_columns, pct, ratio, with_total
from ledgerloom.functions.store import stored
from ledgerloom.operators.kendall import kendall_tau


def _pairs_long(one_row: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return one_row.select(F.explode(rows).alias("r")).select("r.*")


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, method: str = "pearson", digits: int | None = 4, kinds: DataFrame | None = None) -> DataFrame:
    """var1, var2, correlation for each pair of numeric columns, on rows where both are there.

    pearson: all pairs in one aggregation. spearman: the same of average ranks; columns without missing values are ranked
    once for all their pairs, others anew for each pair. kendall: tau-b, from the counts of distinct pairs of values, by
    strips and cells (``kendall_tau``). ``kinds`` (column, v, k: the different values of the columns and their numbers of rows), if
    there, spares spearman a pass a column."""
    columns = columns or numeric_columns(df)
    need(df, *columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, correlation double")
    d = df.select(*[num(c).alias(c) for c in columns])
    if method == "pearson":
        got = _pairs_long(d.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]), pairs)
    elif method in ("spearman", "kendall"):
        one, whole = _spearman if method == "spearman" else kendall_tau, []
        if method == "spearman":
            seen = d.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
            whole = [c for i, c in enumerate(columns) if seen[f"n{i}"] == seen["n"]]
        got = _spearman_whole(d, whole, [p for p in pairs if set(p) <= set(whole)], kinds) if len(whole) > 1 else None
        for a, b in [p for p in pairs if not set(p) <= set(whole)]:
            p = one(d.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()).select(F.lit(a).alias("var1"), F.lit(b).alias("var2"), "correlation")
            got = p if got is None else got.unionByName(p)
    else:
        raise ValueError("method is pearson, spearman or kendall")
    bad = F.isnan("correlation")
    value = F.when(~bad, F.col("correlation"))
    return got.withColumn("correlation", F.round(value, digits) if digits is not None else value)


def _average_rank(d: DataFrame, c: str, name: str) -> DataFrame:
    counts = d.groupBy(c).agg(F.count("*").alias("k__"))
    ranks = numbered(counts, c, [], ascending=True, number="i__", running={"u__": "k__"})
    return d.join(ranks.select(c, (F.col("u__") - (F.col("k__") - 1) / 2).alias(name)), c)


def _spearman(d: DataFrame) -> DataFrame:
    ranked = _average_rank(_average_rank(d, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("correlation"))


def _spearman_whole(d: DataFrame, columns: list[str], pairs: list[tuple[str, str]], kinds: DataFrame | None = None) -> DataFrame:
    """All pairs of columns without missing values: a rank a column, one aggregation."""
    ranked = d.select(*columns)
    for i, c in enumerate(columns):
        counts = stored(d.groupBy(c).agg(F.count("*").alias("k__"))) if kinds is None else kinds.where((F.col("column") == c) & F.col("v").isNotNull()).select(F.col("v").alias(c), F.col("k").alias("k__"))
        ranks = numbered(counts, c, [], ascending=True, number="i__", running={"u__": "k__"})
        ranked = ranked.join(stored(ranks.select(c, (F.col("u__") - (F.col("k__") - 1) / 2).alias(f"r{i}__"))), c)
    at = {c: f"r{i}__" for i, c in enumerate(columns)}
    return _pairs_long(ranked.agg(*[F.corr(at[a], at[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]), pairs)


def strength_label(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.9, "very strong").when(a >= 0.7, "strong").when(a >= 0.5, "moderate").otherwise("weak")


#: Label texts by least absolute value.
CORRELATION_LABELS = ((0.7, "Strong"), (0.4, "Moderate"), (0.2, "Weak"))
CRAMERS_LABELS = ((0.5, "Strong association"), (0.3, "Moderate association"), (0.1, "Weak association"), (None, "Very weak or no association"))
ETA_LABELS = ((0.14, "Large effect size"), (0.06, "Medium effect size"), (0.01, "Small effect size"), (None, "Negligible effect"))


def _labelled(v: Column, labels: tuple) -> Column:
    out = F.lit(labels[-1][1])
    for least, text in reversed(labels[:-1]):
        out = F.when(v >= least, text).otherwise(out)
    return out


def correlation_label(r: Column) -> Column:
    size = _labelled(F.abs(r), (*CORRELATION_LABELS, (None, "")))
    text = F.concat(size, F.when(r > 0, " positive").otherwise(" negative"), F.lit(" relationship"))
    return F.when(size == "", "Very weak or no relationship").otherwise(text)


def cramers_label(v: Column) -> Column:
    return _labelled(v, CRAMERS_LABELS)


def eta_label(e: Column) -> Column:
    return _labelled(e, ETA_LABELS)


def strong_correlations(df: DataFrame, threshold: float = 0.5, method: str = "pearson", columns: list[str] | None = None) -> DataFrame:
    got = correlation_pairs(df, columns, method).where(F.abs("correlation") >= threshold)
    return got.withColumns({"strength": strength_label(F.col("correlation")), "direction": F.when(F.col("correlation") > 0, "positive").otherwise("negative")})


def correlation_with_target(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """variable, correlation, abs_correlation, interpretation of each numeric column with the target; one aggregation."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    need(df, target, *columns)
    d = df.select(*[num(c).alias(c) for c in [target, *columns]])
    got = _pairs_long(d.agg(*[F.corr(c, target).alias(f"c{i}") for i, c in enumerate(columns)]), [(c, target) for c in columns])
    return got.select(F.col("var1").alias("variable"), "correlation", F.abs("correlation").alias("abs_correlation"), correlation_label(F.col("correlation")).alias("interpretation"))


def cross_tabulation(df: DataFrame, row: str, col: str, value: str | None = None, aggfunc: str = "count", normalize: str | None = None) -> DataFrame:
    """row, col, value in long form; without ``normalize`` also 'Total' rows and columns (sums of what they total).
    normalize: index, columns or all. Null keys are left out."""
    need(df, row, col, value)
    d = df.select(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"), (num(value) if value else F.lit(1.0)).alias("v")).dropna(subset=["row", "col"])
    agg = {"count": F.count("v"), "sum": F.sum("v"), "mean": F.avg("v"), "min": F.min("v"), "max": F.max("v")}[aggfunc]
    cells = d.groupBy("row", "col").agg(agg.cast("double").alias("value"))
    if normalize:
        if normalize == "all":
            return with_total(cells, all__=F.sum("value")).withColumn("value", ratio(F.col("value"), F.col("all__"))).drop("all__")
        w = {"index": Window.partitionBy("row"), "columns": Window.partitionBy("col")}[normalize]
        return cells.withColumn("value", ratio(F.col("value"), F.sum("value").over(w)))
    cube = cells.cube("row", "col").agg(F.sum("value").alias("value"))
    return cube.select(F.coalesce("row", F.lit("Total")).alias("row"), F.coalesce("col", F.lit("Total")).alias("col"), "value")


def group_comparison(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: count, mean, std, min, max, median, difference from the overall mean (also per cent), cv, effect_size."""
    need(df, group, value)
    d = df.select(F.col(group), num(value).alias("v")).dropna(subset=["v"])
    overall = F.broadcast(d.agg(F.avg("v").alias("m__"), F.stddev_samp("v").alias("s__")))
    got = d.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    middle = exact_quantiles(d.where(F.col(group).isNotNull()), [group], "v", (0.5,)).select(group, F.col("q")[0].alias("median"))
    got = got.join(middle, group).crossJoin(overall)
    diff = F.col("mean") - F.col("m__")
    return got.withColumns({"diff_from_overall": diff, "diff_pct": pct(diff, F.col("m__")), "cv": F.round(ratio(F.col("std"), F.col("mean")), 3), "effect_size": F.round(ratio(diff, F.col("s__")), 3)}).drop("m__", "s__")


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row: lower and upper bound. iqr: quartiles -+ threshold x range between; zscore: mean -+ threshold x std."""
    need(df, column)
    v = num(column)
    if method == "iqr":
        q = quantiles_of(df, v, (0.25, 0.75))
        reach = (F.col("q")[1] - F.col("q")[0]) * threshold
        return q.select((F.col("q")[0] - reach).alias("lower_bound"), (F.col("q")[1] + reach).alias("upper_bound"))
    if method == "zscore":
        q = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
        return q.select((F.col("m") - F.col("s") * threshold).alias("lower_bound"), (F.col("m") + F.col("s") * threshold).alias("upper_bound"))
    raise ValueError("method is iqr or zscore")


def outlier_rows(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """The rows outside the bounds."""
    v = num(column)
    return df.crossJoin(F.broadcast(outlier_bounds(df, column, method, threshold))).where((v < F.col("lower_bound")) | (v > F.col("upper_bound"))).drop("lower_bound", "upper_bound")


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row: bounds, total_values, outlier_count, outlier_pct."""
    b = outlier_bounds(df, column, method, threshold)
    v = num(column)
    got = df.crossJoin(F.broadcast(b)).agg(F.count(v).alias("total_values"), F.count_if((v < F.col("lower_bound")) | (v > F.col("upper_bound"))).alias("outlier_count"))
    return got.crossJoin(F.broadcast(b)).select(F.lit(column).alias("column"), F.lit(method).alias("method"), F.lit(float(threshold)).alias("threshold"), "total_values", "outlier_count", pct(F.col("outlier_count"), F.col("total_values")).alias("outlier_pct"), F.round("lower_bound", 4).alias("lower_bound"), F.round("upper_bound", 4).alias("upper_bound"))


def chi_square(cells: DataFrame, by: list[str], correction: bool = False) -> DataFrame:
    """A row a table of ``by``: n, chi_square, cramers_v of its cells (x, y, o: how often); ``correction``: Yates' in a 2 x 2 table.

    From the cells that occur: cells without rows add their expected count, which the totals tell. Totals are windows over a row
    or column of one table and a sum a table; no task has all cells."""
    o, e = F.col("o"), F.col("e")
    totals = cells.groupBy(*by).agg(F.sum("o").alias("n"))
    got = cells.withColumns({"r": F.sum("o").over(Window.partitionBy(*by, "x")), "c": F.sum("o").over(Window.partitionBy(*by, "y"))}).join(totals, by)
    got = got.withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    size = got.groupBy(*by).agg(
        F.first("n").alias("n"), F.sum(o / F.col("r")).alias("rows"), F.sum(o / F.col("c")).alias("cols"), F.sum(o * o / e).alias("q"), F.sum("e").alias("seen"), F.count("*").alias("cells"),
        F.sum(F.pow(F.greatest(F.abs(o - e) - F.least(F.lit(0.5), F.abs(o - e)), F.lit(0.0)), 2) / e).alias("yates"),
    ).withColumns({"rows": F.round("rows").cast("long"), "cols": F.round("cols").cast("long")})
    k = F.least("rows", "cols") - 1
    plain = F.col("q") - F.col("n")
    square = (F.col("rows") == 2) & (F.col("cols") == 2)
    # a 2 x 2 table with an empty cell: that cell's part is (e - 1/2)^2 / e with e the share of n that no seen cell has
    gap = F.col("n") - F.col("seen")
    chi = F.when(square & (F.col("cells") == 4), F.col("yates")).when(square, F.col("yates") + F.when(gap > 0, F.pow(F.greatest(gap - 0.5, F.lit(0.0)), 2) / gap).otherwise(0.0)).otherwise(plain) if correction else plain
    chi = F.greatest(chi, F.lit(0.0))
    return size.select(*by, F.col("n").cast("long").alias("n"), chi.alias("chi_square"), F.coalesce(F.sqrt(ratio(chi, F.col("n") * k)), F.lit(0.0)).alias("cramers_v"))


def cramers_v(df: DataFrame, x: str, y: str, correction: bool = False) -> DataFrame:
    """One row: n, chi_square, cramers_v of two categorical columns; ``correction``: Yates' in a 2 x 2 table. None without values."""
    need(df, x, y)
    cells = df.select(F.lit(0).alias("t"), F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).dropna().groupBy("t", "x", "y").agg(F.count("*").cast("double").alias("o"))
    return chi_square(cells, ["t"], correction).drop("t")


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, n, f_statistic, p_value (one-way analysis of variance) and eta_squared."""
    need(df, group, value)
    g = df.select(F.col(group).cast("string").alias("g"), num(value).alias("v")).dropna().groupBy("g").agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("s2"))
    g = with_total(g, n_all=F.sum("n"), mean=F.sum(F.col("n") * F.col("m")) / F.sum("n"))
    s = g.agg(F.count("*").alias("groups"), F.first("n_all").cast("long").alias("n"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"), F.sum(F.col("n") * F.col("s2")).alias("within"))
    f = ratio(F.col("between") / (F.col("groups") - 1), F.col("within") / (F.col("n") - F.col("groups")))
    s = s.where("groups > 1 and n > groups").withColumn("f_statistic", f)
    return s.select("groups", "n", "f_statistic", f_p_value(F.col("f_statistic"), F.col("groups") - 1, F.col("n") - F.col("groups")).alias("p_value"), F.coalesce(ratio(F.col("between"), F.col("between") + F.col("within")), F.lit(0.0)).alias("eta_squared"))


def relationship_strength(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: x_col, y_col, method, value, interpretation. Two numbers: Pearson; two categories: Cramer's V; else eta
    squared of the number by the category."""
    need(df, x, y)
    numeric = set(numeric_columns(df))
    names = [F.lit(x).alias("x_col"), F.lit(y).alias("y_col")]
    if x in numeric and y in numeric:
        r = df.agg(F.corr(num(x), num(y)).alias("v"))
        return r.select(*names, F.lit("pearson_correlation").alias("method"), F.round("v", 4).alias("value"), correlation_label(F.col("v")).alias("interpretation"))
    if x not in numeric and y not in numeric:
        r = cramers_v(df, x, y)
        return r.select(*names, F.lit("cramers_v").alias("method"), F.round("cramers_v", 4).alias("value"), cramers_label(F.col("cramers_v")).alias("interpretation"))
    group, value = (y, x) if x in numeric else (x, y)
    r = eta_squared(df, group, value)
    return r.select(*names, F.lit("eta_squared").alias("method"), F.round("eta_squared", 4).alias("value"), eta_label(F.col("eta_squared")).alias("interpretation"))


def multi_variable_analysis(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """feature, method, strength, interpretation of every other column against the target."""
    kept = set(numeric_columns(df)) | set(categorical_columns(df))
    got = None
    for c in features or [c for c in df.columns if c != target and c in kept]:
        p = relationship_strength(df, c, target).select(F.col("x_col").alias("feature"), "method", F.col("value").alias("strength"), "interpretation")
        got = p if got is None else got.unionByName(p)
    return got
