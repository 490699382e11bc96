"""Profiles and cleaning: summaries, distributions, quality, semantic types, column roles, filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.quantiles import exact_quantiles, quantiles_of
from ledgerloom.functions.semantics import categorical_columns, need, num, numbered, numeric_columns, pct, period_start, ratio, sample_kurtosis, sample_skewness, total, whole_days, with_total
from ledgerloom.functions.store import stored
from ledgerloom.operators.column_state import profile_types, state_of_kinds, text_of, typed_states

PERCENTILES = (5, 10, 25, 50, 75, 90, 95)
QUARTILES = (0.25, 0.5, 0.75)


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, v of all rows; null stays, so that missing values count."""
    return df.select(*[num(c).alias(c) for c in columns]).unpivot([], columns, "column", "v")


def numeric_summary(df: DataFrame, columns: list[str] | None = None, digits: int = 4, outliers_beyond: float = 1.5) -> DataFrame:
    """A row a column: count, missing, missing_pct, mean, median, std, min, max, q25, q75, iqr, skewness, has_outliers,
    outlier_count (beyond ``outliers_beyond`` x iqr from the quartiles), sum. All columns in one pass, outliers in a second."""
    columns = columns or numeric_columns(df)
    need(df, *columns)
    long, v = _long(df, columns), F.col("v")
    s = long.groupBy("column").agg(
        F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), sample_skewness(v).alias("skewness"), total("v").alias("sum"),
    )
    s = stored(s.join(exact_quantiles(long, ["column"], "v", QUARTILES), "column", "left"), little=True)
    low, high = F.col("q")[0], F.col("q")[2]
    s = s.withColumns({"lo": low - (high - low) * outliers_beyond, "hi": high + (high - low) * outliers_beyond})
    out = long.join(F.broadcast(s.select("column", "lo", "hi")), "column").groupBy("column").agg(F.count_if((v < F.col("lo")) | (v > F.col("hi"))).alias("outlier_count"))
    r = lambda c: F.round(c, digits)
    return s.join(F.broadcast(out), "column").select(
        "column", "count", "missing", pct(F.col("missing"), F.col("count") + F.col("missing")).alias("missing_pct"), r("mean").alias("mean"), r(F.col("q")[1]).alias("median"), r("std").alias("std"), r("min").alias("min"), r("max").alias("max"),
        r(low).alias("q25"), r(high).alias("q75"), r(high - low).alias("iqr"), r("skewness").alias("skewness"), (F.col("outlier_count") > 0).alias("has_outliers"), "outlier_count", r("sum").alias("sum"),
    )


def _counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, columns: list[str] | None = None, top_n: int = 10) -> DataFrame:
    """column, rank, value, n: the most frequent values of each column; ties by value."""
    columns = columns or categorical_columns(df)
    need(df, *columns)
    got = _counts(df, columns).where("value is not null")
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("column", F.col("rank").cast("long").alias("rank"), "value", "n")


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row a column: count, missing, missing_pct, unique_count, top_value, top_count, top_pct."""
    columns = columns or categorical_columns(df)
    need(df, *columns)
    c = _counts(df, columns)
    n = F.when(F.col("value").isNotNull(), F.col("n"))
    first = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("value").alias("value"))))
    got = c.groupBy("column").agg(F.coalesce(F.sum(n), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("unique_count"), first.alias("t"))
    return got.select("column", "count", "missing", pct(F.col("missing"), F.col("count") + F.col("missing")).alias("missing_pct"), "unique_count", F.col("t.value").alias("top_value"), (-F.col("t.k")).alias("top_count"), pct(-F.col("t.k"), F.col("count")).alias("top_pct"))


def datetime_range(df: DataFrame, column: str) -> DataFrame:
    need(df, column)
    got = df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.count_distinct(F.to_date(column)).alias("unique_dates"))
    return got.select(F.lit(column).alias("column"), "min", "max", whole_days(F.col("max"), F.col("min")).alias("range_days"), "unique_dates")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, duplicates (rows beyond the first of their kind)."""
    got = df.groupBy(*df.columns).agg(F.count("*").alias("k"))
    return got.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates"))


def quick_stats(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric_columns, missing_pct, duplicates, and total_x and avg_x of each number."""
    nums = numeric_columns(df)
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    s = df.agg(F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(len(nums)).cast("long").alias("numeric_columns"), missing.alias("m"), *[a for c in nums for a in (F.round(total(c), 2).alias(f"total_{c}"), F.round(F.avg(num(c)), 2).alias(f"avg_{c}"))])
    got = duplicate_rows(df).crossJoin(F.broadcast(s))
    return got.withColumn("missing_pct", F.coalesce(pct(F.col("m"), F.col("rows") * len(df.columns)), F.lit(0.0))).drop("m")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std, min, max, range, p5 ... p95, skewness, kurtosis; two digits. No values, no row."""
    need(df, column)
    v = num(column)
    s = df.select(v.alias("v")).agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), sample_skewness(F.col("v")).alias("skewness"), sample_kurtosis(F.col("v")).alias("kurtosis"))
    s = s.crossJoin(F.broadcast(quantiles_of(df, v, tuple(p / 100 for p in PERCENTILES), "p")))  # a row each
    r = lambda c: F.round(c, 2)
    return s.where("count > 0").select("count", r("mean").alias("mean"), F.coalesce(r("std"), F.lit(0.0)).alias("std"), r("min").alias("min"), r("max").alias("max"), r(F.col("max") - F.col("min")).alias("range"), *[r(F.col("p")[i]).alias(f"p{p}") for i, p in enumerate(PERCENTILES)], r("skewness").alias("skewness"), F.coalesce(r("kurtosis"), F.lit(0.0)).alias("kurtosis"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, count, mean, std, min, q25, median, q75, max with two digits and exact quartiles."""
    columns = columns or numeric_columns(df)
    v = F.col("v")
    got = _long(df, columns).groupBy("column").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    got = got.join(exact_quantiles(_long(df, columns), ["column"], "v", QUARTILES), "column", "left")
    r = lambda c: F.round(c, 2)
    return got.select("column", "count", r("mean").alias("mean"), r("std").alias("std"), r("min").alias("min"), r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("q75"), r("max").alias("max"))


def compare_periods(df: DataFrame, date: str, value: str, period: str = "M") -> DataFrame:
    """Per period: total, average, count, prev_total, change, change_pct."""
    need(df, date, value)
    rows = df.select(period_start(date, period).alias("period"), num(value).alias("v")).where("period is not null")
    got = rows.groupBy("period").agg(total("v").alias("total"), F.avg("v").alias("average"), F.count("v").alias("count"))
    prev = F.lag("total").over(Window.orderBy("period"))
    return got.withColumns({"prev_total": prev, "change": F.col("total") - prev, "change_pct": pct(F.col("total") - prev, prev)})


def top_performers(df: DataFrame, group: str, value: str, n: int = 10, ascending: bool = False) -> DataFrame:
    """group, total, average, count, share_pct, rank of the ``n`` first by total; ties by group."""
    need(df, group, value)
    got = df.where(F.col(group).isNotNull()).groupBy(group).agg(total(value).alias("total"), F.avg(num(value)).alias("average"), F.count(num(value)).alias("count"))
    got = with_total(stored(got), all__=F.sum("total")).withColumn("share_pct", pct(F.col("total"), F.col("all__"))).drop("all__")
    return numbered(got, "total", [group], ascending=ascending).where(F.col("rank") <= n)


def _kinds(df: DataFrame) -> DataFrame:
    """column, value (as text), k: the different values of all columns, null with them, and their rows."""
    texts = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), text_of(df, c)).alias(c) for c in df.columns])
    return texts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "value").groupBy("column", "value").agg(F.count("*").alias("k"))


def missing_values(df: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """column, non_null, missing, missing_pct, unique_count. Columns become (column, value) rows, which one aggregation counts."""
    kinds = _kinds(df) if kinds is None else kinds
    there = F.col("value").isNotNull()
    got = kinds.groupBy("column").agg(F.coalesce(F.sum(F.when(there, F.col("k"))), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(~there, F.col("k"))), F.lit(0)).alias("missing"), F.count("value").alias("unique_count"))
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")  # also those of an empty table
    got = F.broadcast(every).join(got, "column", "left").fillna(0, ["non_null", "missing", "unique_count"])
    return got.select("column", "non_null", "missing", pct(F.col("missing"), F.col("missing") + F.col("non_null")).alias("missing_pct"), "unique_count")


def column_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """A row a column: its semantic type, non_null, null_count, null_pct, unique_count, unique_pct, sample_values (the first in order),
    and of numbers min, max, mean, median and std (0 of a single value)."""
    m = missing_values(df)
    kinds = semantic_types(df).select("column", "semantic_type")
    texts = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), text_of(df, c)).alias(c) for c in df.columns])
    first = texts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "value").where("value is not null").distinct()
    first = first.withColumn("i", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("i") <= samples)
    first = first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    got = m.join(kinds, "column").join(first, "column", "left")
    names = numeric_columns(df)
    stats = ["min", "max", "mean", "median", "std"]
    if names:
        got = got.join(numeric_summary(df, names).select("column", *stats), "column", "left").withColumn("std", F.when(F.col("mean").isNotNull(), F.coalesce("std", F.lit(0.0))))
    else:
        got = got.withColumns({c: F.lit(None).cast("double") for c in stats})
    rows = F.col("non_null") + F.col("missing")
    return got.select("column", "semantic_type", "non_null", F.col("missing").alias("null_count"), F.coalesce("missing_pct", F.lit(0.0)).alias("null_pct"), "unique_count", F.coalesce(pct(F.col("unique_count"), rows), F.lit(0.0)).alias("unique_pct"), "sample_values", *stats)


def profile_score(df: DataFrame) -> DataFrame:
    """One row: rows, columns, quality_score, issues, recommendations (texts, in order).

    Issues: over half of a column missing, a single value, repeated rows. Recommendations: over a fifth missing, numbers of which
    over 95 per cent differ. The score is 100 less 10 an issue, 3 a recommendation and 30 times the share of missing cells,
    from 0 to 100."""
    p = missing_values(df).join(semantic_types(df).select("column", "semantic_type"), "column")
    rows = F.col("non_null") + F.col("missing")
    named = lambda text: F.concat("column", F.lit(text))
    issue = F.array(F.when(F.col("missing_pct") > 50, named(": over half is missing")), F.when((F.col("unique_count") == 1) & (F.col("non_null") > 0), named(": a single value")))
    advice = F.array(F.when((F.col("missing_pct") > 20) & (F.col("missing_pct") <= 50), named(": fill in what is missing")), F.when((F.col("semantic_type") == "numeric") & (pct(F.col("unique_count"), rows) > 95), named(": may be an identifier")))
    listed = lambda c: F.array_sort(F.flatten(F.collect_list(F.filter(c, lambda x: x.isNotNull()))))
    got = p.agg(listed(issue).alias("issues"), listed(advice).alias("recommendations"), (F.sum("missing") / F.nullif(F.sum(rows), F.lit(0))).alias("null_rate"), F.count("*").alias("columns"))
    got = duplicate_rows(df).crossJoin(F.broadcast(got))
    issues = F.when(F.col("duplicates") > 0, F.array_append("issues", F.lit("repeated rows"))).otherwise(F.col("issues"))
    score = 100 - F.size(issues) * 10 - F.size("recommendations") * 3 - F.coalesce("null_rate", F.lit(0.0)) * 30
    return got.select("rows", "columns", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("quality_score"), issues.alias("issues"), "recommendations")


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric, categorical and datetime columns, total_missing, total_missing_pct, duplicate_rows."""
    m = missing_values(df).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("total_missing"), F.sum(F.col("missing") + F.col("non_null")).alias("cells"))
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    lists = {"numeric_columns": numeric_columns(df), "categorical_columns": categorical_columns(df), "datetime_columns": dates}
    got = duplicate_rows(df).crossJoin(F.broadcast(m))
    return got.select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"), *[F.lit(", ".join(v)).alias(k) for k, v in lists.items()],
        "total_missing", F.coalesce(pct(F.col("total_missing"), F.col("cells")), F.lit(0.0)).alias("total_missing_pct"), F.col("duplicates").alias("duplicate_rows"),
    )


def summary_insights(df: DataFrame) -> DataFrame:
    """kind, column, value: what the summaries of a table say. Of the table: empty; small (under 100 rows), large (over 100,000);
    missing (over 20 per cent of all cells); duplicates (rows). Of numbers: outliers (over 5 per cent), skewed (over 2), missing
    (over 30 per cent). Of categories: dominated (over 80 per cent), cardinality (over 100). Of the first date: short (under 7
    days), long (over 365, in years)."""
    d = dataset_summary(df)
    one = lambda when, kind, value, column=F.lit(None).cast("string"): F.when(when, F.struct(F.lit(kind).alias("kind"), column.alias("column"), value.cast("double").alias("value")))
    told = lambda rows, *found: rows.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("x.*")
    rows, column = F.col("rows"), F.col("column")
    parts = [told(d, one(rows == 0, "empty", rows), one(rows.between(1, 99), "small", rows), one(rows > 100_000, "large", rows), one(F.col("total_missing_pct") > 20, "missing", F.col("total_missing_pct")), one(F.col("duplicate_rows") > 0, "duplicates", F.col("duplicate_rows")))]
    if names := numeric_columns(df):
        share = ratio(F.col("outlier_count"), F.col("count")) * 100
        parts.append(told(numeric_summary(df, names), one(share > 5, "outliers", share, column), one(F.abs("skewness") > 2, "skewed", F.col("skewness"), column), one(F.col("missing_pct") > 30, "missing", F.col("missing_pct"), column)))
    if names := categorical_columns(df):
        parts.append(told(categorical_summary(df, names), one(F.col("top_pct") > 80, "dominated", F.col("top_pct"), column), one(F.col("unique_count") > 100, "cardinality", F.col("unique_count"), column)))
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    if dates:
        days = F.col("range_days")
        parts.append(told(datetime_range(df, dates[0]), one(days < 7, "short", days, column), one(days > 365, "long", days / 365, column)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_quality(df: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """One row: rows, missing_pct, duplicate_pct, constant_columns, n_numeric, level and warnings.

    Steps: missing over 10, 30, 50 per cent; duplicates over 5, 20, 50; rows under 100, 50, 10; no number; constants."""
    m = missing_values(df, kinds).agg(F.sum("missing").alias("m"), F.sum(F.col("missing") + F.col("non_null")).alias("cells"), F.count_if(F.col("unique_count") <= 1).alias("constant_columns"))
    d = duplicate_rows(df)
    n_num = len(numeric_columns(df))
    got = d.crossJoin(F.broadcast(m)).select("rows", F.coalesce(pct(F.col("m"), F.col("cells")), F.lit(0.0)).alias("missing_pct"), F.coalesce(pct(F.col("duplicates"), F.col("rows")), F.lit(0.0)).alias("duplicate_pct"), "constant_columns", F.lit(n_num).cast("long").alias("n_numeric"))

    def grade(c: Column, steps: tuple[float, float, float], below: bool = False) -> Column:
        worse = (lambda s: c < s) if below else (lambda s: c > s)
        return F.when(worse(steps[2]), 3).when(worse(steps[1]), 2).when(worse(steps[0]), 1).otherwise(0)

    g = {"missing values": grade(F.col("missing_pct"), (10, 30, 50)), "duplicate rows": grade(F.col("duplicate_pct"), (5, 20, 50)), "few rows": grade(F.col("rows"), (100, 50, 10), True), "no numeric column": F.when(F.col("n_numeric") == 0, 2).otherwise(0), "constant columns": F.when(F.col("constant_columns") > 0, 1).otherwise(0)}
    worst = F.greatest(*g.values())
    found = F.filter(F.array(*[F.when(v > 0, F.lit(k)) for k, v in g.items()]), lambda x: x.isNotNull())
    return got.withColumns({"level": F.when(worst == 3, "critical").when(worst == 2, "poor").when(worst == 1, "fair").otherwise("good"), "warnings": F.array_join(found, ", ")})


# Semantic types ----------------------------------------------------------------------------------------------------

def semantic_types(df: DataFrame) -> DataFrame:
    """column, semantic_type, null_pct, unique_pct (of values), avg_length, by the rules of ``column_state.typed_states`` with exact counts
    of different values: one aggregation of (column, value) rows, and the states from the different values with their numbers of
    rows. ``column_state.profile_types`` takes sketches instead."""
    return typed_states(state_of_kinds(df, _kinds(df))).select("column", "semantic_type", "null_pct", "unique_pct", "avg_length")


@dataclass(frozen=True)
class ColumnMapping:
    date: str | None = None
    revenue: str | None = None
    quantity: str | None = None
    customer: str | None = None
    product: str | None = None
    category: str | None = None
    channel: str | None = None


#: Of each role the semantic type and parts of the name.
MAPPING_WORDS = {
    "revenue": ("numeric", ("revenue", "umsatz", "sales", "total", "amount")),
    "quantity": ("numeric", ("qty", "quantity", "menge", "anzahl", "count", "units")),
    "customer": ("identifier", ("customer", "kunde", "user", "client", "buyer")),
    "product": ("identifier", ("product", "produkt", "item", "sku", "article", "artikel")),
    "category": ("categorical", ("category", "kategorie", "type", "typ", "group", "segment")),
    "channel": ("categorical", ("channel", "kanal", "source", "quelle", "medium", "platform")),
}


def suggest_mapping(df: DataFrame, types: dict[str, str] | None = None) -> ColumnMapping:
    """Roles by semantic type (``types``, or those of ``profile_types``) and name: the first date; the first currency, unless a number
    named as a revenue comes; of the other roles the last column that fits."""
    types = types or {r.column: r.semantic_type for r in profile_types(df).select("column", "semantic_type").collect()}
    found: dict[str, str] = {}
    for c in df.columns:
        kind, name = types.get(c, "unknown"), c.lower()
        if kind == "datetime":
            found.setdefault("date", c)
        if kind == "currency":
            found.setdefault("revenue", c)
        for role, (needed, words) in MAPPING_WORDS.items():
            if kind == needed and any(w in name for w in words):
                found[role] = c
    return ColumnMapping(**found)


#: Parts of column names that tell a role.
ROLE_ID_WORDS = ("id", "_id", "code", "key", "nummer", "number")
REVENUE_WORDS = ("revenue", "sales", "amount", "total", "price", "cost", "profit", "umsatz")
QUANTITY_WORDS = ("qty", "quantity", "units", "count", "menge")
CATEGORY_WORDS = ("category", "type", "channel", "region", "segment")


@dataclass(frozen=True)
class ColumnRoles:
    """Columns by role, each in one list."""

    id: list[str] = field(default_factory=list)
    date: list[str] = field(default_factory=list)
    revenue: list[str] = field(default_factory=list)
    quantity: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    measure: list[str] = field(default_factory=list)
    dimension: list[str] = field(default_factory=list)

    @property
    def numeric(self) -> list[str]:
        return [*self.revenue, *self.quantity, *self.measure]

    @property
    def categorical(self) -> list[str]:
        return [*self.category, *self.dimension]


def column_roles(df: DataFrame) -> ColumnRoles:
    """By type, name and, of texts named as categories, the number of different values (under 20, or under half of the rows):
    ids are told before numbers; booleans are dimensions."""
    roles = ColumnRoles()
    has = lambda name, words: any(w in name for w in words)
    named = []
    for f in df.schema.fields:
        name = f.name.lower()
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            roles.date.append(f.name)
        elif has(name, ROLE_ID_WORDS):
            roles.id.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            (roles.revenue if has(name, REVENUE_WORDS) else roles.quantity if has(name, QUANTITY_WORDS) else roles.measure).append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            named.append(f.name)
    asked = [c for c in named if has(c.lower(), CATEGORY_WORDS)]
    few = set()
    if asked:
        counts = missing_values(df.select(*[F.col(f"`{c}`") for c in asked])).where((F.col("unique_count") < 20) | (F.col("unique_count") < (F.col("missing") + F.col("non_null")) / 2))
        few = {r.column for r in counts.collect()}
    for c in named:
        (roles.category if c in few else roles.dimension).append(c)
    return roles


def validate_for_analysis(df: DataFrame, required: tuple[str, ...] = ()) -> list[str]:
    """What stands against an analysis: no rows, fewer than two, semantic types that no column has. Empty: nothing."""
    rows = df.limit(2).count()
    if rows < 2 or not df.columns:
        return ["the table is empty" if rows == 0 or not df.columns else "fewer than two rows"]
    found = {r.semantic_type for r in profile_types(df).select("semantic_type").distinct().collect()} if required else set()
    return [f"no {t} column" for t in required if t not in found]


# Cleaning ----------------------------------------------------------------------------------------------------------


def cleaned_number(c: str | Column) -> Column:
    """Text with currency signs, thousands commas, per cent signs or accounting brackets as a double, else null."""
    t = F.regexp_replace(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), r"[$€£,\s%]", "")
    t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    return t.try_cast("double")


def clean_numeric(df: DataFrame, columns: list[str] | None = None, least: float = 0.8) -> DataFrame:
    """Text columns of which more than ``least`` of the values are numbers become doubles; decided over all rows."""
    texts = [c for c in (columns or df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return df
    shares = df.agg(*[ratio(F.count(cleaned_number(c)), F.count(c)).alias(c) for c in texts]).first()
    return df.withColumns({c: cleaned_number(c) for c in texts if (shares[c] or 0) > least})


def clean_names(df: DataFrame) -> DataFrame:
    """Names trimmed, in lower case, with anything but letters and digits as one underscore; repeats get a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = re.sub(r"\W+", "_", c.strip().lower()).strip("_") or "column"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*out)


def auto_clean(df: DataFrame) -> DataFrame:
    """Clean names, trimmed texts (blank: null), numbers out of texts, dates where the name says so and over 80 % parse."""
    df = clean_names(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in texts}) if texts else df
    named = [c for c in texts if any(w in c for w in ("date", "datum", "time", "created", "updated"))]
    df = clean_numeric(df, [c for c in texts if c not in named]) if texts else df
    if named:
        shares = df.agg(*[ratio(F.count(F.try_to_timestamp(c)), F.count(c)).alias(c) for c in named]).first()
        df = df.withColumns({c: F.try_to_timestamp(c) for c in named if (shares[c] or 0) > 0.8})
    return df


def prepare_for_analysis(df: DataFrame) -> DataFrame:
    """``auto_clean`` without rows and columns that are all null."""
    df = auto_clean(df).na.drop("all")
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])


def filtered(df: DataFrame, dates: dict[str, tuple] | None = None, ranges: dict[str, tuple[float, float]] | None = None, values: dict[str, list] | None = None) -> DataFrame:
    """Rows within all date and number ranges (both ends count) and lists of values; all reach the scan."""
    need(df, *(dates or {}), *(ranges or {}), *(values or {}))
    for c, (a, b) in {**(dates or {}), **(ranges or {})}.items():
        df = df.where(F.col(c).between(F.lit(a), F.lit(b)))
    for c, v in (values or {}).items():
        df = df.where(F.col(c).isin(v))
    return df
