"""Shared rules: columns that must exist, null-safe sums, division, periods, ordered numbering on large tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.order import placed

PERIOD_UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def need(df: DataFrame, *cols: str | None) -> None:
    """Raise a clear error if a named column is absent."""
    absent = [c for c in cols if c is not None and c not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}; there are {', '.join(df.columns)}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def num(c: str | Column) -> Column:
    """A double; NaN counts as null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def total(c: str | Column) -> Column:
    """Sum that is 0 where all is null."""
    return F.coalesce(F.sum(num(c)), F.lit(0.0))


def settled(x: Column) -> Column:
    """A sum of doubles to twelve significant digits: those behind depend on the order of addition, and would tip what is halfway when it is rounded."""
    return F.when(x.isNotNull(), F.format_string("%.11e", x).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(ratio(a, b) * 100, digits)


def period_start(c: str | Column, period: str) -> Column:
    """First day of the period; weeks begin on Monday."""
    if period not in PERIOD_UNIT:
        raise ValueError(f"period is one of {', '.join(PERIOD_UNIT)}")
    return F.to_date(F.date_trunc(PERIOD_UNIT[period], F.col(c) if isinstance(c, str) else c))


def period_label(start: Column, period: str) -> Column:
    """2024-01-01, 2024-01-01/2024-01-07, 2024-01, 2024Q1 or 2024."""
    day = F.date_format(start, "yyyy-MM-dd")
    return {
        "D": day,
        "W": F.concat(day, F.lit("/"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd")),
        "M": F.date_format(start, "yyyy-MM"),
        "Q": F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string")),
        "Y": F.date_format(start, "yyyy"),
    }[period]


def periods_between(a: Column, b: Column, period: str) -> Column:
    """Whole periods from the period of ``a`` to that of ``b``; both are period starts."""
    years = F.year(b) - F.year(a)
    return {
        "D": F.datediff(b, a),
        "W": (F.datediff(b, a) / 7).cast("int"),
        "M": years * 12 + F.month(b) - F.month(a),
        "Q": years * 4 + F.quarter(b) - F.quarter(a),
        "Y": years,
    }[period].cast("long")


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed time in days, rounded down."""
    return F.floor((micros(later) - micros(earlier)) / 86_400_000_000).cast("long")


def with_total(df: DataFrame, **sums: Column) -> DataFrame:
    """Adds one-row aggregates of ``df`` to each of its rows, by a join with a single row, so no row moves."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in sums.items()])))


def numbered(df: DataFrame, value: str, ties: Iterable[str], ascending: bool = False, number: str = "rank", running: dict[str, str] | None = None) -> DataFrame:
    """Adds the position in the order of ``value`` (nulls last) then ``ties``, and running sums (new name: column).

    Rows are dealt by ranges of that order (``order.placed``), so there is no single sorted partition, whatever values are frequent."""
    order = [F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    got = placed(df, order, number, running)
    return got.withColumn(number, (F.col(number) + 1).cast("long"))


def competition_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds 1 + the number of rows of larger value; equal values share it."""
    counts = df.groupBy(value).agg(F.count("*").alias("k__"))
    ranks = numbered(counts, value, [], number="i__", running={"u__": "k__"}).select(F.col(value).alias("v__"), (F.col("u__") - F.col("k__") + 1).cast("long").alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("v__")), "left").drop("v__")


def quantile_bin(position: Column, n: Column, bins: int) -> Column:
    """The 1-based quantile bucket of the ``position``-th of ``n`` rows in order."""
    return F.when(n <= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(((position - 1) * bins + (n - 2)) / F.greatest(n - 1, F.lit(1))))).cast("int")


def sample_skewness(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def sample_kurtosis(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 3, ratio(n - 1, F.nullif((n - 2) * (n - 3), F.lit(0))) * ((n + 1) * F.kurtosis(c) + 6))
