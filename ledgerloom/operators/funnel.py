"""Funnels over 0/1 stage columns: conversion, drop-off, bottlenecks, comparison, segments, time between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.quantiles import exact_quantiles
from ledgerloom.functions.semantics import micros, need, num, ratio


def binary_stages(df: DataFrame, stages: list[str]) -> DataFrame:
    """Stage columns as 0 or 1: numbers are clipped, null and other text is 0."""
    need(df, *stages)
    return df.withColumns({s: F.greatest(F.least(F.coalesce(F.expr(f"try_cast(`{s}` AS double)"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for s in stages})


def analyze_funnel(df: DataFrame, stages: list[str], names: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by,) stage_index, stage, count, conversion_rate and drop_off_rate against the stage before (the first: all
    rows), pct_of_first, overall_conversion. Rates are per cent; nobody before: 0."""
    need(df, *stages, *(by or []))
    by = by or []
    src = df.dropna(subset=by) if by else df
    sums = src.groupBy(*by).agg(F.count("*").alias("total"), *[F.coalesce(F.sum(num(s)), F.lit(0.0)).cast("long").alias(f"s{i}") for i, s in enumerate(stages)])
    rows = F.array(*[
        F.struct(
            F.lit(i).cast("long").alias("stage_index"), F.lit((names or stages)[i]).alias("stage"), F.col(f"s{i}").alias("count"),
            F.col("total" if i == 0 else f"s{i - 1}").alias("before"), F.col("s0").alias("first"), F.col(f"s{len(stages) - 1}").alias("last"), F.col("total").alias("total"),
        ) for i in range(len(stages))
    ])
    got = sums.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    rate = F.coalesce(ratio(F.col("count"), F.col("before")) * 100, F.lit(0.0))
    zero = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)) * 100, F.lit(0.0))
    return got.select(*by, "stage_index", "stage", "count", rate.alias("conversion_rate"), F.when(F.col("before") > 0, 100 - rate).otherwise(0.0).alias("drop_off_rate"), zero("count", "first").alias("pct_of_first"), zero("last", "total").alias("overall_conversion"))


def bottlenecks(funnel: DataFrame, threshold: float = 30) -> DataFrame:
    """Stages with a drop-off of ``threshold`` per cent and more, and users_lost since the stage before."""
    before = F.lag("count").over(Window.orderBy("stage_index"))
    return funnel.withColumn("users_lost", F.coalesce(before - F.col("count"), F.lit(0))).where(F.col("drop_off_rate") >= threshold).select("stage", "stage_index", "drop_off_rate", "users_lost")


def compare_funnels(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("Funnel A", "Funnel B")) -> DataFrame:
    """Stage by stage: counts and rates as text of both, and the difference of counts, second minus first."""

    def side(f: DataFrame, n: str) -> DataFrame:
        return f.select("stage_index", F.col("stage").alias(f"stage_{n}"), F.col("count").alias(f"{n}_count"), F.format_string("%.1f%%", "conversion_rate").alias(f"{n}_rate"))

    x, y = names
    return side(a, x).join(side(b, y), "stage_index").select("stage_index", F.col(f"stage_{x}").alias("stage"), f"{x}_count", f"{y}_count", f"{x}_rate", f"{y}_rate", (F.col(f"{y}_count") - F.col(f"{x}_count")).alias("difference"))


def funnel_segments(df: DataFrame, stages: list[str]) -> DataFrame:
    """Rows with each segment they belong to: did_not_start, dropped_at_<stage> (reached it, not the next), completed."""
    need(df, *stages)
    at = [F.coalesce(num(s), F.lit(0.0)) for s in stages]
    found = [F.when(at[0] == 0, F.lit("did_not_start"))]
    found += [F.when((at[i - 1] == 1) & (at[i] == 0), F.lit(f"dropped_at_{stages[i]}")) for i in range(1, len(stages))]
    done = at[0] == 1
    for s in at[1:]:
        done = done & (s == 1)
    found.append(F.when(done, F.lit("completed")))
    return df.withColumn("segment", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))


def funnel_velocity(df: DataFrame, stage_times: list[str]) -> DataFrame:
    """From each stage's time column to the next: users and mean and median days between, of rows that have both."""
    need(df, *stage_times)
    pairs = [F.struct(F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage"), ((micros(b) - micros(a)) / 86_400_000_000).alias("days")) for a, b in zip(stage_times, stage_times[1:])]
    rows = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("days >= 0")
    middle = exact_quantiles(rows, ["from_stage", "to_stage"], "days", (0.5,)).select("from_stage", "to_stage", F.col("q")[0].alias("median_days"))
    return rows.groupBy("from_stage", "to_stage").agg(F.count("*").alias("users"), F.avg("days").alias("avg_days")).join(middle, ["from_stage", "to_stage"])
