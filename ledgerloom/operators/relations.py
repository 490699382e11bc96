"""Relationships between all columns of a table, whatever their types, in three passes over it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.dist import f_p_value
from ledgerloom.functions.semantics import need, num, numeric_columns, ratio
from ledgerloom.functions.store import stored
from ledgerloom.operators.association import chi_square

#: Label texts by the value they have to exceed.
CRAMERS_STRENGTHS = ((0.5, "Strong"), (0.3, "Moderate"), (0.1, "Weak"), (None, "Very weak"))
ETA_STRENGTHS = ((0.14, "Large"), (0.06, "Medium"), (0.01, "Small"), (None, "Very small"))
#: Most values of a number that counts as a category, and of a category that numbers are compared by.
MAX_CATEGORIES, MAX_GROUPS = 10, 20
LEAST_V, ALPHA, CORRELATED = 0.1, 0.05, 0.3


def _over(v: Column, labels: tuple) -> Column:
    out = F.lit(labels[-1][1])
    for least, text in reversed(labels[:-1]):
        out = F.when(v > least, text).otherwise(out)
    return out


def cramers_strength(v: Column) -> Column:
    """Strong over 0.5, Moderate over 0.3, Weak over 0.1, else Very weak."""
    return _over(v, CRAMERS_STRENGTHS)


def eta_strength(e: Column) -> Column:
    """Large over 0.14, Medium over 0.06, Small over 0.01, else Very small."""
    return _over(e, ETA_STRENGTHS)


def few_values(df: DataFrame, columns: list[str], most: int) -> dict[str, int]:
    """The number of values of each column (nulls aside); ``most`` + 1 where there are more. A task keeps no more than
    ``most`` + 1 values of a column, and no more go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in columns]
        for batch in batches:
            for kept, column in zip(seen, batch.columns, strict=True):
                if len(kept) <= most:
                    found = pc.unique(column.drop_null())
                    kept.update(str(x.as_py()) for x in found.slice(0, len(kept) + most + 1))
        rows = [(i, v) for i, kept in enumerate(seen) for v in sorted(kept)[: most + 1]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], ["i", "v"])

    got = df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, "i int, v string").groupBy("i").agg(F.count_distinct("v").alias("n"))
    n = {r.i: r.n for r in got.collect()}
    return {c: min(most + 1, n.get(i, 0)) for i, c in enumerate(columns)}


def column_kinds(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> tuple[list[str], list[str], list[str]]:
    """Numbers; categories, with numbers of at most ``max_categories`` values among them; and the categories of at most MAX_GROUPS values.
    Lists, maps and structs are neither."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    n = few_values(df, plain, max(max_categories, MAX_GROUPS))
    numbers = [c for c in plain if c in set(numeric_columns(df)) and n[c] > max_categories]
    return numbers, [c for c in plain if c not in numbers], [c for c in plain if c not in numbers and n[c] <= MAX_GROUPS]


def _exploded(one: DataFrame, structs: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def mixed_correlations(df: DataFrame, columns: list[str] | None = None, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """kind, var1, var2, value, f_statistic, p_value, strength of all pairs of columns that are related.

    numeric: Pearson of every two numbers (no strength). categorical: Cramer's V (Yates' correction in 2 x 2 tables) over 0.1.
    mixed: eta squared of a number by a category of at most 20 values, where the analysis of variance gives p < 0.05. Numbers of
    at most ``max_categories`` values are categories. Pairs leave out rows where either is null.

    One pass counts values; one explodes each row into its pairs of categories and its categories, which a single aggregation
    makes cells; one makes all correlations. So there are as many passes for any number of columns."""
    need(df, *(columns or []))
    df = df.select(*[F.col(f"`{c}`") for c in columns or df.columns])
    numbers, categories, groups = column_kinds(df, max_categories)
    pairs, number_pairs = list(combinations(categories, 2)), list(combinations(numbers, 2))
    schema = "kind string, var1 string, var2 string, value double, f_statistic double, p_value double, strength string"
    got = df.sparkSession.createDataFrame([], schema)
    null = F.lit(None).cast("double")
    names = lambda kind, a, b: (F.lit(kind).alias("kind"), F.element_at(F.array(*map(F.lit, a)), F.col("i")).alias("var1"), F.element_at(F.array(*map(F.lit, b)), F.col("j")).alias("var2"))
    v = {c: num(f"`{c}`") for c in numbers}
    whole = df.agg(F.count("*").alias("rows"), *[F.corr(v[a], v[b]).alias(f"r{k}") for k, (a, b) in enumerate(number_pairs)], *[f(v[c]).alias(f"{n}{k}") for k, c in enumerate(numbers) for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_pop))])
    whole = stored(whole)
    if number_pairs:
        rows = _exploded(whole, [F.struct(F.lit(numbers.index(a) + 1).alias("i"), F.lit(numbers.index(b) + 1).alias("j"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(number_pairs)])
        got = got.unionByName(rows.select(*names("numeric", numbers, numbers), F.when(~F.isnan("r"), F.col("r")).alias("value"), null.alias("f_statistic"), null.alias("p_value"), F.lit(None).cast("string").alias("strength")))
    if not categories or not pairs and not (numbers and groups):
        return got
    text = {c: F.col(f"`{c}`").cast("string") for c in categories}
    at = {c: i + 1 for i, c in enumerate(categories)}
    cell = lambda i, j, x, y: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x.alias("x"), y.alias("y"))
    parts = [cell(at[a], at[b], text[a], text[b]) for a, b in pairs]
    parts += [cell(at[g], 0, text[g], F.lit("")) for g in groups] if numbers else []
    rows = df.select(*[v[c].alias(f"v{k}") for k, c in enumerate(numbers)], F.explode(F.array(*parts)).alias("c")).where("c.x is not null and c.y is not null")
    alone = lambda k: F.when(F.col("c.j") == 0, F.col(f"v{k}"))
    stats = [f(alone(k)).alias(f"{n}{k}") for k in range(len(numbers)) for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_pop))] if groups else []
    cells = stored(rows.groupBy("c.i", "c.j", "c.x", "c.y").agg(F.count("*").cast("double").alias("o"), *stats))
    if pairs:
        chi = chi_square(cells.where("j > 0"), ["i", "j"], True).where(F.col("cramers_v") > LEAST_V)
        got = got.unionByName(chi.select(*names("categorical", categories, categories), F.col("cramers_v").alias("value"), null.alias("f_statistic"), null.alias("p_value"), cramers_strength(F.col("cramers_v")).alias("strength")))
    if numbers and groups:
        got = got.unionByName(_mixed(cells.where("j = 0"), whole, numbers).select(*names("mixed", numbers, categories), "value", "f_statistic", "p_value", eta_strength(F.col("value")).alias("strength")))
    return got


def _mixed(cells: DataFrame, whole: DataFrame, numbers: list[str]) -> DataFrame:
    """i (number), j (category), value, f_statistic, p_value from the groups' sizes, means and variances; eta squared against all rows
    that have the number, with a category or without."""
    groups = cells.select(F.col("i").alias("j"), F.explode(F.array(*[F.struct(F.lit(k + 1).alias("i"), F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("m"), F.col(f"s{k}").alias("s")) for k in range(len(numbers))])).alias("g")).select("j", "g.*").where("n > 0")
    whole = _exploded(whole, [F.struct(F.lit(k + 1).alias("i"), F.col(f"m{k}").alias("all_m"), (F.col(f"n{k}") * F.col(f"s{k}")).alias("total")) for k in range(len(numbers))])
    own = Window.partitionBy("i", "j")
    groups = groups.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own)).join(whole, "i")
    s = groups.groupBy("i", "j").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("all_m"), 2)).alias("apart"), F.first("total").alias("total"),
    ).where("k > 1 and n > k")
    sure = (F.col("within") == 0) & (F.col("between") > 0)
    f = F.when(sure, float("inf")).otherwise(ratio(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))))
    s = s.withColumn("f_statistic", f).withColumn("p_value", F.when(sure, 0.0).otherwise(f_p_value(f, F.col("k") - 1, F.col("n") - F.col("k"))))
    return s.where(F.col("p_value") < ALPHA).withColumn("value", F.coalesce(ratio(F.col("apart"), F.col("total")), F.lit(0.0)))


def find_all_relationships(df: DataFrame, threshold: float = 0.3, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``mixed_correlations`` with abs_value, type (positive or negative, of numbers) and is_strong: at or over the
    threshold; mixed ones, as they are significant, always."""
    got = mixed_correlations(df, columns)
    sign = F.when(F.col("kind") == "numeric", F.when(F.col("value") > 0, "positive").otherwise("negative"))
    return got.withColumns({"abs_value": F.abs("value"), "type": sign, "is_strong": F.coalesce(F.abs("value") >= threshold, F.lit(False)) | (F.col("kind") == "mixed")})


def numeric_matrix(relationships: DataFrame) -> DataFrame:
    """var1, var2, correlation in both orders and with the diagonal, from the rows of ``mixed_correlations``."""
    half = relationships.where("kind = 'numeric'").select("var1", "var2", F.col("value").alias("correlation"))
    names = half.select("var1").union(half.select("var2")).distinct()
    return half.unionByName(half.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "correlation")).unionByName(names.select("var1", F.col("var1").alias("var2"), F.lit(1.0).alias("correlation")))


def mixed_summary(df: DataFrame, columns: list[str] | None = None, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """One row: total_columns, numeric_columns, categorical_columns, and the numbers of numeric_correlations_found (pairs over 0.3 either
    way), categorical_associations_found and numeric_categorical_relationships."""
    df = df.select(*[F.col(f"`{c}`") for c in columns or df.columns])
    numbers, categories, _ = column_kinds(df, max_categories)
    kind = F.col("kind")
    found = mixed_correlations(df, None, max_categories).agg(
        F.count_if((kind == "numeric") & (F.abs("value") > CORRELATED)).alias("numeric_correlations_found"),
        F.count_if(kind == "categorical").alias("categorical_associations_found"), F.count_if(kind == "mixed").alias("numeric_categorical_relationships"),
    )
    sizes = {"total_columns": len(df.columns), "numeric_columns": len(numbers), "categorical_columns": len(categories)}
    return found.select(*[F.lit(n).cast("long").alias(c) for c, n in sizes.items()], *found.columns)
