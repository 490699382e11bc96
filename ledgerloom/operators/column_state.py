"""What a table's columns are, kept as a state that grows with the data: states of parts merge into the state of the whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.semantics import pct, ratio

#: Values of boolean columns, and parts of column names that tell a type.
BOOLEAN_WORDS = ("yes", "no", "true", "false", "ja", "nein")
ID_WORDS = ("id", "_id", "code", "key", "nummer", "number", "uuid", "guid")
CURRENCY_WORDS = ("price", "cost", "revenue", "amount", "total", "sum", "preis", "umsatz", "betrag", "euro", "eur", "usd", "value")
PERCENT_WORDS = ("rate", "percent", "pct", "%", "ratio", "quote", "anteil")
#: Least share of dates, longest value of a category, shares of different values, few values.
DATED, LONG, MOSTLY, HALF, FEW = 0.8, 50, 0.9, 0.5, 20
#: Size of the sketch of different values (2^14 registers: 0.8 per cent) and how near a share may be to its bound to be counted anew.
REGISTERS, NEAR = 14, 0.03


def text_of(df: DataFrame, c: str) -> Column:
    """A text that tells the values of a column of any type apart."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.when(F.col(f"`{c}`").isNotNull(), F.to_json(F.struct(F.col(f"`{c}`"))))
    return F.hex(F.col(f"`{c}`")) if isinstance(kind, T.BinaryType) else F.col(f"`{c}`").cast("string")


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "number" if isinstance(t, T.NumericType) else "text" if isinstance(t, T.StringType) else "other"


def column_state(df: DataFrame) -> DataFrame:
    """A row a column: kind, rows, n (values), least and greatest text and number, dates among texts, length of all texts, mean and
    squared deviation of numbers, and a sketch of the different values. NaN is no value. One pass; each row becomes (column, value) rows
    that are added up where they are read. An empty table has no states."""
    cells = []
    for f in df.schema.fields:
        kind, text = _kind(f.dataType), text_of(df, f.name)
        number = F.col(f"`{f.name}`").cast("double") if kind == "number" else F.lit(None).cast("double")
        text = F.when(~F.isnan(number), text) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else text
        dated = F.try_to_timestamp(text).isNotNull() if kind == "text" else F.lit(False)
        cells.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("kind"), text.alias("text"), F.when(text.isNotNull(), number).alias("number"), dated.alias("dated")))
    rows = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    text, number = F.col("text"), F.col("number")
    return rows.groupBy("column", "kind").agg(
        F.count("*").alias("rows"), F.count(text).alias("n"), F.min(text).alias("lo_text"), F.max(text).alias("hi_text"), F.count_if("dated").alias("dates"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"),
        F.min(number).alias("lo"), F.max(number).alias("hi"), F.avg(number).alias("mean"), (F.var_pop(number) * F.count(number)).alias("m2"), F.hll_sketch_agg(text, F.lit(REGISTERS)).alias("sketch"),
    )


def state_of_kinds(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """What the rules need of ``column_state``, with exact ``unique_count``, from the different values of ``df``'s columns as text and their
    numbers of rows (column, value, k): a value is looked at once, however many rows have it. Mean and deviation are left null.
    Columns of an empty table have states without values."""
    shape = [(f.name, _kind(f.dataType), isinstance(f.dataType, (T.FloatType, T.DoubleType)), isinstance(f.dataType, T.FloatType)) for f in df.schema.fields]
    every = df.sparkSession.createDataFrame(shape, "column string, kind string, nan boolean, narrow boolean")
    rows = kinds.join(F.broadcast(every), "column")
    value, k = F.when(~(F.col("nan") & (F.col("value") == "NaN")), F.col("value")), F.col("k")
    number = F.when(F.col("kind") == "number", F.when(F.col("narrow"), value.try_cast("float").cast("double")).otherwise(value.try_cast("double")))
    dated = F.when(F.col("kind") == "text", F.try_to_timestamp(value)).isNotNull()
    got = rows.groupBy("column").agg(
        F.sum(k).alias("rows"), F.sum(F.when(value.isNotNull(), k)).alias("n"), F.count("value").alias("unique_count"), F.min(value).alias("lo_text"), F.max(value).alias("hi_text"),
        F.sum(F.when(dated, k)).alias("dates"), F.sum(F.length(value) * k).alias("chars"), F.min(number).alias("lo"), F.max(number).alias("hi"),
    )
    empty = F.lit(None).cast("double")
    got = F.broadcast(every.select("column", "kind")).join(got, "column", "left").fillna(0, ["rows", "n", "unique_count", "dates", "chars"])
    return got.withColumns({"mean": empty, "m2": empty})


def merge_states(states: DataFrame) -> DataFrame:
    """The states of a whole from those of its parts."""
    n, mean = F.col("n").cast("double"), F.col("mean")
    total, center = F.sum(F.when(mean.isNotNull(), n)), F.sum(n * mean)
    got = states.groupBy("column", "kind").agg(
        *[F.sum(c).alias(c) for c in ("rows", "n", "dates", "chars")], F.min("lo_text").alias("lo_text"), F.max("hi_text").alias("hi_text"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        ratio(center, total).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"), F.hll_union_agg("sketch").alias("sketch"),
    )
    far = lambda p, m: F.coalesce(p.m2 + p.n * F.pow(p.mean - m, 2), F.lit(0.0))
    m2 = F.when(mean.isNotNull(), F.aggregate("parts", F.lit(0.0), lambda a, p: a + far(p, F.col("mean"))))
    return got.withColumn("m2", m2).select("column", "kind", "rows", "n", "lo_text", "hi_text", "dates", "chars", "lo", "hi", "mean", "m2", "sketch")


def add_to_profile(df: DataFrame, path: str) -> None:
    """Write the state of a part of the data beside those of the parts before."""
    column_state(df).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/part={uuid.uuid4().hex}")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The merged state of all parts written by ``add_to_profile``."""
    return merge_states(spark.read.parquet(path).drop("part"))


def _has(words: tuple[str, ...]) -> Column:
    name = F.lower("column")
    found = F.lit(False)
    for w in words:
        found = found | name.contains(w)
    return found


def typed_states(states: DataFrame) -> DataFrame:
    """column, semantic_type, null_pct, unique_count, unique_pct (of values), avg_length, min, max, mean, std of merged states.

    The first rule that fits: unknown (no values); boolean (booleans, 0 and 1, y and n, or up to two values one of which is a
    boolean word); datetime (also texts of which over 80 per cent are dates); identifier by name; of numbers currency and
    percentage by name, percentage within 0 and 1, numeric; of texts text (over 50 characters a value), identifier (over 90 per
    cent differ, of more than 20), categorical (under half differ, or under 20 values), text.

    ``unique_count`` is taken as it is where the states have it, else estimated by the sketch."""
    if "unique_count" not in states.columns:
        states = states.withColumn("unique_count", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)))
    n, u, kind = F.col("n"), F.col("unique_count"), F.col("kind")
    unique = F.coalesce(ratio(u, n), F.lit(0.0))
    low, high = F.lower("lo_text"), F.lower("hi_text")
    two = (u == 2) & ((kind == "number") & (F.col("lo") == 0) & (F.col("hi") == 1) | (F.col("lo_text") == "n") & (F.col("hi_text") == "y"))
    worded = (u <= 2) & (low.isin(*BOOLEAN_WORDS) | high.isin(*BOOLEAN_WORDS))
    rule = F.when(n == 0, "unknown").when((kind == "boolean") | two | worded, "boolean")
    rule = rule.when((kind == "datetime") | (kind == "text") & (F.col("dates") > n * DATED), "datetime").when(_has(ID_WORDS), "identifier")
    rule = rule.when((kind == "number") & _has(CURRENCY_WORDS), "currency").when((kind == "number") & (_has(PERCENT_WORDS) | (F.col("lo") >= 0) & (F.col("hi") <= 1)), "percentage").when(kind == "number", "numeric")
    length = ratio(F.col("chars"), n)
    rule = rule.when(length > LONG, "text").when((unique > MOSTLY) & (n > FEW), "identifier").when((unique < HALF) | (u < FEW), "categorical").otherwise("text")
    std = F.sqrt(F.col("m2") / F.nullif(n - 1, F.lit(0)))
    return states.select("column", rule.alias("semantic_type"), pct(F.col("rows") - n, F.col("rows")).alias("null_pct"), "unique_count", F.round(unique * 100, 2).alias("unique_pct"), F.round(length, 2).alias("avg_length"), F.col("lo").alias("min"), F.col("hi").alias("max"), "mean", F.when(F.col("mean").isNotNull(), F.coalesce(std, F.lit(0.0))).alias("std"))


def near_a_bound(states: DataFrame) -> list[str]:
    """Texts whose share of different values is so near to a rule's bound that the sketch may err: these are to be counted."""
    share = ratio(F.hll_sketch_estimate("sketch"), F.col("n"))
    near = (F.abs(share - HALF) < NEAR) | (F.abs(share - MOSTLY) < NEAR)
    return [r.column for r in states.where((F.col("kind") == "text") & (F.hll_sketch_estimate("sketch") >= FEW) & near).select("column").collect()]


def profile_types(df: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """``typed_states`` of a table from its states (made if not given): sketches tell, and only columns near a bound are counted exactly."""
    states = column_state(df) if states is None else states
    near = near_a_bound(states)
    if not near:
        return typed_states(states)
    counted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text_of(df, c).alias("v")) for c in near])).alias("x")).select("x.*").where("v is not null").distinct().groupBy("column").agg(F.count("*").alias("exact"))
    told = states.withColumn("about", F.hll_sketch_estimate("sketch")).join(counted, "column", "left")
    return typed_states(told.withColumn("unique_count", F.coalesce("exact", "about", F.lit(0))))
