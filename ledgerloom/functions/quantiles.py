"""Exact quantiles of any number of values: radix selection on the bits of the double, a counting pass over the rows a level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.store import stored

#: Bits that are left out at each level: bins of 20, 40, 60 and all 64 bits. A group has at most 2^20 bins at a level.
SHIFTS = (44, 24, 4, 0)


def ordered_bits(v: Column) -> Column:
    """The bits of a double as a whole number that grows with it; unlike doubles have unlike numbers, 0.0 and -0.0 the same. Not for NaN."""
    a = F.abs(v)
    near = F.floor(F.log2(a))
    power = F.pow(F.lit(2.0), near)
    e = near + F.when(a >= power * 2, 1).when(a < power, -1).otherwise(0)  # the logarithm may be off by one at powers of two
    normal = (e + 1023) * (1 << 52) + ((a / F.pow(F.lit(2.0), e) - 1) * float(1 << 52)).cast("long")
    size = F.when(a == 0, 0).when(a == float("inf"), 2047 << 52).when(a < 2.0**-1022, (a / 2.0**-1074).cast("long")).otherwise(normal)
    return F.when(v < 0, -size).otherwise(size)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, probs: tuple[float, ...], name: str = "q", times: str | None = None) -> DataFrame:
    """A row a group of ``by`` (keys that are not null) that has values: ``name``, an array with the quantile of each of ``probs``,
    interpolated between the two values next to it. Null values don't count; there must be no NaN.
    ``times``: a column that tells for how many rows a row stands.

    Rows are counted by the leading bits of their value, a bin a row of the aggregation. Only the bins that hold a wanted
    position go on to the next level, and those of one value end at once; so no buffer grows with the values, whatever they
    are. Each level reads the rows once, mostly there are two. Results of levels, some rows a group, are stored."""
    rows = rows.select(*by, F.col(value).alias("v__"), ordered_bits(F.col(value)).alias("bits__"), (F.col(times) if times else F.lit(1)).alias("t__")).where("v__ is not null")
    window = Window.partitionBy(*by, "in__").orderBy("bin__")
    found, rest = [], None
    for shift in SHIFTS:
        inside = rows.withColumn("in__", F.lit(0).cast("long")) if rest is None else rows.withColumn("in__", F.shiftright("bits__", before)).join(rest, [*by, "in__"], "left_semi")
        bins = inside.groupBy(*by, "in__", F.shiftright("bits__", shift).alias("bin__")).agg((F.sum("t__") if times else F.count("*")).alias("k__"), F.min("v__").alias("lo__"), F.max("v__").alias("hi__"))
        bins = bins.withColumns({"to__": F.sum("k__").over(window), "n__": F.sum("k__").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        if rest is None:  # places from 0, among all and, as ``at``, within the bin
            places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n__") - 1) * F.lit(p)), F.ceil((F.col("n__") - 1) * F.lit(p))) for p in probs])))
            bins = bins.withColumn("want__", F.transform(places, lambda x: F.struct(x.alias("place"), x.alias("at"), F.col("n__").alias("n"))))
        else:
            bins = bins.join(rest, [*by, "in__"])
        start = F.col("to__") - F.col("k__")
        hits = bins.select(*by, "bin__", "lo__", "hi__", start.alias("start__"), F.explode(F.filter("want__", lambda w: (w.at >= start) & (w.at < F.col("to__")))).alias("w"))
        hits = stored(hits, little=True)
        found.append(hits.where("lo__ = hi__").select(*by, F.col("w.place").alias("place__"), F.col("lo__").alias("v__"), F.col("w.n").alias("n__")))
        left = hits.where("lo__ < hi__")
        if left.isEmpty():
            break
        rest = left.groupBy(*by, F.col("bin__").alias("in__")).agg(F.collect_list(F.struct("w.place", (F.col("w.at") - F.col("start__")).alias("at"), "w.n")).alias("want__"))
        before = shift
    values = reduce(DataFrame.unionByName, found).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place__", "v__"))).alias("m__"), F.max("n__").alias("n__"))

    def between(p: float) -> Column:
        at = (F.col("n__") - 1) * F.lit(p)
        low, high = F.element_at("m__", F.floor(at)), F.element_at("m__", F.ceil(at))
        return low + (high - low) * (at - F.floor(at))

    return values.select(*by, F.array(*[between(p) for p in probs]).alias(name))


def quantiles_of(df: DataFrame, value: Column, probs: tuple[float, ...], name: str = "q") -> DataFrame:
    """One row: the quantiles of a column, null where it has no values."""
    got = exact_quantiles(df.select(F.lit(0).alias("g__"), value.alias("v__")), ["g__"], "v__", probs, name)
    return df.sparkSession.range(1).select(F.lit(0).alias("g__")).join(got, "g__", "left").drop("g__")
