"""Places of rows in the order of a whole table, and trailing windows over it, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.store import stored

#: Rows of a block of a trailing window.
BLOCK = 200_000


def placed(df: DataFrame, order: list[str | Column], name: str = "place", running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of the columns ``order`` (names: ascending, nulls first), and running sums
    (new name: column) up to and with the row. Rows equal in all of ``order`` are in the order they were read in.

    Rows are dealt by ranges, sorted within, and stored; then only ranges are counted. Neither a frequent value nor a group of
    equal rows meets in one task, as what is equal is dealt by where it was read."""
    running = running or {}
    keys = [*[F.col(f"`{c}`") if isinstance(c, str) else c for c in order], F.col("tie__")]
    dealt = df.withColumn("tie__", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie__")
    dealt = stored(dealt.withColumns({"part__": F.spark_partition_id(), "seq__": F.monotonically_increasing_id()}))
    ranges = dealt.groupBy("part__").agg(F.count("*").alias("k__"), F.min("seq__").alias("first__"), *[F.sum(c).alias(f"s__{n}") for n, c in running.items()])  # a row a range
    earlier = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    ranges = ranges.select("part__", (before("k__") - F.col("first__")).alias("shift__"), *[before(f"s__{n}").alias(f"b__{n}") for n in running])
    got = dealt.join(ranges, "part__").withColumn(name, F.col("seq__") + F.col("shift__"))
    if running:
        upto = Window.partitionBy("part__").orderBy("seq__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        got = got.withColumns({n: F.col(f"b__{n}") + F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in running.items()})
    return got.select(*[F.col(f"`{c}`") for c in df.columns], name, *running)


def trailing(df: DataFrame, order: list[str], rows: int, **made: Column) -> DataFrame:
    """``df`` with window aggregates (new name: aggregate) over each row and the ``rows`` - 1 before it in the order of ``placed``.

    The order is cut into blocks; each carries the last rows of the one before, so a block is a window of its own."""
    at = F.col("place__")
    own = F.floor(at / BLOCK)
    copies = F.array(F.struct(own.alias("block__"), F.lit(True).alias("own__")), F.when(F.pmod(at, F.lit(BLOCK)) > BLOCK - rows, F.struct((own + 1).alias("block__"), F.lit(False).alias("own__"))))
    dealt = placed(df, order, "place__").withColumn("x__", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    dealt = dealt.withColumns({"block__": F.col("x__.block__"), "own__": F.col("x__.own__")})
    window = Window.partitionBy("block__").orderBy("place__").rowsBetween(1 - rows, 0)
    got = dealt.withColumns({n: c.over(window) for n, c in made.items()}).where("own__")
    return got.select(*[F.col(f"`{c}`") for c in df.columns], *made)
