"""The same rollups over streams: revenue by window, funnels by session, both with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import need, num


def revenue_by_window(stream: DataFrame, time: str, revenue: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """period_start, revenue, avg_transaction, transactions of each window; rows later than ``late`` are dropped."""
    need(stream, time, revenue)
    w = stream.withWatermark(time, late).groupBy(F.window(time, window))
    return w.agg(F.sum(num(revenue)).alias("revenue"), F.avg(num(revenue)).alias("avg_transaction"), F.count("*").alias("transactions")).select(F.col("window.start").alias("period_start"), "revenue", "avg_transaction", "transactions")


def funnel_by_session(stream: DataFrame, user: str, time: str, kind: str, stages: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, session_start and a 0/1 column for each stage that a session of the user reached."""
    need(stream, user, time, kind)
    g = stream.withWatermark(time, late).groupBy(user, F.session_window(time, gap))
    return g.agg(*[F.max((F.col(kind) == s).cast("int")).alias(s) for s in stages]).select(user, F.col("session_window.start").alias("session_start"), *stages)
