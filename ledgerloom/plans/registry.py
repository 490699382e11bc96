"""All queries over the analytics operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("commerce", "journeys", "statistics", "profiles")


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query with its SQL; ``dates`` are the SQL's columns that compare as text."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            _SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, so that sums in any order compare equal, and dates as text."""
    made = {"double": lambda c: F.round(c, digits), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[made.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"ledgerloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
