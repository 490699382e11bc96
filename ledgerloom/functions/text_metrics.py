"""Figures in running text: currencies, percentages, ratios and label-value pairs, by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import need

CURRENCY = r"([$€£]\s?\d[\d.,]*\s?(?:K|M|B|Mio|Mrd|k|m|bn)?\b)"
PERCENT = r"([-+]?\d+(?:[.,]\d+)?\s?%)"
RATIO = r"\b(\d+(?:\.\d+)?\s?[:x]\s?\d+(?:\.\d+)?)\b"
KPI = r"([A-Za-z][A-Za-z ]{2,49})\s*[:=]\s*([$€£]?\s?[-+]?\d[\d.,]*\s?%?)"


def parsed_number(text: Column) -> Column:
    """A figure with signs around it as a double; the last of comma and dot is the decimal mark if at most two digits follow."""
    t = F.regexp_replace(text, r"[^\d.,+-]", "")
    comma = t.rlike(r",\d{1,2}$")
    plain = F.when(comma, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def text_metrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind (currency, percentage, ratio, kpi), position, label (of a kpi), value, number; a row for each find."""
    need(df, key, text)
    t = F.col(text)

    def finds_of(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), F.lit(None).cast("string").alias("label"), v.alias("value")))

    finds = [finds_of(k, p) for k, p in (("currency", CURRENCY), ("percentage", PERCENT), ("ratio", RATIO))]
    labels, values = F.regexp_extract_all(t, F.lit(KPI), F.lit(1)), F.regexp_extract_all(t, F.lit(KPI), F.lit(2))
    finds.append(F.transform(F.arrays_zip(labels.alias("l"), values.alias("v")), lambda p, i: F.struct(F.lit("kpi").alias("kind"), i.alias("position"), F.trim(p["l"]).alias("label"), p["v"].alias("value"))))
    rows = df.where(t.isNotNull()).select(key, F.explode(F.concat(*finds)).alias("f")).select(key, "f.*")
    return rows.withColumns({"value": F.trim("value"), "number": parsed_number(F.col("value"))})


def text_table(df: DataFrame, key: str, text: str, separator: str = r"\t|\s{2,}|\s*\|\s*") -> DataFrame:
    """key, line, cells of the lines that have the most frequent number (two at least) of separated cells in their text."""
    need(df, key, text)
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    cells = lines.select(key, "line", F.filter(F.split(F.trim("t"), separator), lambda x: x != "").alias("cells")).where(F.size("cells") > 1)
    modal = cells.groupBy(key, F.size("cells").alias("k")).agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("k", F.struct("n", "k")).alias("k"))
    return cells.join(modal, key).where(F.size("cells") == F.col("k")).select(key, "line", "cells")
