"""JSON files of any shape as tables: records are VARIANT values, whose schemas are merged over all of them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that hold the records of a wrapped document, and the nesting from which a document is a nested one.
WRAPPERS = ("data", "results", "items", "records", "rows", "entries")
DEEP, HEAD, MOSTLY = 2, 10, 0.8


@dataclass(frozen=True)
class JsonTable:
    """A table of records and how the file held them: array, object_with_data, nested, jsonlines or single_object."""

    df: DataFrame
    structure: str
    data_key: str | None
    #: Lines that are no JSON, left out.
    malformed: int = 0


def depth(kind: T.DataType) -> int:
    """Levels of objects and lists; empty ones and plain values have none."""
    if isinstance(kind, T.StructType):
        return 1 + max(depth(f.dataType) for f in kind.fields) if kind.fields else 0
    if isinstance(kind, T.ArrayType):
        return 0 if isinstance(kind.elementType, T.NullType) else 1 + depth(kind.elementType)
    return 0


def _parsed_schema(text: str) -> T.DataType:
    """The type of a schema as VARIANT functions write it: objects are structs, decimals doubles."""
    parts = re.split(r"(`(?:[^`]|``)*`)", text)  # names in back quotes stay as they are
    parts[::2] = [re.sub(r"DECIMAL\(\d+,\s*\d+\)|FLOAT", "DOUBLE", p.replace("OBJECT<", "STRUCT<")) for p in parts[::2]]
    return T.DataType.fromDDL("".join(parts))


def _merged(rows: DataFrame, column: str) -> tuple[T.DataType, int, int]:
    """The merged type of a VARIANT column, and how many rows there are and how many are null."""
    s = rows.agg(F.expr(f"schema_of_variant_agg({column})").alias("s"), F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("gaps")).first()
    return _parsed_schema(s.s) if s.s and s.n > s.gaps else T.NullType(), s.n, s.gaps


def is_lines(head: list[str]) -> bool:
    """Whether most of the first lines, more than one, are JSON each."""
    head = [x for x in head if x.strip()][:HEAD]

    def valid(line: str) -> bool:
        try:
            json.loads(line)
        except ValueError:
            return False
        return True

    return len(head) > 1 and sum(map(valid, head)) / len(head) > MOSTLY


def _shape(kind: T.DataType, data_key: str | None) -> tuple[str, str | None]:
    """The structure of a document and the key of its list of records, if it has one."""
    if isinstance(kind, T.ArrayType):
        return "array", None
    if not isinstance(kind, T.StructType):
        return "single_object", None
    lists = [f.name for f in kind.fields if isinstance(f.dataType, T.ArrayType)]
    named = next((k for k in WRAPPERS if k in lists), None)
    if named or data_key in lists:
        return "object_with_data", data_key if data_key in lists else named
    if depth(kind) <= DEEP:
        return "single_object", None
    full = [f.name for f in kind.fields if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.NullType)]
    return "nested", full[0] if full else None


def _void_as_text(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _void_as_text(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_void_as_text(kind.elementType))
    return T.StringType() if isinstance(kind, T.NullType) else kind


def _mixed_as_text(df: DataFrame) -> DataFrame:
    """Columns whose values are of several types as text: plain values as they are, lists and objects as JSON."""
    mixed = [f.name for f in df.schema.fields if isinstance(f.dataType, T.VariantType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in mixed}) if mixed else df


def _table(records: DataFrame, kind: T.DataType) -> DataFrame:
    """The fields of the records ``r`` as columns; records that are no objects as a column value."""
    if not isinstance(kind, T.StructType) or not kind.fields:
        return records.select(F.col("r").cast("string").alias("value"))
    return records.select(F.col("r").try_cast(_void_as_text(kind)).alias("s")).select("s.*")


def flattened(df: DataFrame, list_chars: int | None = None) -> DataFrame:
    """Struct fields as columns parent_child, at any depth; lists of plain values, or always empty, stay, other lists become JSON (the first
    ``list_chars`` characters, if given). Names that meet get a number."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        cols: list[tuple] = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                cols += [(F.col(f"`{f.name}`").getField(g.name), f"{f.name}_{g.name}") for g in f.dataType.fields]
            else:
                cols.append((F.col(f"`{f.name}`"), f.name))
        seen: dict[str, int] = {}
        named = []
        for c, name in cols:
            k = seen[name.lower()] = seen.get(name.lower(), -1) + 1
            named.append(c.alias(f"{name}_{k}" if k else name))
        df = df.select(*named)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType, T.VariantType, T.NullType))]
    text = lambda c: F.to_json(f"`{c}`")
    return df.withColumns({c: F.substring(text(c), 1, list_chars) if list_chars else text(c) for c in lists}) if lists else df


def scan_json(spark: SparkSession, path: str, data_key: str | None = None, flatten: bool = True, list_chars: int | None = None, lines: bool | None = None) -> JsonTable:
    """The records of a file: its lines, the elements of its list, those under ``data_key`` or a key of WRAPPERS, those of the first list
    (by name) of a nested document, or the one document. A field that holds several types is text.

    Of lines every task reads its own; a document is parsed by one. One pass merges the schemas, the table is lazy. Documents
    over Spark's limit of a VARIANT value are read by its JSON reader instead, which streams a list's elements."""
    head = [r.value for r in spark.read.text(path).limit(HEAD + 1).collect()]
    malformed, structure, key = 0, "jsonlines", None
    if lines or lines is None and is_lines(head):
        records = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("r"))
        kind, _, malformed = _merged(records, "r")
        records = records.where("r is not null")
    else:
        docs = spark.read.options(singleVariantColumn="v", multiLine=True).json(path)
        kind, n, gaps = _merged(docs, "v")
        if n == 0 or gaps:
            df = spark.read.json(path, multiLine=True, mode="FAILFAST")
            structure, key = _shape(df.schema, data_key)
            df = df.select(F.explode(f"`{key}`").alias("r")).select("r.*") if key and isinstance(df.schema[key].dataType.elementType, T.StructType) else df
            return JsonTable(flattened(df, list_chars) if flatten else df, "array" if head and head[0].lstrip("﻿ \t")[:1] == "[" else structure, key)
        structure, key = _shape(kind, data_key)
        if structure == "array":
            records, kind = docs.select(F.explode(F.col("v").cast("array<variant>")).alias("r")), kind.elementType
        elif key:
            name = key.replace("\\", "\\\\").replace("'", "\\'")
            records, kind = docs.select(F.explode(F.expr(f"variant_get(v, '$[\"{name}\"]', 'array<variant>')")).alias("r")), kind[key].dataType.elementType
        else:
            records = docs.select(F.col("v").alias("r"))
    df = _table(records, kind)
    return JsonTable(_mixed_as_text(flattened(df, list_chars) if flatten else df), structure, key, malformed)
