"""Files as DataFrames by extension: CSV, JSON, Parquet, ORC, Excel, Word and PowerPoint."""

from __future__ import annotations

import codecs
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.profile import ColumnMapping, suggest_mapping
from ledgerloom.sources import csv_records, json_records
from ledgerloom.sources.office import read_excel, read_slides, read_word

READERS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".orc": "orc", ".xlsx": "excel", ".xlsm": "excel", ".docx": "word", ".pptx": "slides"}
DELIMITERS = (",", ";", "\t", "|")
_HEAD = 11
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")


@dataclass(frozen=True)
class LoadResult:
    """A lazy table and what was found out about its file, or the reason why there is none."""

    path: str
    df: DataFrame | None = None
    file_type: str | None = None
    metadata: dict = field(default_factory=dict)
    error: str | None = None

    @property
    def success(self) -> bool:
        return self.error is None

    @cached_property
    def mapping(self) -> ColumnMapping | None:
        """What the columns may stand for; asked for, it reads the table once."""
        return suggest_mapping(self.df) if self.df is not None else None


def extension(path: str) -> str:
    return (m := re.search(r"\.\w+$", path.rstrip("/"))) and m[0].lower() or ""


def supported_extensions() -> list[str]:
    return sorted(READERS)


def is_supported(path: str) -> bool:
    return extension(path) in READERS


def head_bytes(spark: SparkSession, path: str) -> bytes:
    """The bytes of the first lines: the text source hands them on as they are, from any store that Spark reads."""
    return b"\n".join(bytes(r.value) for r in spark.read.text(path).select(F.col("value").cast("binary")).limit(_HEAD).collect())


def sniff_delimiter(lines: list[str]) -> str:
    """The first that occurs equally often, at least once, in all lines; else the most frequent."""
    lines = [x for x in lines if x.strip()]
    for d in DELIMITERS:
        counts = {x.count(d) for x in lines[:10]}
        if len(counts) == 1 and counts != {0}:
            return d
    found = Counter({d: sum(x.count(d) for x in lines) for d in DELIMITERS})
    return found.most_common(1)[0][0] if found.total() else ","


def sniff_decimal(lines: list[str], delimiter: str) -> str:
    """A comma only where fields part at semicolons and comma decimals outnumber those with a dot."""
    text = "\n".join(lines)
    return "," if delimiter == ";" and len(re.findall(r"\d,\d", text)) > len(re.findall(r"\d\.\d", text)) else "."


def sniff_encoding(head: bytes) -> str:
    """UTF-16 by its mark, UTF-8 if the bytes can begin such a text, else ISO-8859-1."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def _names(header: list[str]) -> list[str]:
    """Stripped names; a column without one by its place, repeated ones with a number, in any case."""
    names: list[str] = []
    for i, c in enumerate(header):
        name = first = c.strip() or f"_c{i}"
        n = 0
        while name.lower() in {x.lower() for x in names}:
            n += 1
            name = f"{first}_{n}"
        names.append(name)
    return names


@dataclass(frozen=True)
class CsvFormat:
    """How a CSV is read, and what reading it through has told."""

    encoding: str
    delimiter: str
    decimal: str
    names: list[str]
    splits: csv_records.Splits | None = None

    @property
    def width(self) -> int:
        return len(self.names)


def csv_format(spark: SparkSession, path: str, delimiter: str | None = None, decimal: str | None = None, encoding: str | None = None, whole: bool = True) -> CsvFormat:
    """Delimiter and decimal sign from the first lines, where not given. ``whole``: all lines are read once, which tells where
    records lie across splits, and ISO-8859-1 if any line is not UTF-8."""
    head = head_bytes(spark, path)
    told = encoding or sniff_encoding(head)
    lines = head.decode(told, "replace").splitlines()
    delimiter = delimiter or sniff_delimiter(lines)
    splits = csv_records.scan_splits(spark, path, delimiter) if whole and told != "UTF-16" else None
    if splits and not encoding:
        told = "ISO-8859-1" if splits.other else "UTF-8"
    if splits and splits.unclosed:
        raise ValueError(f"{path}: a quoted field is never closed")
    if told == "UTF-16":
        header = spark.read.csv(path, header=True, sep=delimiter, encoding=told, multiLine=True).columns
    else:
        header = next(iter(csv_records.head_records(spark, path, 1, delimiter, told)), [])
    if not header:
        raise ValueError(f"{path}: no header")
    return CsvFormat(told, delimiter, decimal or sniff_decimal(lines, delimiter), _names(header), splits)


def _records(spark: SparkSession, path: str, form: CsvFormat) -> DataFrame:
    """(cells, text) of all records; UTF-16, whose line ends are no single bytes, a file a task."""
    if form.encoding != "UTF-16":
        return csv_records.records(spark, path, form.splits, form.delimiter, form.encoding, form.width)
    df = spark.read.csv(path, header=True, sep=form.delimiter, encoding=form.encoding, multiLine=True)
    return df.select(F.array(*[F.col(f"`{c}`") for c in df.columns]).alias("cells"), F.lit(None).cast("string").alias("text"))


def malformed_lines(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """line, kept: the records whose number of fields is not that of the header; those with too few are kept by ``read_csv``."""
    form = csv_format(spark, path, delimiter, encoding=encoding)
    odd = _records(spark, path, form).where("text is not null")
    return odd.select(F.col("text").alias("line"), (F.size("cells") < form.width).alias("kept"))


def _columns(rows: DataFrame, form: CsvFormat) -> DataFrame:
    """The cells as columns of text, decimal commas as points. Too few are filled up with nulls; records of too many are left out."""
    value = lambda i: F.get("cells", F.lit(i))
    if form.decimal == ",":
        swap = lambda v: F.when(v.rlike(r"^\s*-?[\d.]*\d,\d+\s*$"), F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(v)
        value = lambda i: swap(F.get("cells", F.lit(i)))
    return rows.where(F.size("cells") <= form.width).select(*[value(i).alias(c) for i, c in enumerate(form.names)])


def scan_csv(spark: SparkSession, path: str, delimiter: str | None = None, decimal: str | None = None, encoding: str | None = None) -> tuple[DataFrame, dict]:
    """The typed table, and what was found: encoding, delimiter, decimal_separator, columns, rows, and values that became null a column.

    A quoted field may hold line breaks wherever the file is split. Two passes decide (lines, then types); the table itself is lazy."""
    form = csv_format(spark, path, delimiter, decimal, encoding)
    df, told = typed(_columns(_records(spark, path, form), form))
    return df, {"encoding": form.encoding, "delimiter": form.delimiter, "decimal_separator": form.decimal, "columns": form.width, **told}


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, decimal: str | None = None, encoding: str | None = None) -> DataFrame:
    """The table of ``scan_csv``: a record of too few fields is filled up with nulls, one of too many is left out (``malformed_lines`` has both)."""
    return scan_csv(spark, path, delimiter, decimal, encoding)[0]


#: Words in the names of columns that may hold dates.
DATE_WORDS = ("date", "datum", "time", "zeit", "created", "updated", "timestamp", "day", "month", "year", "tag", "monat", "jahr")
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
WHOLE = r"^\s*[-+]?\d{1,18}\s*$"


def typed(df: DataFrame, least: float = 0.8) -> tuple[DataFrame, dict]:
    """Text columns as whole numbers, doubles or booleans where all values are, as timestamps where the name tells a date and more than
    ``least`` of the values are one; and {rows, nulled: values of each such column that are none}. One pass over all rows decides."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    named = {c for c in texts if re.search(r"(_at|_on)$", c.lower()) or any(w in c.lower() for w in DATE_WORDS)}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(texts):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"), *(F.count_if(t).alias(f"{k}{i}") for k, t in (("l", v.rlike(WHOLE)), ("d", v.rlike(NUMBER)), ("b", v.isin(*BOOLEANS))))]
        if c in named:
            aggs.append(F.count(F.try_to_timestamp(v)).alias(f"t{i}"))
    s = df.agg(*aggs).first()
    made, nulled = {}, {}
    for i, c in enumerate(texts):
        n, v = s[f"n{i}"], F.col(f"`{c}`")
        if n and s[f"l{i}"] == n:
            made[c] = v.try_cast("long")
        elif n and s[f"d{i}"] == n:
            made[c] = v.try_cast("double")
        elif n and s[f"b{i}"] == n:
            made[c] = v.try_cast("boolean")
        elif n and c in named and s[f"t{i}"] > n * least:
            made[c] = F.try_to_timestamp(v)
            if s[f"t{i}"] < n:
                nulled[c] = n - s[f"t{i}"]
    return df.withColumns({f"{c}": v for c, v in made.items()}) if made else df, {"rows": s["rows"], "nulled": nulled}


#: Words in the names of JSON fields that may hold dates.
JSON_DATE_WORDS = ("date", "datum", "time", "zeit", "created", "updated", "timestamp", "_at", "_on", "day", "month", "year")


def dated(df: DataFrame, words: tuple[str, ...] = JSON_DATE_WORDS, least: float = 0.8) -> DataFrame:
    """Texts whose name tells a date as timestamps where over ``least`` of all rows are one. One pass decides, if there are such."""
    named = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and any(w in f.name.lower() for w in words)]
    if not named:
        return df
    s = df.agg(F.count("*").alias("n"), *[F.count(F.try_to_timestamp(F.col(f"`{c}`"))).alias(f"t{i}") for i, c in enumerate(named)]).first()
    return df.withColumns({c: F.try_to_timestamp(F.col(f"`{c}`")) for i, c in enumerate(named) if s[f"t{i}"] > s["n"] * least})


def json_shape(spark: SparkSession, path: str) -> str:
    """array, object_with_data, nested, jsonlines or single_object."""
    return json_records.scan_json(spark, path).structure


def read_json(spark: SparkSession, path: str, data_key: str | None = None, flatten: bool = True, list_chars: int | None = None) -> DataFrame:
    """The table of ``json_records.scan_json`` with dates."""
    return _scan_json(spark, path, data_key, flatten, list_chars)[0]


def _scan_json(spark: SparkSession, path: str, data_key: str | None = None, flatten: bool = True, list_chars: int | None = None) -> tuple[DataFrame, dict]:
    found = json_records.scan_json(spark, path, data_key, flatten, list_chars, lines=True if extension(path) in (".jsonl", ".ndjson") else None)
    df = dated(found.df)
    return df, {"columns": len(df.columns), "json_structure": found.structure, "data_key": found.data_key, "flattened": flatten, "lines_left_out": found.malformed}


def load_file(spark: SparkSession, path: str, **options) -> LoadResult:
    """Any supported file; what goes wrong is told in ``error``, not raised."""
    kind = READERS.get(extension(path))
    if kind is None:
        known = {".xls": "save it as .xlsx", ".doc": "save it as .docx", ".ppt": "save it as .pptx", ".pdf": "no PDF library is here"}
        return LoadResult(path, error=f"{extension(path) or 'no extension'} is not supported ({known.get(extension(path), 'supported: ' + ', '.join(supported_extensions()))})")
    try:
        if kind in ("csv", "json"):
            df, told = (scan_csv if kind == "csv" else _scan_json)(spark, path, **options)
            return LoadResult(path, df, kind, told)
        read = {"excel": read_excel, "word": read_word, "slides": read_slides, "parquet": lambda s, p: s.read.parquet(p), "orc": lambda s, p: s.read.orc(p)}[kind]
        df = read(spark, path, **options)
        return LoadResult(path, df, kind, {"columns": len(df.columns)})
    except Exception as e:  # noqa: BLE001  the contract: errors are values
        return LoadResult(path, file_type=kind, error=str(e).splitlines()[0] if str(e) else type(e).__name__)


def load_many(spark: SparkSession, paths: list[str], combine: bool = False) -> dict[str, LoadResult] | DataFrame:
    """A result for each path; combined: all that could be read in one table, with its path in _source_file."""
    results = {p: load_file(spark, p) for p in paths}
    if not combine:
        return results
    out = None
    for p, r in results.items():
        if r.success:
            d = r.df.withColumn("_source_file", F.lit(p))
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("none of the files could be read")
    return out


def preview(spark: SparkSession, path: str, n_rows: int = 10) -> DataFrame:
    """The first rows. Of a CSV no more lines are read than they take, and they alone decide the types."""
    if READERS.get(extension(path)) == "csv":
        form = csv_format(spark, path, whole=False)
        if form.encoding != "UTF-16":
            found = csv_records.head_records(spark, path, n_rows + 1, form.delimiter, form.encoding)[1:]
            rows = [([None if x in csv_records.MISSING else x for x in r], None) for r in found]
            return typed(_columns(spark.createDataFrame(rows, "cells array<string>, text string"), form))[0]
    r = load_file(spark, path)
    if not r.success:
        raise ValueError(r.error)
    return r.df.limit(n_rows)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime, extension, supported of each file under ``path``; contents stay unread."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.\w+)$", 1))).withColumn("supported", F.col("extension").isin(list(READERS)))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; as many parts as the table has partitions."""
    df.write.mode("overwrite").csv(path, header=True)
