"""Excel, Word and PowerPoint files through Spark's binary source: zipped XML, a file a row, read as rows of cells and texts."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "path string, place int, part string, kind string, row int, cells array<string>"
#: Built-in number formats of dates and times.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, tag: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _tag(x) == tag)


def _get(e: ElementTree.Element, name: str) -> str | None:
    """An attribute, whatever its namespace."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _texts(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in _all(e, "t"))


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _linked(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    """Id to path of the parts that a part links to."""
    folder, base = posixpath.split(name)
    root = _xml(z, f"{folder}/_rels/{base}.rels")
    return {} if root is None else {_get(r, "Id"): posixpath.normpath(posixpath.join(folder, t)).lstrip("/") if not (t := _get(r, "Target")).startswith("/") else t.lstrip("/") for r in root}


def _in_order(z: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted((f for f in z.namelist() if re.fullmatch(pattern, f)), key=lambda f: int(re.search(r"(\d+)\.xml", f)[1]))


def _properties(z: zipfile.ZipFile) -> Iterator[tuple]:
    root = _xml(z, "docProps/core.xml")
    names = {"creator": "author", "title": "title", "subject": "subject", "created": "created", "modified": "modified"}
    for e in root if root is not None else ():
        if _tag(e) in names and e.text:
            yield 0, "properties", "property", 0, [names[_tag(e)], e.text]


# Excel -------------------------------------------------------------------------------------------------------------


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    root = _xml(z, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(_get(e, "numFmtId")): _get(e, "formatCode") or "" for e in _all(root, "numFmt")}
    dates = DATE_FORMATS | {i for i, code in own.items() if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower()))}
    styles = next(_all(root, "cellXfs"), ())
    return {i for i, e in enumerate(styles) if int(_get(e, "numFmtId") or 0) in dates}


def _day(serial: str, early: bool) -> str:
    """A day number as a time stamp; the count of 1900 has a 29 February that was none."""
    days = float(serial)
    start = datetime(1904, 1, 1) if early else datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    return str((start + timedelta(microseconds=round(days * 86_400_000_000))).replace(microsecond=0))


def _excel(z: zipfile.ZipFile) -> Iterator[tuple]:
    yield from _properties(z)
    root = _xml(z, "xl/sharedStrings.xml")
    shared = [_texts(s) for s in root] if root is not None else []
    book, links, dates = _xml(z, "xl/workbook.xml"), _linked(z, "xl/workbook.xml"), _date_styles(z)
    early = any((_get(e, "date1904") or "0") in ("1", "true") for e in _all(book, "workbookPr"))
    files = _in_order(z, r"xl/worksheets/sheet\d+\.xml")
    for place, sheet in enumerate(_all(book, "sheet")):
        file = links.get(_get(sheet, "id") or "") or (files[place] if place < len(files) else None)
        name = _get(sheet, "name")
        yield place, name, "sheet", 0, []
        if file not in z.namelist():
            continue
        last = 0
        with z.open(file) as content:  # a row at a time, so that a large sheet is not held as a tree
            for _, e in ElementTree.iterparse(content):
                if _tag(e) != "row":
                    continue
                last = int(_get(e, "r") or last + 1)
                cells: list[str | None] = []
                for c in e:
                    at = _column(_get(c, "r")) if _get(c, "r") else len(cells)
                    value, kind = next((x.text for x in c if _tag(x) == "v"), None), _get(c, "t") or "n"
                    if kind == "inlineStr":
                        value = _texts(c)
                    elif value is not None and kind == "s":
                        value = shared[int(value)]
                    elif value is not None and kind == "b":
                        value = str(value == "1")
                    elif kind == "e":
                        value = None
                    elif value is not None and kind == "n" and int(_get(c, "s") or 0) in dates:
                        value = _day(value, early)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = value
                e.clear()
                if any(c not in (None, "") for c in cells):
                    yield place, name, "table", last, cells


# Word --------------------------------------------------------------------------------------------------------------


def _word(z: zipfile.ZipFile) -> Iterator[tuple]:
    yield from _properties(z)
    root, styles = ElementTree.fromstring(z.read("word/document.xml")), _xml(z, "word/styles.xml")
    named = {} if styles is None else {_get(s, "styleId"): _get(next(_all(s, "name"), s), "val") for s in _all(styles, "style")}
    inside: set = set()
    for t, table in enumerate(_all(root, "tbl")):
        inside.update(table.iter())
        for i, r in enumerate(_all(table, "tr")):
            yield t, f"document/table{t + 1}", "table", i + 1, [_texts(c).strip() for c in r if _tag(c) == "tc"]
    for i, p in enumerate(e for e in _all(root, "p") if e not in inside):
        if text := _texts(p).strip():
            style = _get(next(_all(p, "pStyle"), p), "val") or "Normal"
            style = named.get(style) or style
            level = re.fullmatch(r"[Hh]eading ?(\d*)", style)
            yield 0, "document", "heading" if level else "text", i + 1, [text, style, *([level[1]] if level else [])]


# PowerPoint --------------------------------------------------------------------------------------------------------


def _chart(root: ElementTree.Element) -> list[list[str | None]]:
    """Categories and a column a series, with the names on top."""
    def points(e: ElementTree.Element | None) -> dict[int, str]:
        return {} if e is None else {int(_get(p, "idx")): next((v.text for v in _all(p, "v")), None) for p in _all(e, "pt")}

    series = list(_all(root, "ser"))
    child = lambda s, *tags: next((x for x in s if _tag(x) in tags), None)
    names = [next(iter(points(child(s, "tx")).values()), None) or f"series {i + 1}" for i, s in enumerate(series)]
    labels = points(child(series[0], "cat", "xVal")) if series else {}
    values = [points(child(s, "val", "yVal")) for s in series]
    places = sorted(set(labels).union(*values)) if series else []
    return [["category", *names], *([labels.get(i), *(v.get(i) for v in values)] for i in places)]


def _slides(z: zipfile.ZipFile) -> Iterator[tuple]:
    yield from _properties(z)
    show, links = _xml(z, "ppt/presentation.xml"), _linked(z, "ppt/presentation.xml")
    files = [links.get(_get(s, "id") or "") for s in _all(show, "sldId")] if show is not None else []
    files = [f for f in files if f in z.namelist()] or _in_order(z, r"ppt/slides/slide\d+\.xml")
    for n, file in enumerate(files):
        part, root, linked = f"slide{n + 1}", ElementTree.fromstring(z.read(file)), _linked(z, file)
        yield n, part, "slide", 0, []
        for t, table in enumerate(_all(root, "tbl")):
            rows = [[_texts(c).strip() for c in r if _tag(c) == "tc"] for r in _all(table, "tr")]
            yield from ((n, f"{part}/table{t + 1}", "table", i + 1, cells) for i, cells in enumerate(rows) if len(rows) > 1)
        for i, shape in enumerate(_all(root, "sp")):
            kind = _get(next(_all(shape, "ph"), shape), "type") if next(_all(shape, "ph"), None) is not None else None
            text = "\n".join(x for p in _all(shape, "p") if (x := _texts(p).strip()))
            if text:
                yield n, part, "title" if kind in ("title", "ctrTitle") else "text", i + 1, [text]
        for t, file in enumerate(sorted(f for f in linked.values() if re.fullmatch(r"ppt/charts/chart\d+\.xml", f) and f in z.namelist())):
            yield from ((n, f"{part}/chart{t + 1}", "chart", i + 1, cells) for i, cells in enumerate(_chart(ElementTree.fromstring(z.read(file)))))
        for file in (f for f in linked.values() if "notesSlide" in f and f in z.namelist()):
            for shape in _all(ElementTree.fromstring(z.read(file)), "sp"):
                ph = next(_all(shape, "ph"), None)
                text = "\n".join(x for p in _all(shape, "p") if (x := _texts(p).strip()))
                if text and (ph is None or _get(ph, "type") in (None, "body")):
                    yield n, part, "notes", 1, [text]


_PARSERS = {".xlsx": _excel, ".xlsm": _excel, ".docx": _word, ".pptx": _slides}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, place (of the sheet, table or slide, from 0), part (its name), kind, row, cells.

    kind: table, and of sheets sheet; text and heading (with style and level) of Word; slide, title, text, notes and chart of
    PowerPoint; property (name, value). A file that can't be parsed gives one row of kind error. A file is a task; rows go on
    a thousand at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "place", "part", "kind", "row", "cells"])
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for r in _PARSERS[p[p.rfind(".") :].lower()](z):
                            rows.append((p, *r))
                            if len(rows) == 1000:
                                yield frame(rows)
                                rows = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows = [(p, 0, "", "error", 0, [str(e)])]
                if rows:
                    yield frame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _FIELDS)


def _names(cells: list[str | None]) -> list[str]:
    names = [(c or "").strip() or f"column_{i + 1}" for i, c in enumerate(cells)]
    low = [n.lower() for n in names]
    return [n if low[:i].count(low[i]) == 0 else f"{n}_{low[:i].count(low[i]) + 1}" for i, n in enumerate(names)]


def _told(cells: DataFrame) -> DataFrame:
    """The cells, or what is wrong with the file as an error."""
    bad = cells.where("kind = 'error'").first()
    if bad is not None:
        raise ValueError(f"{bad.path}: {bad.cells[0]}")
    return cells


def table_of(cells: DataFrame, part: str | int | None = None, header_row: int | None = None, skip_rows: tuple[int, ...] = (), strict_header: bool = False) -> DataFrame:
    """One table of ``read_documents``; by default the first part that has rows. Rows and columns without values go.

    ``header_row``: the row of the names, from 0 after ``skip_rows`` (rows of the sheet, from 0) are left out; by default the
    first with values. ``strict_header``: names only if all are there and differ, else the columns are numbered."""
    rows = cells.where("kind in ('table', 'chart')")
    if isinstance(part, int):
        found = cells.where((F.col("kind") == "sheet") & (F.col("place") == part)).first()
        part = found.part if found else None
    if part is None:
        best = rows.groupBy("part").agg(F.min("place").alias("p")).orderBy("p", "part").first()
        if best is None:
            raise ValueError("there is no table")
        part = best.part
    rows = rows.where(F.col("part") == part)
    for skipped in skip_rows:
        rows = rows.where(F.col("row") != skipped + 1)
    if header_row is None:
        head = rows.orderBy("row").first()
        at = head.row if head else 0
    else:
        at = header_row + 1
        for skipped in sorted(skip_rows):
            at += skipped + 1 <= at
        head = rows.where(F.col("row") == at).first()
    width = rows.agg(F.max(F.size("cells")).alias("w")).first().w or 0
    if head is None and width == 0:
        raise ValueError(f"there is no table {part}")
    first = [*(head.cells if head else []), *[None] * (width - len(head.cells if head else []))]
    named = not strict_header or all(first) and len(set(first)) == len(first)
    names = _names(first) if named else [str(i) for i in range(width)]
    body = rows.where(F.col("row") > at) if named else rows.where(F.col("row") >= at)
    values = body.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
    there = values.agg(*[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names)]).first()
    kept = [n for i, n in enumerate(names) if there[f"n{i}"]] or names
    return values.select(*[F.col(f"`{n}`") for n in kept]).dropna(how="all")


def tables_of(cells: DataFrame) -> dict[str, DataFrame]:
    """Every table by its part."""
    parts = [r.part for r in cells.where("kind = 'table'").select("part", "place").distinct().orderBy("place", "part").collect()]
    return {p: table_of(cells, p, strict_header=p.startswith("document/")) for p in parts}


def union_or_largest(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables in one if their columns are the same, else the one of most rows (of equals the first)."""
    if not tables:
        raise ValueError("there is no table")
    found = list(tables.values())
    if all(set(t.columns) == set(found[0].columns) for t in found):
        return reduce(DataFrame.unionByName, found)
    return max(found, key=lambda t: t.count())


def word_table(cells: DataFrame, table_index: int = 0) -> DataFrame:
    """The table of that number, the first if there is none of it; of a document without tables its paragraphs (paragraph_num, text, style)."""
    parts = list(tables_of(cells).values())
    if parts:
        return parts[table_index if 0 <= table_index < len(parts) else 0]
    return cells.where("kind in ('text', 'heading')").select(F.col("row").alias("paragraph_num"), F.get("cells", F.lit(0)).alias("text"), F.get("cells", F.lit(1)).alias("style"))


def slide_table(cells: DataFrame) -> DataFrame:
    """The tables of all slides, joined or the largest; without tables the texts (slide, kind, text)."""
    tables = tables_of(cells)
    if tables:
        return union_or_largest(tables)
    return cells.where("kind in ('title', 'text', 'notes')").select((F.col("place") + 1).alias("slide"), "kind", F.get("cells", F.lit(0)).alias("text"))


def document_summary(cells: DataFrame) -> DataFrame:
    """A row a file: how many sheets, slides, tables, charts, paragraphs, headings and notes, and its title and author."""
    kind, first = F.col("kind"), F.get("cells", F.lit(0))
    parts = lambda k: F.count_distinct(F.when(kind == k, F.col("part")))
    told = lambda name: F.max(F.when((kind == "property") & (first == name), F.get("cells", F.lit(1))))
    counts = {"sheets": parts("sheet"), "slides": parts("slide"), "tables": parts("table"), "charts": parts("chart"), "paragraphs": F.count_if(kind.isin("text", "heading", "title")), "headings": F.count_if(kind == "heading"), "notes": F.count_if(kind == "notes")}
    return cells.groupBy("path").agg(*[c.alias(n) for n, c in counts.items()], told("title").alias("title"), told("author").alias("author"))


def read_excel(spark: SparkSession, path: str, sheet: str | int | None = None, header_row: int | None = None, skip_rows: tuple[int, ...] = ()) -> DataFrame:
    """A sheet by name or number, by default the first with values, typed; cells shown as dates are time stamps."""
    from ledgerloom.sources.loader import typed

    return typed(table_of(_told(read_documents(spark, path)), sheet, header_row, tuple(skip_rows)))[0]


def read_word(spark: SparkSession, path: str, table_index: int = 0) -> DataFrame:
    from ledgerloom.sources.loader import typed

    return typed(word_table(_told(read_documents(spark, path)), table_index))[0]


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    from ledgerloom.sources.loader import typed

    return typed(slide_table(_told(read_documents(spark, path))))[0]


def sheet_info(spark: SparkSession, path: str) -> DataFrame:
    """place, part, rows, columns, has_data of each sheet."""
    cells = read_documents(spark, path).where("kind in ('sheet', 'table')")
    n = F.count_if(F.col("kind") == "table")
    return cells.groupBy("place", "part").agg(n.alias("rows"), F.coalesce(F.max(F.when(F.col("kind") == "table", F.size("cells"))), F.lit(0)).alias("columns"), (n > 0).alias("has_data"))
