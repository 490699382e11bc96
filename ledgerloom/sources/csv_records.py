"""CSV records whose quoted fields may hold line breaks, read in as many tasks as the files have splits.

A first pass tells of each split how it would end if it began outside or inside quotes. One split after another, that gives how
each of them begins; then every split is parsed by itself, and only records that lie across splits are put together."""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as missing in a field.
MISSING = frozenset(("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))
#: A record's fields, its text where their number is not that of the header; or a piece of a record that lies across splits.
PARSED = "cells array<string>, text string, file long, piece_of long, piece_at long, piece binary"


def ends_inside(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a line that begins outside or inside a quoted field ends inside one. A quote opens only at the start of a field."""
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == b'"':
            inside = True
            at += 1
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, start): the bytes of each line in the order of the file, within the split that begins at ``start``."""
    lines = spark.read.text(path)
    return lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, start, lines) of the parts of batches that lie in one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cuts = [0, *(((file[1:] != file[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(file[a]), int(start[a]), batch.column(0).slice(a, b - a)


@dataclass(frozen=True)
class Splits:
    """How the splits of the files begin, and what was counted on the way."""

    #: Splits that begin inside quotes, with the split where the open record began.
    inside: dict[tuple[int, int], int]
    #: Files that end inside quotes.
    unclosed: int
    lines: int
    #: Lines that are not UTF-8.
    other: int


def scan_splits(spark: SparkSession, path: str, delimiter: str) -> Splits:
    """One pass over all lines; a row a split, of which the driver plans the tasks anyway, comes back."""
    sep = delimiter.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # where a split ends if begun outside and if begun inside, whether the latter ends the open record, lines, lines that are not UTF-8
        found: dict[tuple[int, int], list] = {}
        for file, start, lines in _runs(batches):
            state = found.setdefault((file, start), [False, True, False, 0, 0])
            for line in lines.filter(pc.match_substring(lines, b'"')).to_pylist():
                state[0], state[1] = ends_inside(line, state[0], sep), ends_inside(line, state[1], sep)
                state[2] |= not state[1]
            state[3] += len(lines)
            state[4] += _not_utf8(lines)
        if found:
            columns = zip(*((*k, *v) for k, v in found.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "start", "outside", "inside", "closes", "n", "other"])

    rows = raw_lines(spark, path).mapInArrow(run, "file long, start long, outside boolean, inside boolean, closes boolean, n long, other long").collect()
    inside: dict[tuple[int, int], int] = {}
    ends: dict[int, bool] = {}
    owner = 0
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        began = ends.get(r.file, False)
        if began:
            inside[r.file, r.start] = owner
        if not began or r.closes:
            owner = r.start  # of a record that is open at the end
        ends[r.file] = r.inside if began else r.outside
    return Splits(inside, sum(ends.values()), sum(r.n for r in rows), sum(r.other for r in rows))


def _not_utf8(lines: pa.Array) -> int:
    found = lines.to_pylist()
    try:
        b"\n".join(found).decode("utf-8")
        return 0
    except UnicodeDecodeError:
        return sum(x.decode("utf-8", "ignore").encode("utf-8") != x for x in found)


def fields_of(records: list[str], delimiter: str) -> list[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return list(csv.reader(records, delimiter=delimiter))


def head_records(spark: SparkSession, path: str, n: int, delimiter: str, encoding: str) -> list[list[str]]:
    """Fields of the first ``n`` records, of which the first is the header, from no more lines than it takes (doubled till enough)."""
    sep, most = delimiter.encode(), n + 1
    while True:
        lines = [bytes(r.line) for r in raw_lines(spark, path).select("line").limit(most).collect()]
        records, piece, inside = [], [], False
        for line in lines:
            inside = ends_inside(line, inside, sep)
            piece.append(line)
            if not inside:
                records.append(b"\n".join(piece))
                piece = []
        records = [r for r in records if r.strip()][:n]
        if len(records) == n or len(lines) < most:
            return fields_of([r.decode(encoding, "replace").lstrip("\ufeff") for r in records], delimiter)
        most *= 2


def records(spark: SparkSession, path: str, splits: Splits, delimiter: str, encoding: str, width: int) -> DataFrame:
    """(cells, text): the records behind each file's header. MISSING fields are null. ``text`` only where the number of fields is
    not ``width``. Blank lines are no records; a line break within quotes is one line feed."""
    sep, inside = delimiter.encode(), splits.inside

    def batch(found: list[bytes]) -> pa.RecordBatch:
        texts = [r.decode(encoding, "replace") for r in found if r.strip()]
        cells = fields_of(texts, delimiter)
        odd = [t if len(c) != width else None for t, c in zip(texts, cells, strict=True)]
        cells = [[None if x in MISSING else x for x in c] for c in cells]
        none = pa.nulls(len(odd), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.string())), pa.array(odd, pa.string()), none, none, none, pa.nulls(len(odd), pa.binary())], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside_now, since, piece, header = None, False, None, [], False

        def part() -> pa.RecordBatch:
            """What this split has of a record that lies across splits; nothing of a header."""
            ids = [pa.array([x], pa.int64()) for x in (now[0], now[1] if since is None else since, now[1])]
            text = None if header else b"\n".join(piece)
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.string()), *ids, pa.array([text], pa.binary())], NAMES)

        for file, start, lines in _runs(batches):
            if (file, start) != now:
                if piece:
                    yield part()
                now, piece, since, header = (file, start), [], inside.get((file, start)), start == 0
                inside_now = since is not None
            done: list[bytes] = []
            for line in lines.to_pylist():
                if inside_now or b'"' in line:
                    inside_now = ends_inside(line, inside_now, sep)
                    piece.append(line)
                    if inside_now:
                        continue
                    if since is not None:
                        yield part()
                        since, piece = None, []
                        continue
                    line, piece = b"\n".join(piece), []
                if header and line.strip():
                    header = False
                else:
                    done.append(line)
            if done:
                yield batch(done)
        if piece:
            yield part()

    parsed = raw_lines(spark, path).mapInArrow(run, PARSED)
    whole = parsed.where("piece_of is null").select("cells", "text")
    if not inside:
        return whole

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(b.column(0).to_pylist()).select(["cells", "text"])

    across = parsed.where("piece_of is not null").groupBy("file", "piece_of").agg(F.sort_array(F.collect_list(F.struct("piece_at", "piece"))).alias("p"))
    across = across.select(F.expr("aggregate(slice(p, 2, size(p)), p[0].piece, (a, x) -> concat(a, x'0a', x.piece))").alias("record"))
    across = across.where("record is not null")
    return whole.unionByName(across.mapInArrow(joined, "cells array<string>, text string"))


NAMES = ["cells", "text", "file", "piece_of", "piece_at", "piece"]
