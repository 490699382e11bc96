"""Phrase collocations: counts of all frequent word sequences by sorted suffixes and one stack, then scores of how phrases part."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, stored, table

MAX_N, LEAST, SUBSUMED, TOP = 4, 30, 80, 2000
#: Separators of pieces, or words: what neither parts words nor pieces.
TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+")
BREAKS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
#: Up to the last byte between words, and up to the next.
LAST, NEXT = re.compile(rb"(?s:.*)[\x20\x09.,;:!?\x0A-\x0D]"), re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
#: Bytes of text that are taken apart at a time.
SLICE = 1 << 22
#: Counters of the filter, of one byte each in a task, one bit each where it is used; a power of two.
CELLS = 1 << 24
#: Counters of the filter that travel as one row.
CHUNK = 1 << 16


def _slices(data: bytes) -> Iterator[bytes]:
    """The bytes in parts of about SLICE, cut behind white space or a separator; a longer word stays whole."""
    at = 0
    while at < len(data):
        cut = LAST.match(data, at, at + SLICE) or NEXT.search(data, at)
        end = cut.end() if cut and len(data) - at > SLICE else len(data)
        yield data[at:end]
        at = end


class Words:
    """The words of one language in a batch of texts: numbers in the order of the text, 0 between pieces."""

    def __init__(self, lang: str, texts: list[str]):
        self.lang = lang
        number: dict[bytes, int] = {}
        parts = [np.zeros(1, np.int32)]
        for data in self._joined(texts):
            tokens = TOKEN.findall(data)
            parts.append(np.fromiter((0 if t[0] in BREAKS else number.setdefault(t, len(number) + 1) for t in tokens), np.int32, len(tokens)))
        self.ids = np.concatenate(parts)
        self.words = [b"", *number]
        self.total = int(np.count_nonzero(self.ids))

    @staticmethod
    def _joined(texts: list[str]) -> Iterator[bytes]:
        """Lower-cased texts behind line breaks, many short ones or a part of a long one at a time."""
        held, size = [], 0
        for text in texts:
            data = b"\n" + text.encode("utf-8").translate(LOWER)
            if size + len(data) > SLICE:
                yield b"".join(held)
                held, size = [], 0
            if len(data) > SLICE:
                yield from _slices(data)
            else:
                held.append(data)
                size += len(data)
        yield b"".join(held)

    def cells(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The filter's cell, of ``size``, of each place's word, and of its word and the next one (where both are words, else -1)."""
        seed = xxhash.xxh3_64_intdigest(self.lang.encode("utf-8"))
        hashed = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)
        at = hashed[self.ids]
        pair = (at[:-1] * np.uint64(0x9E3779B97F4A7C15) + (at[1:] >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
        shift = np.uint64(64 - (size.bit_length() - 1))
        one, two = (at >> shift).astype(np.int64), np.append((pair >> shift).astype(np.int64), -1)
        one[self.ids == 0] = -1
        two[:-1][(self.ids[:-1] == 0) | (self.ids[1:] == 0)] = -1
        return one, two


def _by_lang(batches: Iterator[pd.DataFrame]) -> Iterator[Words]:
    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=False):
            yield Words(lang, rows["text"].tolist())


def _counted(rows: DataFrame, least: int) -> DataFrame:
    """Word totals (lang, n) and the filter's counters (chunk, places, counts), added up a task and never above ``least``."""
    small = np.min_scalar_type(2 * least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, totals = np.zeros(CELLS, small), {}
        for words in _by_lang(batches):
            totals[words.lang] = totals.get(words.lang, 0) + words.total
            for cells in words.cells(CELLS):
                cell, n = np.unique(cells[cells >= 0], return_counts=True)
                counts[cell] = np.minimum(counts[cell] + np.minimum(n, least).astype(small), least)
        if totals:
            yield pd.DataFrame({"lang": list(totals), "n": list(totals.values()), "chunk": None, "places": None, "counts": None})
        for chunk in range(0, CELLS, CHUNK):
            part = counts[chunk : chunk + CHUNK]
            places = np.flatnonzero(part)
            if len(places):
                some = len(places) * 3 < len(part)  # few: their places and counts; else all counters
                yield pd.DataFrame({"lang": [None], "n": [None], "chunk": [chunk // CHUNK], "places": [places.astype(np.uint16).tobytes() if some else None], "counts": [(part[places] if some else part).tobytes()]})

    return rows.mapInPandas(run, "lang string, n long, chunk int, places binary, counts binary")


def _added_up(counted: DataFrame, least: int) -> DataFrame:
    """(lang, n): the words of each language; (chunk, bits): a bit a cell, whether it may hold a word or pair of ``least`` occurrences."""
    small = np.min_scalar_type(2 * least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, int] = {}
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, n, chunk, places, counts in batch.itertuples(index=False):
                if lang is not None:
                    totals[lang] = totals.get(lang, 0) + int(n)
                    continue
                whole = chunks.setdefault(int(chunk), np.zeros(CHUNK, small))
                at = slice(None) if places is None else np.frombuffer(places, np.uint16)
                whole[at] = np.minimum(whole[at] + np.frombuffer(counts, small), least)
        if totals:
            yield pd.DataFrame({"lang": list(totals), "n": list(totals.values()), "chunk": None, "bits": None})
        for chunk, counts in chunks.items():
            yield pd.DataFrame({"lang": [None], "n": [None], "chunk": [chunk], "bits": [np.packbits(counts >= least).tobytes()]})

    return counted.repartition("lang", "chunk").mapInPandas(run, "lang string, n long, chunk int, bits binary")


def _filter(added: DataFrame) -> bytes:
    """All bits: CELLS / 8 bytes at any size of input."""
    made = bytearray(CELLS // 8)
    size = CHUNK // 8
    for row in added.where("chunk is not null").toLocalIterator():
        made[row.chunk * size : (row.chunk + 1) * size] = row.bits
    return bytes(made)


def _suffixes(rows: DataFrame, bits: bytes, max_n: int) -> DataFrame:
    """(lang, suffix, n): from every place of a word the words up to ``max_n``, to the end of the piece, or to where the filter tells
    that a word or pair is rare, each followed by a space; equal ones of a batch as one row. What is cut off is part of no frequent phrase."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = np.frombuffer(sent.value, np.uint8)
        often = lambda cell: (cell >= 0) & ((table_of[np.maximum(cell, 0) >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
        for words in _by_lang(b.to_pandas() for b in batches):
            one, two = (often(c) for c in words.cells(CELLS))
            padded = np.concatenate([words.ids, np.zeros(max_n, np.int32)])
            joined = np.concatenate([two & one & np.append(one[1:], False), np.zeros(max_n, bool)])
            at = np.flatnonzero(one)
            goes = np.ones(len(at), bool)
            cols = [words.ids[at]]
            for k in range(1, max_n):
                goes &= joined[at + k - 1]
                cols.append(np.where(goes, padded[at + k], 0))
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            if not len(at):
                continue
            first = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
            starts = np.flatnonzero(first)
            spaced = pa.array([b"", *(w + b" " for w in words.words[1:])], pa.binary())
            parts = [spaced.take(pa.array(c[starts])) for c in cols]
            suffix = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))
            n = np.diff(np.append(starts, len(at)))
            yield pa.RecordBatch.from_arrays([pa.array([words.lang] * len(n), pa.string()), suffix, pa.array(n, pa.int64())], ["lang", "suffix", "n"])

    return rows.mapInArrow(run, "lang string, suffix binary, n long")


@dataclass
class Open:
    """A prefix on the stack: it goes on as long as the suffixes begin with it."""

    lang: str
    prefix: bytes
    count: int
    #: Whether the rows before the first may have had it too.
    edge: bool


def count_prefixes(batches: Iterator[pa.RecordBatch], max_n: int, least: int) -> Iterator[tuple[str, bytes, int, int]]:
    """(lang, prefix, words, n) of all prefixes of sorted suffixes that occur ``least`` times, or that may go on in other rows, before
    the first or behind the last. One stack holds the prefixes, of one word, two, ..., of the suffix at hand; what begins and ends
    within a batch is summed up there at once."""
    stack: list[Open | None] = [None] * max_n
    fresh = [True] * max_n
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, suffix, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        parts = pc.split_pattern(suffix, b" ")
        offsets, words = parts.offsets.to_numpy(), parts.values
        sizes = np.diff(offsets) - 1  # a space ends the last word
        new = np.append(True, pc.not_equal(lang.slice(1), lang.slice(0, len(n) - 1)).to_numpy(zero_copy_only=False))
        first = suffix[0].as_py().split(b" ")[:-1]
        same = 0
        while same < len(first) and (top := stack[same]) and top.lang == lang[0].as_py() and top.prefix == b"".join(w + b" " for w in first[: same + 1]):
            same += 1
        for k in range(max_n):
            there = sizes > k
            word = words.take(pa.array(np.where(there, offsets[:-1] + k, 0), mask=~there)).fill_null(b"")
            new[1:] |= pc.not_equal(word.slice(1), word.slice(0, len(n) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            counts = np.add.reduceat(n, starts)
            if k < same:  # the first rows go on with what is on the stack
                stack[k].count += int(counts[0])
                starts, counts = starts[1:], counts[1:]
            real = there[starts]
            if len(starts) and (top := stack[k]):
                if top.count >= least or top.edge:
                    yield top.lang, top.prefix, k + 1, top.count
                stack[k] = None
            if len(starts) and real[-1]:  # open at the end of the batch
                last = int(starts[-1])
                stack[k] = Open(lang[last].as_py(), _prefix(suffix[last].as_py(), k + 1), int(counts[-1]), fresh[k] and bool(real.sum() == 1))
                real[-1] = False
            at = np.flatnonzero(real & (counts >= least) | real & fresh[k] & (np.cumsum(real) == 1))
            fresh[k] &= not there.any()
            for i in at.tolist():
                yield lang[int(starts[i])].as_py(), _prefix(suffix[int(starts[i])].as_py(), k + 1), k + 1, int(counts[i])
    for k, top in enumerate(stack):
        if top:
            yield top.lang, top.prefix, k + 1, top.count


def _prefix(suffix: bytes, k: int) -> bytes:
    return b"".join(w + b" " for w in suffix.split(b" ")[:k])


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n), the words of each language, and (lang, phrase, k, f), all sequences of up to ``max_n`` words that occur ``least``
    times, counted within pieces. Both are stored."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    added = stored(_added_up(_counted(rows, least), least))
    totals = stored(added.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")))
    suffixes = stored(_suffixes(rows, _filter(added), max_n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in count_prefixes(batches, max_n, least):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["lang", "prefix", "k", "f"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["lang", "prefix", "k", "f"])

    # ranges of language, first word and, where that is frequent, the words behind it; reverse order within
    keys = [F.col("lang").desc(), F.col("suffix").desc()]
    dealt = suffixes.repartitionByRange(*keys).sortWithinPartitions(*keys).select("lang", "suffix", "n")
    found = dealt.mapInArrow(run, "lang string, prefix binary, k long, f long")
    found = found.groupBy("lang", "prefix", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return totals, stored(found.select("lang", F.expr("cast(substring(prefix, 1, length(prefix) - 1) as string)").alias("phrase"), "k", "f"))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_n`` words.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line breaks into pieces, those at spaces and tabs into words. A
    phrase that occurs a >= ``least`` times is scored at its worst cut: floor(2000000 a / (l + r)) with the occurrences of its
    two parts, the shortest first part of equals. It goes if a longer such phrase holds its words one after another and
    occurs at least ``subsumed`` hundredths as often. Null or empty text: no words; null language: ``und``; repeated rows
    count each time; an empty table gives no rows; other columns are not looked at; texts of any length are read whole."""
    totals, counts = phrase_counts(docs, max_n, least)
    words = F.split("phrase", " ")
    long = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = long.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k").cast("int") - F.col("cut")).alias("tail"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(27,0)) * 2000000bd) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"), F.first("a").alias("a"))
    # the inner phrases of longer ones: as often as the most frequent of those
    inner = long.where("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k").cast("int") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") - F.col("m") + 1)).alias("s"))
    inner = inner.select("lang", joined(F.col("s"), F.col("m")).alias("phrase"), F.col("a").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (wide("around") * 100 < wide("a") * subsumed))
    kept = kept.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score"))
    # first within parts of a language, so that no task sorts all its phrases
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("part", F.pmod(F.hash("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents
),
worded AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
totals AS (SELECT lang, count(*) AS n FROM place GROUP BY lang),
gram AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM place, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, phrase, k, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
longer AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT lang, phrase, a, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail, c FROM longer, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.c, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS around
  FROM longer, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL
),
kept AS (SELECT x.* FROM worst x LEFT JOIN inside i USING (lang, phrase) WHERE i.around IS NULL OR i.around::HUGEINT * 100 < x.a::HUGEINT * 80),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
