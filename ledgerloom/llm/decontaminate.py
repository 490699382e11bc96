"""Benchmark decontamination: template windows joined by hash, then a check that slots are filled consistently."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, table, whole_groups

#: Tokens of a window; a shorter item is one window of its own length, as it is and, from TEMPLATE tokens on, as template.
WINDOW, TEMPLATE = 6, 4
#: A document holds an item if so many of its tokens in a row, or so large a share of its windows, are found.
RUN_TOKENS, SHARE = 13, 0.5
#: Found windows that start at most so many tokens apart are in a row.
STEP = 3
#: A window that more items share is looked up beside others of its item only, but for items that such windows alone can tell.
OWN_ITEMS = 100
#: Bits of the filter that tells which windows are worth a row; 2 MB whatever the benchmark's size.
FILTER_BITS = 1 << 24
UNITS = frozenset("mm cm m km kg g mg lb lbs oz l ml inch inches feet foot ft mile miles meter meters metre metres gram grams liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent degree degrees mph kmh".split())
SIGNS = frozenset("%$€£")
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:\n%$€£]")  # words, by far the most, first
_B = 0x9E3779B97F4A7C15
_LOWER, _CAPITAL, _NUMBER, _BREAK, _UNIT, _SIGN = range(6)
_SLOT = {k: np.uint64(int.from_bytes(hashlib.blake2b(f"<{k}>".encode(), digest_size=8).digest(), "big")) for k in ("number", "name", "unit")}
#: Tells the tokens of windows as they are from those of templates.
_LITERAL = np.uint64(0xD6E8FEB86659FD93)
_REMEMBERED, _TEXTS = 150_000, 500


def _kind(token: str) -> int:
    if token.islower() and token[0].isalpha():  # most tokens
        return _UNIT if token in UNITS else _LOWER
    if token[0].isdigit():
        return _NUMBER
    if token in SIGNS:
        return _SIGN
    if not token[0].isalpha():
        return _BREAK
    if token.lower() in UNITS:
        return _UNIT
    return _CAPITAL if token[0].isupper() and not (len(token) > 1 and token.isupper()) else _LOWER


class Reading:
    """Texts as three sequences of tokens, one after the other: ``literal``, lower-cased words as they are; two of
    templates, in which numbers, units that follow a number, currency signs and names are typed slots. A name is a run of
    capitalised words; the first word of a sentence is a word in the second sequence and a name in the third, if
    capitalised. Each sequence: hash, slot, first raw token, last raw token + 1, text, place in the text."""

    def __init__(self, texts: list[str | None], learned: Reader):
        found = [["\n", *_TOKEN.findall(t or "")] for t in texts]
        self.tokens = [t for tokens in found for t in tokens]
        h, k = learned.of(self.tokens)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        before = np.append(_BREAK, k[:-1])
        capital, number = k == _CAPITAL, k == _NUMBER
        unit = ((k == _UNIT) & (before == _NUMBER)) | (k == _SIGN)
        self.place = np.cumsum(k != _BREAK) - 1  # of raw tokens, in the literal sequence over all texts
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        self.place -= np.append(-1, self.place)[first][owner] + 1
        self.start = capital & (before == _BREAK)
        self.sequences = [(h ^ _LITERAL, np.zeros(len(k), bool), np.flatnonzero(k != _BREAK))]
        for names in (capital & ~self.start, capital):
            made, slot = h.copy(), names | unit | number
            made[number], made[unit], made[names] = _SLOT["number"], _SLOT["unit"], _SLOT["name"]
            again = names & np.append(False, names[:-1]) & ~self.start  # a further word of a name
            self.sequences.append((made, slot, np.flatnonzero((k != _BREAK) & ~again)))
        # of literal windows the values are those of the first template
        self.owner, self.named, self.literal_slot = owner, capital, self.sequences[1][1]

    def windows(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, places in the sequence, hashes) of the windows of ``n`` tokens: all as they are; of the templates those of which
        half or more are words, of the last sequence only what the one before has not."""
        for kind, (made, slot, at) in enumerate(self.sequences):
            if len(at) < n or (kind and n < TEMPLATE):
                continue
            h, s = made[at], np.append(0, np.cumsum(slot[at]))
            out = np.full(len(at) - n + 1, n, np.uint64)
            for j in range(n):
                out = out * np.uint64(_B) + h[j : len(out) + j]
                out ^= out >> np.uint64(31)
            ok = self.owner[at[n - 1 :]] == self.owner[at[: len(out)]]
            if kind:
                ok &= 2 * (s[n:] - s[:-n]) <= n
            if kind == 2:
                starts = np.append(0, np.cumsum(self.start[at]))
                ok &= starts[n:] > starts[:-n]
            places = np.flatnonzero(ok)
            yield kind, places, out[places]

    def values(self, kind: int, p: int, n: int) -> list[str]:
        """What fills the slots of a window; of a name its last word, as the words before may be no part of it."""
        made, slot, at = self.sequences[kind]
        slot = slot if kind else self.literal_slot
        out = []
        for i in at[p : p + n].tolist():
            if slot[i]:
                to = i + 1
                while kind and self.named[i] and to < len(self.tokens) and self.named[to] and not self.start[to]:
                    to += 1
                out.append(self.tokens[to - 1].lower())
        return out


class Reader:
    """Hashes and kinds of the tokens seen so far, up to a number."""

    def __init__(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(count().__next__)  # a token not seen yet gets the next number
        self.hashes, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > _REMEMBERED:
            self.__init__()
        before = len(self.known)
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        fresh = list(islice(self.known, before, None))
        digest = xxhash.xxh64_intdigest
        self.hashes = np.append(self.hashes, np.array([digest(t.lower().encode("utf-8", "replace")) for t in fresh], np.uint64))
        self.kinds = np.append(self.kinds, np.array([_kind(t) for t in fresh], np.int8))
        return self.hashes[ids], self.kinds[ids]

    def read(self, texts: list[str | None]) -> Reading:
        return Reading(texts, self)


_FIELDS = "pos int, n int, h long, kind int, vals array<string>"


def item_windows(rows: pd.DataFrame, reader: Reader) -> pd.DataFrame:
    """All windows of items: item_id, pos, n, h, kind, vals, n_plain (windows as they are), n_made (places of templates), n_tokens."""
    got = reader.read(rows["text"].tolist())
    sizes = np.bincount(got.owner[got.sequences[0][2]], minlength=len(rows))
    own: list[list[tuple]] = [[] for _ in sizes]
    for n in np.unique(np.minimum(sizes, WINDOW))[::-1].tolist():
        for kind, at, h in got.windows(n) if n else ():
            for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                i = got.sequences[kind][2][p]
                if min(WINDOW, sizes[got.owner[i]]) == n:
                    own[got.owner[i]].append((int(got.place[i]), n, x, kind, got.values(kind, p, n)))
    out = []
    for item, size, windows in zip(rows["item_id"], sizes.tolist(), own, strict=True):
        counts = sum(w[3] == 0 for w in windows), len({w[0] for w in windows if w[3]})
        out += [(item, *w, *counts, size) for w in windows]
    made = pd.DataFrame(out, columns=["item_id", "pos", "n", "h", "kind", "vals", "n_plain", "n_made", "n_tokens"])
    return made.astype({"vals": object})


def document_windows(rows: pd.DataFrame, reader: Reader, lengths: list[int], passes: np.ndarray) -> pd.DataFrame:
    """Those windows of documents that an item may have."""
    got = reader.read(rows["text"].tolist())
    ids = rows["doc_id"].to_numpy()
    out = []
    for n in lengths:
        for kind, at, h in got.windows(n):
            bit = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            hit = (passes[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            for p, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True):
                i = got.sequences[kind][2][p]
                out.append((ids[got.owner[i]], int(got.place[i]), n, x, kind, got.values(kind, p, n) if kind else None))
    return pd.DataFrame(out, columns=["doc_id", "pos", "n", "h", "kind", "vals"]).astype({"vals": object})


def longest_run(places: list[int], n: int) -> int:
    """Tokens of the longest row of windows of ``n`` tokens at ascending ``places``."""
    run = longest = n
    for p, q in zip(places, places[1:], strict=False):
        run = run + q - p if q - p <= STEP else n
        longest = max(longest, run)
    return longest


def told_by(windows: pd.DataFrame) -> bool:
    """Whether these windows of an item are enough to find it, if a document has them all."""
    first, plain = windows.iloc[0], windows["kind"] == 0
    share = max(windows.loc[plain, "pos"].nunique() / first["n_plain"], windows.loc[~plain, "pos"].nunique() / first["n_made"] if first["n_made"] else 0.0)
    return share >= SHARE or longest_run(sorted(set(windows["pos"])), int(first["n"])) >= RUN_TOKENS


def judged(windows: list[tuple[int, int, int, tuple, tuple]], n: int, n_plain: int, n_made: int, n_tokens: int) -> tuple[int, float, int, bool] | None:
    """(n_windows, share, run_tokens, exact) of the passage that holds most of an item, or None if none holds enough.

    ``windows``: (item place, document place, kind, item's values, document's values) of all windows that met. A passage is
    what lies together in the document: shifts between places that are at most an item's length apart. In a passage
    each value of the item stands for that of the document which most windows give it (its own before others), and
    the other way round; a template window with another pair counts for nothing, nor does any with a value of which
    another pair has over a third as many windows. Windows as they are count in any case."""
    windows = sorted(windows, key=lambda w: w[1] - w[0])
    best = None
    at = 0
    while at < len(windows):
        to = at + 1
        while to < len(windows) and (windows[to][1] - windows[to][0]) - (windows[to - 1][1] - windows[to - 1][0]) <= n_tokens:
            to += 1
        given: dict[tuple, list] = {}
        for (iv, dv), times in Counter(p for w in windows[at:to] for p in set(zip(w[3], w[4], strict=True))).items():
            given.setdefault((0, iv), []).append((times, iv == dv, dv))
            given.setdefault((1, dv), []).append((times, iv == dv, iv))
        stands = {}
        for key, found in given.items():
            found.sort(reverse=True)
            stands[key] = found[0][2] if len(found) == 1 or 3 * found[1][0] <= found[0][0] else None
        good = [w for w in windows[at:to] if w[2] == 0 or all(stands[0, iv] == dv and stands[1, dv] == iv for iv, dv in zip(w[3], w[4], strict=True))]
        at = to
        if not good:
            continue
        places = sorted({w[0] for w in good})
        plain, made = len({w[0] for w in good if w[2] == 0}), len({w[0] for w in good if w[2]})
        share = max(plain / n_plain, made / n_made if n_made else 0.0)
        longest = longest_run(places, n)
        if share >= SHARE or longest >= RUN_TOKENS:
            exact = plain == n_plain or all(w[3] == w[4] for w in good)
            best = max(best or (), (len(places), round(share, 6), longest, exact))
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, item_id, n_windows, share, run_tokens, exact for each document and benchmark item it holds.

    ``exact``: all of it as it is, or all slots hold the item's own values; otherwise it is the item with other numbers, names or units, filled
    consistently (``judged``). Windows meet as they are in lower case, whatever their slots and length, so copies are found in
    any place, also of items of a single word; those of TEMPLATE tokens and more of which half or more are words meet as
    templates too. ``share`` is the larger of that of all windows as they are and that of all places of templates.
    Windows meet in a hash join on the whole benchmark, whatever its size; before it a fixed-size filter drops windows that no
    item has. Windows that over OWN_ITEMS items share are looked up only where another window of the item has met. With
    ``whole`` nothing is lost by that: of items that such windows can tell without others (``told_by``) all windows meet at
    once, so every item that ``judged`` finds is found. Without it they are boilerplate, which proves nothing alone of items
    that have other windows. Null and empty texts hold nothing; null ids are left out; the rows of a doc_id count as one
    document; other columns are ignored."""

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            yield item_windows(batch, reader)

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    wanted = stored(items.mapInPandas(of_items, f"item_id long, {_FIELDS}, n_plain int, n_made int, n_tokens int"))
    bits = wanted.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("b")).distinct()
    words = bits.groupBy(F.shiftright("b", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(b & 7 AS INT))")).alias("bits")).toPandas()
    passes = np.zeros(FILTER_BITS // 8, np.uint8)  # at most this many rows came to the driver
    passes[words["byte"].to_numpy(np.int64)] = words["bits"].to_numpy(np.uint8)
    lengths = sorted(r.n for r in wanted.select("n").distinct().collect())  # at most WINDOW values
    shared = docs.sparkSession.sparkContext.broadcast(passes)
    result = "doc_id long, item_id long, n_windows long, share double, run_tokens long, exact boolean"
    if not lengths:
        return docs.sparkSession.createDataFrame([], result)

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                yield document_windows(batch.iloc[at : at + _TEXTS], reader, lengths, shared.value)

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stored(texts.mapInPandas(of_docs, f"doc_id long, {_FIELDS}").select("doc_id", "h", "n", F.col("pos").alias("dp"), F.col("vals").alias("dv")))
    times = wanted.select("item_id", "h", "n").distinct().groupBy("h", "n").agg(F.count("*").alias("n_items"))
    wanted = wanted.join(times, ["h", "n"]).withColumn("own", F.col("n_items") <= OWN_ITEMS)

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["item_id"]):
            yield pd.DataFrame({"item_id": [item for item, rows in frame.groupby("item_id", sort=False) if told_by(rows)]}, dtype="int64")

    if whole:
        common = wanted.where("not own").select("item_id", "pos", "n", "kind", "n_plain", "n_made").repartition("item_id").sortWithinPartitions("item_id")
        told = common.mapInPandas(alone, "item_id long")
    else:
        told = wanted.groupBy("item_id").agg(F.max("own").alias("own")).where("not own").select("item_id")
    told = told.withColumn("told", F.lit(True))
    wanted = stored(wanted.join(told, "item_id", "left").withColumn("own", F.col("own") | F.col("told").isNotNull()).withColumnsRenamed({"pos": "ip", "vals": "iv"}).drop("n_items", "told"))
    met = stored(seen.join(wanted.where("own"), ["h", "n"]))
    common = wanted.where("not own")
    if not common.isEmpty():
        met = met.unionByName(met.select("doc_id", "item_id").distinct().join(common, "item_id").join(seen, ["doc_id", "h", "n"]))
    met = met.withColumn("dv", F.coalesce("dv", "iv")).where(F.size("dv") == F.size("iv"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["doc_id", "item_id"]):
            out = []
            for (doc, item), rows in frame.groupby(["doc_id", "item_id"], sort=False):
                first = rows.iloc[0]
                windows = zip(rows["ip"].tolist(), rows["dp"].tolist(), rows["kind"].tolist(), map(tuple, rows["iv"]), map(tuple, rows["dv"]), strict=True)
                found = judged(list(windows), int(first["n"]), int(first["n_plain"]), int(first["n_made"]), int(first["n_tokens"]))
                if found:
                    out.append((doc, item, *found))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_windows", "share", "run_tokens", "exact"])

    met = met.select("doc_id", "item_id", "ip", "dp", "kind", "iv", "dv", "n", "n_plain", "n_made", "n_tokens")
    return met.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id").mapInPandas(judge, result)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, ascending) and exact for every document."""
    docs = table(spark, sf_dir, "documents")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"), whole=True)
    by_doc = leaks.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("exact").alias("exact"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(by_doc, "doc_id", "left")
    return out.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("exact", F.lit(False)).alias("exact"),
    )
