"""Language-model scores: context-tree weighting over binary-decomposed bytes, beside a word unigram base."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, stored, table
from ledgerloom.llm.toxicity import _find, _sums, fold

#: Bytes of the deepest context; the tree's root is the context of none.
DEPTH = 7
#: Context bytes at the start of a word; from its fifth byte on, a context reaches back to the word's start at most.
NEAR = 4
#: The tree's levels from this one down are weighted and read in tasks, each with whole contexts of this many bytes;
#: the driver holds the levels above it, at most 2^24 entries whatever the corpus.
ROOT = 3
#: So many of the most looked-up grams and words, at most, are looked up in memory, all others by joins.
MAX_GRAMS, MAX_WORDS = 1 << 20, 1 << 18
SPACE, END = 0x20, 0x0A
_RUN, _GROUPS = 4_000_000, 400_000


#: Odds of going on against stopping, as logs; ALWAYS: stop.
_ALWAYS = np.float32(-np.inf)
_MASKS = np.array([(1 << 8 * (n + 1)) - 1 for n in range(DEPTH + 1)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def stream_of(words: list[bytes]) -> bytes:
    """The words, each closed by a space, and the end; what the model gives a probability to, byte by byte."""
    return b" ".join([*words, bytes([END])]) if words else bytes([END])


def packed(streams: list[bytes], inside: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(grams, stream index): each byte with the bytes of its context, up to DEPTH; before a stream stand ENDs and a space.

    A byte's context is that of NEAR bytes or what its word has before it, with the space; the rest of a gram is zero.
    ``inside``: only bytes whose context lies in their word, so that the word alone tells the gram, or only all others."""
    pad = bytes([END]) * (DEPTH - 1) + bytes([SPACE])
    flat = np.frombuffer(b"".join([pad + s for s in streams]), np.uint8)
    sizes = np.array([len(s) for s in streams], np.int64)
    owner = np.repeat(np.arange(len(streams)), sizes)
    at = np.arange(len(owner)) + (owner + 1) * DEPTH
    # bytes since the space before the word, at each place
    since = at - np.maximum.accumulate(np.where(flat == SPACE, np.arange(len(flat)), 0))[at - 1]
    if inside is not None:
        chosen = np.flatnonzero((since >= NEAR) == inside)
        owner, at, since = owner[chosen], at[chosen], since[chosen]
    grams = np.zeros(len(owner), np.uint64)
    for back in range(NEAR if inside is False else DEPTH, -1, -1):
        grams = (grams << np.uint64(8)) | flat[at - back]
    return grams & _MASKS[np.clip(since, NEAR, DEPTH)], owner


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


class ContextTree:
    """Byte contexts of 0 to DEPTH bytes; in each, a byte is eight binary choices, so a node is a context and the bits
    chosen so far.

    Weighting: P(node) = (KT(node) + product of P over the node with one byte more of context) / 2; the share of the first
    term is the weight of stopping there. A prediction follows the contexts of a place from short to long, mixing the KT
    estimates of all depths by these weights, and stops at the deepest node that the corpus supports."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: int = 0, high: int = DEPTH, longer: dict | None = None):
        """``grams``: each byte with its context; ``counts`` over the corpus. What comes with a shorter context than
        others is a branch of its own there, so that counts add up at every depth. Only levels ``low`` to ``high`` are
        made; ``longer``: what the level below them leaves in its ``above``, log P of its nodes summed by shorter node."""
        self.low = low
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by depth: grams, counts, log odds of going on
        key, c = grams, counts.astype(np.float64)
        below: dict[int, tuple[np.ndarray, np.ndarray]] = dict(longer or {})
        for d in range(high, low - 1, -1):
            key, c = _sums(key & np.uint64((1 << 8 * (d + 1)) - 1), c)
            stop = np.full((len(key), 8), _ALWAYS, np.float32)
            above: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for bit in range(8):
                node, a, b = self._nodes(key, c, bit)
                total = log_kt(a, b)
                deeper = below.pop(bit, None)
                if deeper is not None and len(deeper[0]):
                    at, hit = _find(deeper[0], node)
                    odds = np.where(hit, deeper[1][at] - total, -np.inf)  # of going on against stopping
                    at, _ = _find(node, self._node_of(key, bit))
                    stop[:, bit] = odds[at]
                    total = np.where(hit, total + np.logaddexp(0, odds) - np.log(2), total)
                # to the node with one byte less of context
                above[bit] = _sums(node & np.uint64((1 << (8 * d - 8 + bit)) - 1), total) if d else (node, total)
            below = above
            self.tables.append((key, c, stop))
        self.tables.reverse()
        self.above = below

    def running(self) -> list[np.ndarray]:
        """Running counts of each table, made once in each process that scores."""
        if not hasattr(self, "upto"):
            self.upto = [np.append(0, np.cumsum(c, dtype=np.float64)) for _, c, _ in self.tables]
        return self.upto

    @staticmethod
    def _node_of(key: np.ndarray, bit: int) -> np.ndarray:
        """The context and the first ``bit`` bits of the byte."""
        return key >> np.uint64(8 - bit)

    def _nodes(self, key: np.ndarray, c: np.ndarray, bit: int) -> tuple[np.ndarray, ...]:
        one = ((key >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
        return _sums(self._node_of(key, bit), c * (1 - one), c * one)

    def log10_p(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(grams))
        for bit in range(8):
            ones = ((grams >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            p, left = np.zeros(len(grams)), np.ones(len(grams))
            last = np.full(len(grams), 0.5)
            alive = np.arange(len(grams))
            for d, ((key, _, stop), upto) in enumerate(zip(self.tables, self.running(), strict=True), self.low):
                g = grams[alive] & np.uint64((1 << 8 * (d + 1)) - 1)
                free = np.uint64(8 - bit)
                low = (g >> free) << free
                mid = low | (np.uint64(1) << (free - np.uint64(1)))
                lo, mi, hi = np.searchsorted(key, low), np.searchsorted(key, mid), np.searchsorted(key, low + (np.uint64(1) << free))
                seen = hi > lo
                alive, lo, mi, hi = alive[seen], lo[seen], mi[seen], hi[seen]
                if not len(alive):
                    break
                zeros, count = upto[mi] - upto[lo], upto[hi] - upto[lo]
                side = np.where(ones[alive], count - zeros, zeros)
                kt = (side + 0.5) / (count + 1)
                w = 1 / (1 + np.exp(np.minimum(stop[lo, bit].astype(np.float64), 700)))
                p[alive] += left[alive] * w * kt
                left[alive] *= 1 - w
                last[alive] = kt
            out += np.log10(np.maximum(p + left * last, 1e-300))
        return out


class GramTable:
    """Values of grams in a hash table of twice to four times their number."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2)))))
        self.slot_key = np.full(1 << (64 - int(self.shift)), ~np.uint64(0))
        self.slot_p = np.zeros(len(self.slot_key))
        rest, step = np.arange(len(keys)), 0
        while len(rest):
            slot = self._slot(keys[rest], step)
            free = self.slot_key[slot] == ~np.uint64(0)
            slot, first = np.unique(np.where(free, slot, len(self.slot_key)), return_index=True)
            if len(slot) and slot[-1] == len(self.slot_key):
                slot, first = slot[:-1], first[:-1]
            self.slot_key[slot], self.slot_p[slot] = keys[rest[first]], values[rest[first]]
            placed = np.zeros(len(rest), bool)
            placed[first] = True
            rest, step = rest[~placed], step + 1
        self.steps = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift) + np.uint64(step)) & np.uint64(len(self.slot_key) - 1)).astype(np.int64)

    def sums(self, grams: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each of ``n`` owners the sum of its grams' values, and its grams that the table lacks."""
        out, rest, missing = np.zeros(len(grams)), np.arange(len(grams)), []
        for step in range(self.steps):
            if not len(rest):
                break
            slot = self._slot(grams[rest], step)
            key = self.slot_key[slot]
            hit, gone = key == grams[rest], key == ~np.uint64(0)
            out[rest[hit]] = self.slot_p[slot[hit]]
            missing.append(rest[gone])
            rest = rest[~hit & ~gone]
        left = np.sort(np.concatenate([*missing, rest]))
        bounds = np.searchsorted(owner[left], np.arange(1, n))
        return np.bincount(owner, weights=out, minlength=n), np.split(grams[left].view(np.int64), bounds)


def _runs(streams: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of streams of about _RUN bytes each."""
    at = 0
    while at < len(streams):
        to, size = at, 0
        while to < len(streams) and (to == at or size + len(streams[to]) <= _RUN):
            size += len(streams[to])
            to += 1
        yield at, to
        at = to


class _Adder:
    """Sums by gram of two counts, added up in memory until they are taken."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, grams: np.ndarray, *counts: np.ndarray) -> None:
        self.held.append(_sums(grams, *counts))
        if len(self.held) > 6:
            self.held = [self.total()]

    def total(self) -> tuple[np.ndarray, ...]:
        return _sums(*map(np.concatenate, zip(*self.held, strict=True)))

    def frames(self) -> Iterator[pd.DataFrame]:
        key, n, looks = self.total() if self.held else (np.zeros(0, np.uint64),) * 3
        for at in range(0, len(key), 500_000):
            part = slice(at, at + 500_000)
            yield pd.DataFrame({"gram": key[part].view(np.int64), "n": n[part].astype(np.int64), "looks": looks[part].astype(np.int64)})


def corpus_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n, looks, wid) and (gram, n, looks) over all texts of ``docs`` (text, learn): n counts rows that teach, looks
    all occurrences, of a gram inside words all words; each task adds up its batches before anything moves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: tuple[Counter, Counter] = (Counter(), Counter())
        heads = _Adder()

        def out() -> Iterator[pd.DataFrame]:
            for learn, seen in enumerate(words):
                if seen:
                    looks = np.fromiter(seen.values(), np.int64, len(seen))
                    yield pd.DataFrame({"word": list(seen), "gram": None, "n": looks * learn, "looks": looks}).astype({"gram": "Int64"})
                    seen.clear()

        for batch in batches:
            streams, learns = [], batch["learn"].to_numpy(bool)
            for text, learn in zip(batch["text"], learns.tolist(), strict=True):
                w = words_of(text)
                words[learn].update(w)
                words[learn][bytes([END])] += 1
                streams.append(stream_of(w))
            for at, to in _runs(streams):
                grams, owner = packed(streams[at:to], inside=False)
                teaches = learns[at:to][owner]
                for learn in (False, True):
                    key = np.sort(grams[teaches == learn])
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                    looks = np.diff(np.append(first, len(key)))
                    heads.add(key[first], looks * learn, looks)
            if len(words[0]) + len(words[1]) > 600_000:
                yield from out()
        yield from out()
        for frame in heads.frames():
            yield frame.assign(word=None)[["word", "gram", "n", "looks"]].astype({"gram": "Int64"})

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tails = _Adder()
        for batch in batches:
            streams, n = [bytes(w) + b" " for w in batch["word"]], batch["n"].to_numpy()
            for at, to in _runs(streams):
                grams, owner = packed(streams[at:to], inside=True)
                tails.add(grams, n[at:to][owner], np.ones(len(grams), np.int64))
        yield from tails.frames()

    both = stored(docs.select("text", "learn").mapInPandas(count, "word binary, gram long, n long, looks long"))
    sums = F.sum("n").alias("n"), F.sum("looks").alias("looks")
    words = stored(both.where("word is not null").groupBy("word").agg(*sums).withColumn("wid", F.monotonically_increasing_id()))
    tails = words.where(F.col("word") != F.lit(bytes([END]))).select("word", "n").mapInPandas(inside, "gram long, n long, looks long")
    grams = both.where("gram is not null").select("gram", "n", "looks").unionByName(tails).groupBy("gram").agg(*sums)
    return words, stored(grams)


def _whole_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of some whole contexts of ROOT bytes at a time, from rows that are sorted by ``ctx``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= _GROUPS:
            rows = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(rows["ctx"].to_numpy(), rows["ctx"].iloc[-1]))
            if cut:
                yield rows["gram"].to_numpy(np.int64)[:cut].view(np.uint64), rows["n"].to_numpy(np.float64)[:cut]
            held = [rows.iloc[cut:]]
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.float64)


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, p, looks): log10 probability of each gram's last byte by the tree of all grams with n > 0.

    The levels from ROOT down fall apart into subtrees, one a context of ROOT bytes, which tasks weight and read; their
    roots' totals make up the levels above."""
    dealt = grams.withColumn("ctx", F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * ROOT) - 1))).repartition("ctx").sortWithinPartitions("ctx")
    shorter = np.uint64((1 << 8 * ROOT) - 1)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, n in _whole_contexts(batches):
            key, n = key[n > 0], n[n > 0]
            upper = _sums(key & shorter, n)
            for bit, (node, total) in [(-1, upper), *ContextTree(key, n, low=ROOT).above.items()]:
                yield pd.DataFrame({"bit": bit, "node": node.astype(np.int64), "total": total})

    # of the levels above ROOT, whose number of grams is bounded by that of ROOT bytes
    roots = dealt.select("ctx", "gram", "n").mapInPandas(weigh, "bit int, node long, total double").groupBy("bit", "node").agg(F.sum("total").alias("total"))
    roots = stored(roots).toArrow().sort_by("node")
    bit, node, total = roots["bit"].to_numpy(), roots["node"].to_numpy().astype(np.uint64), roots["total"].to_numpy()
    top = ContextTree(node[bit < 0], total[bit < 0], high=ROOT - 1, longer={b: (node[bit == b], total[bit == b]) for b in range(8)}).tables
    shared = grams.sparkSession.sparkContext.broadcast(top)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, n in _whole_contexts(batches):
            tree = ContextTree(key[n > 0], n[n > 0], low=ROOT)
            tree.tables, tree.low = [*shared.value, *tree.tables], 0
            yield pd.DataFrame({"gram": key.view(np.int64), "p": tree.log10_p(key)})

    return dealt.select("ctx", "gram", "n").mapInPandas(read, "gram long, p double")


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """``counts`` down to the number of looks from which there are no more than ``most`` rows."""
    classes = counts.groupBy(F.floor(F.log2("looks") * 16).alias("c")).agg(F.count("*").alias("k"), F.min("looks").alias("looks")).toPandas()  # 1,024 rows at most
    classes = classes.sort_values("c", ascending=False)
    fits = classes[classes["k"].cumsum() <= most]
    return counts.where(F.col("looks") >= (int(fits["looks"].min()) if len(fits) else (1 << 62)))


def score_language(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte for each row of ``docs``
    (doc_id, text, learn).

    Rows whose ``learn`` is true teach and are counted in whole, no entry is left out. score: log10 of the context
    tree's probability of the text as lower-cased words, a space after each, and an end; bits_per_byte: its code length in
    bits by the n_bytes of that. base_score: the same under single
    words with one added to each count. Null and empty texts: the end alone. Null learn: false. Repeated rows are kept; no
    rows that teach: every bit is 1/2, all words are unknown. Ids may be null; other columns are ignored.

    A text's score is the sum over its words of what a word gives by itself, from its fourth byte on, and of the bytes
    before, whose contexts reach into the word before. Both are looked up: the most frequent in memory, others by joins."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("learn"), F.lit(False)).alias("learn"))
    words, grams = corpus_counts(rows)
    n_all, n_kinds = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scores = stored(gram_scores(grams).join(grams.select("gram", "looks"), "gram"))
    hot = _most_frequent(scores, MAX_GRAMS).select("gram", "p").toArrow()
    table_ = spark.sparkContext.broadcast((uuid.uuid4().hex, hot["gram"].to_numpy().view(np.uint64), hot["p"].to_numpy()))
    del hot

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _made(table_, lambda value: GramTable(*value[1:]))
        for batch in batches:
            streams = [bytes(w) + b" " if bytes(w) != bytes([END]) else b"" for w in batch["word"]]
            tail, far = np.zeros(len(streams)), []
            for at, to in _runs(streams):
                tail[at:to], missing = known.sums(*packed(streams[at:to], inside=True), to - at)
                far += missing
            yield batch.assign(tail=tail, far=far)

    made = stored(words.mapInPandas(inside, "word binary, n long, looks long, wid long, tail double, far array<long>"))
    more = made.where("size(far) > 0").select("wid", F.explode("far").alias("gram")).join(scores.select("gram", "p"), "gram").groupBy("wid").agg(F.sum("p").alias("more"))
    scored = made.drop("far").join(more, "wid", "left").select("word", "n", "looks", (F.col("tail") + F.coalesce("more", F.lit(0.0))).alias("tail"))
    scored = stored(scored)
    common = _most_frequent(scored, MAX_WORDS).select("word", "n", "tail").toArrow()
    words_ = spark.sparkContext.broadcast((uuid.uuid4().hex, common["word"].to_pylist(), common["n"].to_numpy(), common["tail"].to_numpy()))
    del common
    base = float(np.log10(n_all + 1.0 * (n_kinds + 1)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _made(table_, lambda value: GramTable(*value[1:]))
        place, seen, logs, tails = _made(words_, lambda v: ({w: i for i, w in enumerate(v[1])}, np.append(v[2] > 0, False), np.append(np.log10(v[2] + 1.0), 0), np.append(v[3], 0)))
        for batch in batches:
            out, streams = [], []
            for text in batch["text"]:
                w = [*words_of(text), bytes([END])]
                at = np.array([place.get(x, -1) for x in w], np.int64)
                rare = [w[i] for i in np.flatnonzero(at < 0)]
                out.append((len(w), sum(map(len, w)) + len(w) - 1, int(seen[at].sum()), float(logs[at].sum()), float(tails[at].sum()), rare))
                streams.append(stream_of(w[:-1]))
            frame = pd.DataFrame(out, columns=["n_tokens", "n_bytes", "known", "logs", "score", "rare"])
            heads, far = np.zeros(len(streams)), []
            for at, to in _runs(streams):
                heads[at:to], missing = known.sums(*packed(streams[at:to], inside=False), to - at)
                far += missing
            yield frame.assign(doc_id=batch["doc_id"], row=batch["row"], score=frame["score"] + heads, far=far)[["doc_id", "row", "n_tokens", "n_bytes", "known", "logs", "score", "rare", "far"]]

    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    made = stored(numbered.mapInPandas(score, "doc_id long, row long, n_tokens long, n_bytes long, known long, logs double, score double, rare array<binary>, far array<long>"))
    # no word or gram outside the tables is frequent, so no key of these joins is hot
    rare = made.where("size(rare) > 0").select("row", F.explode("rare").alias("word")).join(scored, "word")
    rare = rare.select("row", (F.col("n") > 0).cast("long").alias("k"), F.log10(F.col("n") + 1.0).alias("l"), F.col("tail").alias("s"))
    far = made.where("size(far) > 0").select("row", F.explode("far").alias("gram")).join(scores.select("gram", "p"), "gram").select("row", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("l"), F.col("p").alias("s"))
    more = rare.unionByName(far).groupBy("row").agg(F.sum("k").alias("k"), F.sum("l").alias("l"), F.sum("s").alias("s"))
    out = made.drop("rare", "far").join(more, "row", "left")
    score_ = F.col("score") + F.coalesce("s", F.lit(0.0))
    return out.select(
        "doc_id", "row", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("l", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).alias("base_score"), score_.alias("score"),
        "n_bytes", (-score_ * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


_KEPT: dict = {}


def _made(shared, make):
    """What ``make`` makes of a broadcast value, once for all tasks of a Python worker."""
    token = shared.value[0]
    if token not in _KEPT:
        if len(_KEPT) > 1:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[token] = make(shared.value)
    return _KEPT[token]


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold(7) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("learn"))
    return score_language(docs).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
