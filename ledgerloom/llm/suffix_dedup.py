"""Suffix dedup: what windows cover that occur more than once, found by depth-limited most-significant-digit passes.

Windows are of bytes or of words. Suffixes are never told apart beyond the threshold. Each pass is one shuffle on a digit,
a longer piece of the window than the last one's, and only groups of two and more go on:

1. the anchor: of the pieces of a given length the one of smallest hash, which equal windows have at the same place;
2. the core: the tokens common to all windows of one stretch of places before an anchor;
3. the whole window.

Windows in a row share anchor and core, so the first two passes move stretches instead of places, and most repeats are settled
there: a stretch that occurs twice as a whole needs no third pass. Groups are told apart by 128-bit digests of the digits.
Equal texts are one text in all passes but the first, so copies cost a row a stretch there and nothing later."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import extended, passing, stored, table

#: Bytes of a window, and words of one.
THRESHOLD, WORDS = 400, 51
#: Of bytes and of words: tokens of an anchor's piece, as a share of the threshold; places of a stretch as a share of it.
GRAM_SHARE, STRETCH_SHARE = (0.5, 0.3), (0.08, 0.25)
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
#: Places are numbered within chunks of so many windows, so a text may have any length.
_CHUNK, _PLACE_BITS = 1 << 22, 24
#: Bits of a distance within a window; the place of an anchor has 31 bits, as texts have.
_NEAR_BITS = 16
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        made = np.full(max(n, 1 << 16), base, np.uint64)
        made[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(made)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def piece_hashes(x: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """A 64-bit hash of each piece start..end of the token codes ``x``."""
    upto = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(_INVERSE, len(x)), out=upto[1:])
    return _mixed((upto[end] - upto[start]) * _powers(_MULT, len(x) + 1)[start])


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, between white space of ASCII."""
    edge = np.diff(np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)


def token_codes(raw: bytes) -> np.ndarray:
    """A code for each byte."""
    return _BYTES[np.frombuffer(raw, np.uint8)]


def coded(raw: bytes, words: bool) -> tuple[np.ndarray, bytes, int]:
    """(a code for each token, the same as bytes, bytes a token): for bytes their own, for words a hash of eight bytes each."""
    x = token_codes(raw)
    if not words:
        return x, raw, 1
    start, end = word_places(raw)
    codes = piece_hashes(x, start, end) if len(start) else np.zeros(0, np.uint64)
    return codes, codes.tobytes(), 8


def anchors(x: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last): runs of window starts first..last with the same anchor at ``place``.

    The anchor is the leftmost of the pieces of smallest hash, so it depends on the window's tokens alone."""
    out = []
    width = threshold - gram + 1
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, len(x) - threshold + 1, _CHUNK):
        part = x[at : at + _CHUNK + threshold - 1]
        h = piece_hashes(part, slice(0, len(part) - gram + 1), slice(gram, len(part) + 1))
        packed = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
        fill = np.full(-len(packed) % width, ~np.uint64(0))
        blocks = np.concatenate([packed, fill]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - threshold + 1
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        place = (least[first] & low).astype(np.int64)
        out.append((h[place].view(np.int64), place + at, first + at, np.append(first[1:], n) - 1 + at))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _digit_one(threshold: int, gram: int, words: bool):
    """Rows of the first pass: ``r`` is a run, its anchor's place and how far its first and last window start before that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple] = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                x, _, _ = coded(text.encode("utf-8", "replace"), words)
                if len(x) >= threshold:
                    h, place, first, last = anchors(x, threshold, gram)
                    held.append((h, np.full(len(h), k1), np.full(len(h), k2), place << 2 * _NEAR_BITS | place - first << _NEAR_BITS | place - last))
            if held:
                yield pd.DataFrame({name: np.concatenate(c) for name, c in zip(("h", "k1", "k2", "r"), zip(*held, strict=True), strict=True)})

    return run


def _digit_two(threshold: int, stretch: int, words: bool):
    """Rows of the second pass: what lies around the core in ``f``; ``core`` and ``v`` (the whole stretch) as digests. Copies of
    a text that follow one another count once; should some be in another task, they only tell that the text, which is
    repeated as a whole, is repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, near = xxhash.xxh3_128_digest, (1 << _NEAR_BITS) - 1
        last_text = None
        for batch in batches:
            out = []
            for k1, k2, text, runs in zip(batch["k1"], batch["k2"], batch["text"], batch["runs"], strict=True):
                if (k1, k2) == last_text:
                    continue
                last_text = k1, k2
                _, x, u = coded(text.encode("utf-8", "replace"), words)
                for r in runs.tolist():
                    a, low, high = r >> 2 * _NEAR_BITS, r & near, r >> _NEAR_BITS & near
                    for q in range(low // stretch, high // stretch + 1):
                        o1, o2 = max(low, q * stretch), min(high, q * stretch + stretch - 1)
                        begin, end = u * (a - q * stretch), u * (a - (q + 1) * stretch + 1 + threshold)
                        first, last = u * (a - o2), u * (a - o1 + threshold)
                        out.append((digest(x[begin:end], q), digest(x[first:last], o1 << 32 | o2), q, o1, o2, x[first:begin] + x[end:last], k1, k2, a))
            if out:
                yield pd.DataFrame(out, columns=["core", "v", "q", "o1", "o2", "f", "k1", "k2", "a"])

    return run


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of tokens in overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _text_keys() -> list[Column]:
    """128 bits that tell texts apart."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, words: bool = False) -> DataFrame:
    """k1, k2 (two hashes of the text) and spans, array of (start, end): the tokens of each different text of ``docs`` that
    windows of ``threshold`` bytes, or words, cover which start anywhere else too. Texts without any are left out."""
    if not 0 < threshold < 1 << _NEAR_BITS:
        raise ValueError(f"threshold is from 1 to {(1 << _NEAR_BITS) - 1}")
    gram, stretch = max(1, int(threshold * GRAM_SHARE[words])), max(1, int(threshold * STRETCH_SHARE[words]))
    u = 8 if words else 1
    with passing(docs.sparkSession):
        texts = docs.select(*_text_keys(), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= (2 * threshold - 1 if words else threshold))
        one = stored(texts.mapInPandas(_digit_one(threshold, gram, words), "h long, k1 long, k2 long, r long"))
        twice = stored(one.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        # a set, so that the copies of a text bring its runs once
        runs = one.join(twice, "h").groupBy("k1", "k2").agg(F.collect_set("r").alias("runs"))
        fields = "core binary, v binary, q long, o1 long, o2 long, f binary, k1 long, k2 long, a long"
        two = stored(texts.join(runs, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInPandas(_digit_two(threshold, stretch, words), fields))
        # stretches that are equal as a whole (v tells all the rest) are one variant; a core with other variants goes through the third pass
        variants = stored(two.groupBy("v", "core", "q", "o1", "o2", "f").agg(F.count("*").alias("n")))
        several = stored(variants.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("core"))
        open_ = variants.join(several, "core")
        window = open_.select("v", "n", "core", F.explode(F.sequence("o1", "o2")).alias("o"), (F.col("o2") - F.col("q") * stretch).alias("left"), F.col("q").alias("q"), "f")
        before = F.expr(f"substring(f, CAST({u} * (left - (o - q * {stretch})) + 1 AS INT), CAST({u} * (o - q * {stretch}) AS INT))")
        after = F.expr(f"substring(f, CAST({u} * left + 1 AS INT), CAST({u} * ((q + 1) * {stretch} - 1 - o) AS INT))")
        window = stored(window.select("v", "n", "o", F.unhex(F.md5(F.concat("core", F.col("o").cast("string").cast("binary"), F.lit(b"|"), before, after))).alias("w")))
        again = stored(window.groupBy("w").agg(F.count("*").alias("m")).where("m > 1").select("w"))
        found = stored(window.where("n = 1").join(again, "w").groupBy("v").agg(F.collect_set("o").alias("os")))
        settled = variants.join(found, "v", "left").where("n > 1 or os is not null").select("v", F.when(F.col("n") == 1, F.col("os")).alias("os"))
        place = lambda o1, o2: F.struct((F.col("a") - o2).alias("start"), (F.col("a") - o1 + threshold).alias("end"))
        spans = F.when(F.col("os").isNull(), F.array(place(F.col("o1"), F.col("o2")))).otherwise(F.transform("os", lambda o: place(o, o)))
        hit = two.select("v", "k1", "k2", "a", "o1", "o2").join(stored(settled), "v").select("k1", "k2", spans.alias("spans"))
        by_text = hit.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        # a text that occurs twice is repeated from its first window to its last; an end beyond the text is cut to it
        whole = texts.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("long").alias("end")).where("copies > 1")
        whole = whole.select("k1", "k2", F.array(F.struct(F.lit(0).cast("long").alias("start"), "end")).alias("all"))
        both = by_text.join(whole, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("all", "spans").alias("spans"))
        return stored(both, outlives=True)


def with_spans(docs: DataFrame, threshold: int, keep: tuple[str, ...], words: bool = False, name: str = "spans") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``name``: what ``repeated_spans`` tells of each row's text."""
    keys = [f"{name}_1", f"{name}_2"]
    found = repeated_spans(docs, threshold, words).toDF(*keys, name)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[k.alias(n) for k, n in zip(_text_keys(), keys, strict=True)])
    # what is found is small beside the texts, which need no sort then
    return rows.join(found.hint("shuffle_hash"), keys, "left").drop(*keys)


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in spans:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without parts of UTF-8 characters at their ends."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _listed(spans, n: int, threshold: int) -> list[tuple[int, int]]:
    """Maximal runs of ``spans`` in a text of ``n`` tokens; a whole text that is shorter than a window is none."""
    return merged([(r["start"], min(r["end"], n)) for r in spans]) if spans is not None and n >= threshold else []


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, words: bool = False) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, ...) with every repeated passage cut from text, and n_removed (bytes).

    A passage is what windows of ``threshold`` bytes, or ``words``, cover that start anywhere else too, as judged on the
    input; all its occurrences go. Characters stay whole. Null text stays null; texts shorter than the threshold stay as
    they are. Every row is a text of its own, also where doc_id and text are those of another row: both are repeats then.
    Null doc_ids are as good as any. A column of ``docs`` named n_removed is replaced, all others are kept whatever their
    names. No rows give none."""
    docs, fields = extended(docs, n_removed="long")
    mark = "repeated_spans__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, removed = [], []
            for text, spans in zip(batch["text"], batch[mark], strict=True):
                raw, gone = (text or "").encode("utf-8", "replace"), []
                if spans is not None and words:
                    start, end = word_places(raw)
                    gone = [(int(start[s]), int(end[e - 1])) for s, e in _listed(spans, len(start), threshold)]
                elif spans is not None:
                    gone = whole_characters(raw, _listed(spans, len(raw), threshold))
                texts.append(cut(raw, gone).decode() if gone else text)
                removed.append(sum(e - s for s, e in gone))
            yield batch.drop(columns=mark).assign(text=texts, n_removed=removed)

    return with_spans(docs, threshold, tuple(docs.columns), words, mark).mapInPandas(run, fields)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at THRESHOLD bytes, and n_passage_words: the words covered by windows of WORDS words that
    start anywhere else too, which also tells passages of over 50 short words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans, passages in zip(batch["doc_id"], batch["text"], batch["spans"], batch["passages"], strict=True):
                raw = (text or "").encode("utf-8", "replace")
                gone = _listed(spans, len(raw), THRESHOLD)
                long = sum(e - s for s, e in _listed(passages, len(word_places(raw)[0]), WORDS)) if passages is not None else 0
                out.append((doc_id, len(raw), sum(e - s for s, e in gone), len(gone), hashlib.sha256(cut(raw, gone)).hexdigest(), long))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    passages = repeated_spans(docs, WORDS, words=True).withColumnRenamed("spans", "passages")
    found = repeated_spans(docs, THRESHOLD).join(passages, ["k1", "k2"], "full")
    rows = docs.select("doc_id", "text", *_text_keys()).join(found.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans", "passages")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")
