"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihoods."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Remembered, extended, passing, stored, table

#: A word is read byte by byte, each byte after the ORDER - 1 before it; START pads its front, END closes it.
ORDER, START, END = 6, 1, 2
DISCOUNT = 0.75
#: At most so many labelled documents teach the models, and so many more the calibration: those of lowest hash, as long as
#: their texts have no more than FIT_BYTES together; documents of over TEXT_BYTES are scored like all others but teach nothing.
FIT_ROWS, CALIBRATE_ROWS = 12_000, 6_000
FIT_BYTES, TEXT_BYTES = 96 << 20, 1 << 16
#: Words of a document whose ratios are averaged apart, and the ratio from which a word counts as an expression.
TOP, STRONG = 3, 3.0
_WORD = re.compile(r"\w+")
_REMEMBERED, _AT_ONCE, _TEXTS = 200_000, 100_000, 1_000


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word index): each byte of each word, and its end, with the ORDER - 1 bytes before, packed in 48 bits."""
    coded = [w.encode("utf-8", "replace") for w in words]
    pad = bytes([START]) * (ORDER - 1)
    flat = np.frombuffer(b"".join([pad + w + bytes([END]) for w in coded]), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in coded], np.int64)
    owner = np.repeat(np.arange(len(coded)), sizes)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(owner)) + (owner + 1) * (ORDER - 1)
    grams = np.zeros(len(owner), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        grams = (grams << np.uint64(8)) | flat[at - back]
    assert len(first) == len(coded)
    return grams, owner


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (key[first], *[np.add.reduceat(v[order], first) if len(key) else v for v in values])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class KneserNey:
    """Two interpolated models that share all lower orders.

    The highest order holds each class's own counts. Below, the counts are Kneser-Ney continuation counts (in how many
    different longer contexts a byte follows) over both classes together, so that an expression that is rare in
    a class is smoothed alike in both."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, counts = grams[order], counts[order].astype(np.float64)
        ctx = self.grams >> np.uint64(8)
        self.ctx, *totals = _sums(ctx, counts[:, 0], counts[:, 1])
        kinds = _sums(ctx, (counts[:, 0] > 0).astype(float), (counts[:, 1] > 0).astype(float))[1:]
        self.own = np.maximum(counts - DISCOUNT, 0)
        self.total, self.kinds = np.stack(totals, 1), np.stack(kinds, 1)
        self.lower = []  # of each lower order, from long to short: grams, share, contexts, backoff weight
        keys = self.grams
        for n in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << (8 * n)) - 1)
            keys, c = _sums(keys & mask, np.ones(len(keys)))
            ctx, total, kind = _sums(keys >> np.uint64(8), c, np.ones(len(keys)))
            at, _ = _find(ctx, keys >> np.uint64(8))
            self.lower.append((mask, keys, np.maximum(c - DISCOUNT, 0) / total[at], ctx, DISCOUNT * kind / total))

    def shared(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), 1 / 256)
        for mask, keys, share, ctx, weight in reversed(self.lower):
            g = grams & mask
            at, seen = _find(ctx, g >> np.uint64(8))
            at2, hit = _find(keys, g)
            p = np.where(seen, np.where(hit, share[at2] if len(keys) else 0, 0) + (weight[at] if len(ctx) else 1) * p, p)
        return p

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary), by the square root of its length in bytes."""
        if not words:
            return np.zeros(0)
        grams, owner = grams_of(words)
        distinct, back = np.unique(grams, return_inverse=True)
        p = self.shared(distinct)
        at, seen = _find(self.ctx, distinct >> np.uint64(8))
        at2, hit = _find(self.grams, distinct)
        made = np.zeros((len(distinct), 2))
        for k in (0, 1):
            known = seen & (self.total[at, k] > 0) if len(self.ctx) else seen
            own = np.where(hit, self.own[at2, k], 0) if len(self.grams) else np.zeros(len(distinct))
            total = np.where(known, self.total[at, k] if len(self.ctx) else 1, 1)
            made[:, k] = np.where(known, (own + DISCOUNT * (self.kinds[at, k] if len(self.ctx) else 0) * p) / total, p)
        step = np.log(made[:, 1]) - np.log(made[:, 0])
        size = np.bincount(owner, minlength=len(words))
        return np.bincount(owner, weights=step[back], minlength=len(words)) / np.sqrt(size)


def ratios_of(model: KneserNey) -> Remembered:
    """The ratios of words, kept between calls up to a fixed number."""

    def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ratios = [model.ratios(words[at : at + _AT_ONCE]) for at in range(0, len(words), _AT_ONCE)]
        return np.concatenate([np.zeros(0), *ratios]), np.ones(len(words), np.int64)

    return Remembered(learn, _REMEMBERED)


def features(texts: list[str | None], known: Remembered) -> np.ndarray:
    """Six numbers a text, from the ratios of its words (``ratios_of``)."""
    found = [_WORD.findall((t or "").lower()) for t in texts]
    ends = np.cumsum([0, *map(len, found)]).tolist()
    ratios, _ = known.of(list(chain.from_iterable(found)))
    out = np.zeros((len(texts), 6))
    for i, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        r = ratios[start:end] if start < end else np.zeros(1)
        top = np.partition(r, len(r) - TOP)[len(r) - TOP :] if len(r) > TOP else r
        strong = int((r > STRONG).sum())
        out[i] = 1, r.mean(), np.maximum(top, 0).sum() / TOP, np.log1p(strong), strong / len(r) * 10, np.log1p(len(r))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's method with halved steps."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge * w @ w / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fold(n: int) -> Column:
    """crc32 of the id as text, by ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int, calibrate_rows: int, fit_bytes: int = FIT_BYTES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """text, y, part ('fit' or 'calibrate') of a bounded sample of labelled rows: those of lowest hash of doc_id.

    Bounds: rows, bytes of a text and bytes of all texts. Of several rows of a doc_id one counts: the least text."""
    with passing(docs.sparkSession):
        want = labels.where(f"{label} in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(label).alias("y"))
        want = want.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(fit_rows + calibrate_rows)
        part = F.when(F.pmod(F.xxhash64(F.col("h")), F.lit(fit_rows + calibrate_rows)) < fit_rows, "fit").otherwise("calibrate")
        want = stored(want.withColumn("part", part))
        texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= text_bytes)
        found = stored(texts.join(want, "doc_id").groupBy("doc_id", "y", "part", "h").agg(F.min("text").alias("text")))
        # at most fit_rows + calibrate_rows rows, without their texts
        before = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        fits = found.select("doc_id", "h", F.octet_length("text").cast("long").alias("size")).withColumn("upto", F.sum("size").over(before)).where(F.col("upto") <= fit_bytes)
        return stored(found.join(fits.select("doc_id"), "doc_id", "left_semi").select("text", "y", "part"), outlives=True)


def train(sample: DataFrame) -> tuple[KneserNey, np.ndarray]:
    """The models from the sample's 'fit' rows and the calibration from the others.

    The sample is bounded by parameters of ``labelled``, and so are what is gathered here: distinct grams of six bytes
    with two counts each, and six numbers a document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y in (0, 1):
                words: Counter[str] = Counter()
                for t in batch.loc[batch["y"] == y, "text"]:  # text by text: a batch holds many times its distinct words
                    words.update(_WORD.findall((t or "").lower()))
                if words:
                    grams, owner = grams_of(list(words))
                    g, c = _sums(grams, np.fromiter(words.values(), np.int64, len(words))[owner])
                    yield pd.DataFrame({"g": g.astype(np.int64), "c0": c * (1 - y), "c1": c * y})

    counted = sample.where("part = 'fit'").select("text", "y").mapInPandas(count, "g long, c0 long, c1 long")
    found = counted.groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()
    model = KneserNey(found["g"].to_numpy().astype(np.uint64), found[["c0", "c1"]].to_numpy().reshape(-1, 2))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ratios_of(shared.value)
        for batch in batches:
            yield pd.DataFrame({"x": list(features(batch["text"].tolist(), known)), "y": batch["y"].to_numpy()})

    got = sample.where("part = 'calibrate'").select("text", "y").mapInPandas(measure, "x array<double>, y long").toPandas()
    if not len(got) or got["y"].nunique() < 2:
        return model, np.array([-30.0, 0, 0, 0, 0, 0])  # nothing tells toxic from ordinary
    return model, logistic(np.stack(got["x"].to_numpy()), got["y"].to_numpy().astype(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, ...) and tox_score (0 to 1; 0.5 and more: toxic) for every row.

    ``labels`` (doc_id, toxic): the labelled documents that may teach; the sample is bounded by ``fit_rows`` and
    ``calibrate_rows``, and in bytes (``labelled``). Null and empty texts get the calibration's own prior. Without labels
    of both kinds all scores are 0, so that nothing is rejected unseen. Repeated rows are kept; rows are scored one by
    one, in whole, without a shuffle. A column of ``docs`` named tox_score is replaced."""
    model, weights = train(labelled(docs, labels, "toxic", fit_rows, calibrate_rows))
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))
    docs, fields = extended(docs, tox_score="double")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weights = shared.value
        known = ratios_of(model)
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                part = batch.iloc[at : at + _TEXTS]
                z = features(part["text"].tolist(), known) @ weights
                yield part.assign(tox_score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.mapInPandas(score, fields)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    teach = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(5) != 0)
    scored = score_toxicity(docs, teach)
    score = F.col("tox_score")
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
