"""Quality classifier: a linear-chain conditional random field marks every line good or bad; marginals give the score."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import extended, table
from ledgerloom.llm.toxicity import fold, labelled

#: At most so many labelled documents teach the field, those of lowest hash, with no more than FIT_BYTES of text together;
#: documents of over TEXT_BYTES are scored like all others but teach nothing.
FIT_ROWS, FIT_BYTES, TEXT_BYTES = 6_000, 24 << 20, 1 << 15
STEPS, RATE, RIDGE = 80, 0.15, 1e-3
#: Step of the difference quotients.
_TILT = 1e-3
#: Upper edges of the buckets of shares, and of word counts and word lengths.
SHARES = np.array([0.0, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75])
COUNTS = np.array([0, 1, 3, 6, 12, 25, 60, 150])
LENGTHS = np.array([0, 2, 3, 4, 5, 6, 8, 12])
N_STATS, N_BUCKETS = 11, 10  # the last bucket: no such neighbour
_SYMBOLS, _TEXTS = b"#*$%&@^~=_+<>\\/{}[]", 1_000


def _classes() -> list[np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        out = np.zeros(256, np.int64)
        out[list(chars)] = 1
        return out

    upper, lower, digit = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
    punct = bytes(b for b in range(33, 127) if b not in upper + lower + digit)
    return [of(upper), of(upper + lower), of(digit), of(punct), of(b"!"), of(b"|"), of(_SYMBOLS)]


_CLASSES = _classes()


def line_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each line's own statistics, bytes of each line, lines of each text). Every text has a line."""
    lines, sizes, repeated = [], [], []
    for t in texts:
        own = (t or "").encode("utf-8", "replace").split(b"\n")
        times = Counter(own)
        lines += own
        sizes.append(len(own))
        repeated += [times[x] > 1 and len(x) > 0 for x in own]
    length = np.array([len(x) for x in lines], np.int64)
    flat = np.frombuffer(b"".join(lines), np.uint8)
    end = np.cumsum(length)
    counts = []
    for c in _CLASSES:
        upto = np.append(0, np.cumsum(c[flat]))
        counts.append(upto[end] - upto[end - length])
    upper, letters, digits, punct, bang, pipe, symbols = counts
    words, same, kinds = np.zeros((3, len(lines)))
    for i, x in enumerate(lines):
        w = x.split()
        words[i], same[i], kinds[i] = len(w), sum(map(operator.eq, w, w[1:])), len(set(w))
    share = lambda a, b: a / np.maximum(b, 1)
    stats = [(share(upper, letters), SHARES), (share(punct, length), SHARES), (share(symbols, length), SHARES), (share(pipe, words), SHARES), (share(bang, words), SHARES), (share(digits, length), SHARES), (share(same, words), SHARES), (share(kinds, words), SHARES), (words, COUNTS), (share(length, words), LENGTHS), (np.array(repeated, float), SHARES)]
    return np.stack([np.searchsorted(edges, v, side="left") for v, edges in stats], axis=1), length, np.array(sizes, np.int64)


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of a line's features: its own buckets and those of the lines before and after it."""
    first = np.cumsum(sizes) - sizes
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = N_BUCKETS - 1
    after[first + sizes - 1] = N_BUCKETS - 1
    offset = np.arange(3 * N_STATS) * N_BUCKETS
    return np.concatenate([own, before, after], axis=1) + offset


def marginals(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, and of all lines but the first of each text the pairwise probabilities, with their rows.

    ``emit``: score of good against bad, line by line. Forward and backward run over all texts at once, step by step, as odds
    of good against bad: what a line passes on is (a + b odds) / (c + d odds)."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    n = len(emit)
    e = np.exp(np.clip(emit, -30, 30))
    t = np.exp(np.clip(trans, -30, 30))
    fwd, bwd = np.zeros(n), np.ones(n)
    active = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left").tolist()  # texts with more than so many lines
    for k, many in enumerate(active):
        at = first[:many] + k
        if k == 0:
            fwd[at] = e[at] * np.exp(np.clip(start[1] - start[0], -30, 30))
        else:
            r = fwd[at - 1]
            fwd[at] = e[at] * ((t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r))
    for k in range(len(active) - 1, 0, -1):
        at = first[: active[k]] + k
        r = e[at] * bwd[at]
        bwd[at - 1] = (t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r)
    odds = fwd * bwd
    p = odds / (1 + odds)
    if not pairs:
        return p, np.zeros((0, 2, 2)), np.zeros(0, np.int64)
    later = np.ones(n, bool)
    later[np.cumsum(sizes) - sizes] = False
    rows = np.flatnonzero(later)
    before, after = fwd[rows - 1], e[rows] * bwd[rows]
    one = np.ones(len(rows))
    pair = np.stack([one, after, before, before * after], axis=1).reshape(-1, 2, 2) * t[None]
    return p, pair / pair.sum(axis=(1, 2), keepdims=True), rows


def fit_field(own: np.ndarray, sizes: np.ndarray, length: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, transitions, start) by gradient descent with momentum on the cross-entropy of the texts' labels under the texts'
    scores, the means of P(good) over their lines by length.

    The labels of lines are latent: a bad text may hold good lines. How a text's score moves with a line's emission or
    a transition is the covariance of that with the length-weighted labels, which is the change of the marginals when the
    emissions are tilted by the lengths."""
    feats = with_neighbours(own, sizes)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = (length + 1) / np.bincount(owner, weights=length + 1)[owner]
    tilt = _TILT * share * sizes[owner]
    params = np.zeros(3 * N_STATS * N_BUCKETS + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    w_n = len(params) - 6
    for step in range(1, STEPS + 1):
        w, trans, start = params[:w_n], params[w_n : w_n + 4].reshape(2, 2), params[w_n + 4 :]
        emit = w[feats].sum(axis=1)
        p, pair, rows = marginals(emit + tilt, sizes, trans, start)
        q, pair2, _ = marginals(emit - tilt, sizes, trans, start)
        score = np.clip(np.bincount(owner, weights=share * (p + q) / 2), 1e-6, 1 - 1e-6)
        slope = (score - good) / (score * (1 - score)) / (2 * _TILT * sizes)  # of the loss, for a unit of tilt
        moved = (p - q) * slope[owner]
        grad = np.zeros_like(params)
        grad[:w_n] = np.bincount(feats.ravel(), weights=np.repeat(moved, feats.shape[1]), minlength=w_n)
        grad[w_n : w_n + 4] = ((pair - pair2) * slope[owner[rows]][:, None, None]).sum(axis=0).ravel()
        grad[w_n + 4 :] = [-moved[first].sum(), moved[first].sum()]
        grad = grad / len(sizes) + RIDGE * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params[:w_n], params[w_n : w_n + 4].reshape(2, 2), params[w_n + 4 :]


def line_marginals(texts: list[str | None], field: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, its bytes, lines of each text)."""
    own, length, sizes = line_buckets(texts)
    p, _, _ = marginals(field[0][with_neighbours(own, sizes)].sum(axis=1), sizes, field[1], field[2], pairs=False)
    return p, length, sizes


def quality_of(texts: list[str | None], field: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    p, length, sizes = line_marginals(texts, field)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(owner, weights=p * (length + 1)) / np.bincount(owner, weights=length + 1)


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, ...) and quality_score (0 to 1; 0.5 and more: good) for every row.

    ``labels`` (doc_id, quality): the labelled documents that may teach, of which ``fit_rows`` are taken (bounds in bytes:
    FIT_BYTES, TEXT_BYTES). Null and empty texts are one empty line. Without labels of both kinds all scores are 0.5. Repeated
    rows are kept; rows are scored one by one, in whole, without a shuffle. A column named quality_score is replaced."""
    sample = labelled(docs, labels, "quality", fit_rows, 0, FIT_BYTES, TEXT_BYTES).select("text", "y")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                part = batch.iloc[at : at + _TEXTS]
                own, length, sizes = line_buckets(part["text"].tolist())
                cut = np.cumsum(sizes)[:-1]
                rows = [[x.tobytes() for x in np.split(v, cut)] for v in (own.astype(np.uint8), length)]
                yield pd.DataFrame({"y": part["y"].to_numpy(), "lines": rows[0], "sizes": rows[1]})

    seen = sample.mapInPandas(measure, "y long, lines binary, sizes binary").toPandas().sort_values(["y", "lines", "sizes"], ignore_index=True)
    field = (np.zeros(3 * N_STATS * N_BUCKETS), np.zeros((2, 2)), np.zeros(2))
    if seen["y"].nunique() == 2:
        own = np.frombuffer(b"".join(seen["lines"]), np.uint8).reshape(-1, N_STATS).astype(np.int64)
        length = np.frombuffer(b"".join(seen["sizes"]), np.int64)
        field = fit_field(own, seen["lines"].map(len).to_numpy() // N_STATS, length, seen["y"].to_numpy().astype(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    docs, fields = extended(docs, quality_score="double")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                part = batch.iloc[at : at + _TEXTS]
                yield part.assign(quality_score=quality_of(part["text"].tolist(), shared.value))

    return docs.mapInPandas(score, fields)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    teach = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold(3) != 1)
    score = F.col("quality_score")
    scored = score_quality(docs, teach)
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
