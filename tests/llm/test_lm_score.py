import math
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import lm_score


def test_log_kt():
    a = np.array([0.0, 1, 2, 5, 3000])
    b = np.array([0.0, 0, 3, 9, 10])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    assert np.allclose(lm_score.log_kt(a, b), want, atol=1e-9)


def tree_of(texts):
    key, _ = lm_score.packed([lm_score.stream_of(lm_score.words_of(t)) for t in texts])
    return lm_score.ContextTree(*np.unique(key, return_counts=True))


def test_probabilities_sum_to_one():
    tree = tree_of(["the cat sat on the mat", "the dog sat on the log", "a cat and a dog"] * 5)
    for before in (b"the c", b"\n\n\n\n\n", b"zzzzz", b"zzthe", b" on t"):
        base = int.from_bytes(before, "big") << 8
        p = 10 ** tree.log10_p(np.array([base + x for x in range(256)], np.uint64))
        assert math.isclose(p.sum(), 1, abs_tol=1e-5)


def naive(counts, depth, ctx, byte):
    """The same mixture by plain recursion over dictionaries of (context, bits) nodes."""

    def node(c, bits):
        a = sum(n for (k, x), n in counts.items() if k.endswith(c) and format(x, "08b").startswith(bits + "0"))
        return a, sum(n for (k, x), n in counts.items() if k.endswith(c) and format(x, "08b").startswith(bits + "1"))

    def log_p(c, bits):
        a, b = node(c, bits)
        own = float(lm_score.log_kt(np.array([float(a)]), np.array([float(b)]))[0])
        longer = {k[-len(c) - 1 :] for (k, x) in counts if k.endswith(c) and format(x, "08b").startswith(bits)} if len(c) < depth else set()
        return np.logaddexp(own, sum(log_p(k, bits) for k in sorted(longer))) - math.log(2) if longer else own

    total = 0.0
    for i in range(8):
        bits, one = format(byte, "08b")[:i], format(byte, "08b")[i] == "1"
        p, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            c = ctx[-d:] if d else b""
            a, b = node(c, bits)
            if a + b == 0:
                break
            kt = ((b if one else a) + 0.5) / (a + b + 1)
            own = float(lm_score.log_kt(np.array([float(a)]), np.array([float(b)]))[0])
            w = math.exp(own - math.log(2) - log_p(c, bits)) if d < depth else 1.0
            p, left, last = p + left * w * kt, left * (1 - w), kt
        total += math.log10(p + left * last)
    return total


def test_same_as_recursion():
    texts = ["abra cadabra", "abba baab", "cab"]
    tree = tree_of(texts)
    counts = Counter()
    for t in texts:
        for g in lm_score.packed([lm_score.stream_of(lm_score.words_of(t))])[0]:
            counts[int(g).to_bytes(lm_score.DEPTH + 1, "big")[:-1], int(g) & 255] += 1
    for ctx, byte in [(b"\x00\x00\x00\n\nabr", ord("a")), (b"\x00\x00\nabba", ord(" ")), (b"qqqqqab", ord("r")), (b"\0\0\0\n\n\n\n", ord("c")), (b"cadabr", ord("z"))]:
        ctx = ctx[-lm_score.DEPTH :].rjust(lm_score.DEPTH, b"\0")
        got = tree.log10_p(np.array([(int.from_bytes(ctx, "big") << 8) + byte], np.uint64))[0]
        assert math.isclose(got, naive(counts, lm_score.DEPTH, ctx, byte), abs_tol=1e-5)


@pytest.mark.parametrize("max_words, max_grams", [(1 << 18, 1 << 20), (5, 7)])
def test_scores_base_and_counts(spark, monkeypatch, max_words, max_grams):
    """Whatever is looked up in memory, by joins, in many subtrees: the same as one tree of all texts that teach."""
    monkeypatch.setattr(lm_score, "MAX_WORDS", max_words)
    monkeypatch.setattr(lm_score, "MAX_GRAMS", max_grams)
    train = ["The cat  sat on the mat", "the dog", None, "cat\tcat"]
    docs = [(1, "THE cat flew", None), (2, None, False), (2, None, False), (3, "Ünseen mat mat thematic", False), (None, "x", False)] + [(9, t, True) for t in train]
    got = lm_score.score_language(spark.createDataFrame([(i, t, k, 9) for i, t, k in docs], "doc_id long, text string, learn boolean, n int")).collect()
    counts = Counter(w for t in train for w in [*lm_score.words_of(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    by, tree = {r.doc_id: r for r in got}, tree_of(train)
    for i, t, _ in docs[:5]:
        w = [*lm_score.words_of(t), b"\n"]
        assert by[i].n_tokens == len(w) and by[i].n_known == sum(counts[x] > 0 for x in w) and by[i].train_tokens == n
        assert math.isclose(by[i].base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-9)
        grams = lm_score.packed([lm_score.stream_of(w[:-1])])[0]
        assert math.isclose(by[i].score, tree.log10_p(grams).sum(), abs_tol=1e-9)
        assert by[i].n_bytes == len(grams) and math.isclose(by[i].bits_per_byte, -by[i].score * math.log2(10) / len(grams), abs_tol=1e-9)


def test_no_rows_that_teach(spark):
    got = lm_score.score_language(spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, learn boolean")).collect()
    assert got[0].n_known == 0 and got[0].train_tokens == 0 and math.isclose(got[0].score, -5 * 8 * math.log10(2), abs_tol=1e-3)
    assert lm_score.score_language(spark.createDataFrame([], "doc_id long, text string, learn boolean")).count() == 0
