import math
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality as q
from ledgerloom.llm import toxicity as tx

D = "/root/testdata/sf0.1"


def held_accuracy(spark, rows, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    scored = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    area = np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos])
    return area, np.mean([(s >= 0.5) == y for s, y in scored])


def test_toxicity_held_out(spark):
    rows = tx.op2_toxicity(spark, D).collect()
    assert len(rows) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    area, right = held_accuracy(spark, rows, "toxic")
    # two fifths of the toxic labels here are on documents that hold nothing toxic
    assert area > 0.7 and right > 0.94
    words = {"pathetic", "loser", "idiot", "scum", "moron", "worthless", "clown", "disgusting", "trash", "stupid"}
    abuse = {r.doc_id: len(words & set(re.findall(r"\w+", r.text.lower()))) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert np.mean([r.predicted for r in rows if abuse[r.doc_id] > 1]) > 0.98
    assert np.mean([r.predicted for r in rows if abuse[r.doc_id] == 0]) < 0.03


def test_quality_held_out(spark):
    rows = q.op10_quality(spark, D).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    area, right = held_accuracy(spark, rows, "quality")
    assert area > 0.97 and right > 0.97


def test_shares_sum_to_one():
    words = ["the", "then", "idiot", "idiom", "thee"]
    grams, owner = tx.grams_of(words)
    key, a, b = tx._sums(grams, np.ones(len(grams)), (owner == 2).astype(float))
    model = tx.KneserNey(key, np.stack([a, b], 1))
    ctx = int.from_bytes(b"\x01\x01\x01th", "big") << 8
    assert math.isclose(model.shared(np.arange(256, dtype=np.uint64) + np.uint64(ctx)).sum(), 1, abs_tol=1e-9)
    assert model.ratios(["idiot"])[0] > model.ratios(["the"])[0]


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(1)
    sizes, trans, start = np.array([3, 1, 5]), rnd.standard_normal((2, 2)), rnd.standard_normal(2)
    emit = rnd.standard_normal(9)
    p, pair, rows = q.marginals(emit, sizes, trans, start)
    at = 0
    for n in sizes:
        total, good, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(start[y[0]] + sum(emit[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            good += w * np.array(y)
            for i in range(1, n):
                both[i, y[i - 1], y[i]] += w
        assert np.allclose(p[at : at + n], good / total)
        for i in range(1, n):
            assert np.allclose(pair[list(rows).index(at + i)], both[i] / total)
        at += n


@pytest.mark.parametrize("score,name,untaught", [(tx.score_toxicity, "tox_score", 0.0), (q.score_quality, "quality_score", 0.5)])
def test_edges(spark, score, name, untaught):
    label = "toxic" if name == "tox_score" else "quality"
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x " * 50_000, 0.5)], f"doc_id long, text string, {name.upper()} double")
    got = score(docs, spark.createDataFrame([], f"doc_id long, {label} int")).collect()
    assert len(got) == 4 and len(got[0]) == 3 and all(math.isclose(r[name], untaught, abs_tol=1e-9) for r in got)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1)], f"doc_id long, {label} int")
    assert all(0 <= r[name] <= 1 for r in score(docs, labels).collect())
    assert score(docs.limit(0), labels).collect() == []


def test_a_toxic_word_seen_once_counts(spark):
    plain = "the quick brown fox jumps over the lazy dog while the old man reads the news of the day".split()
    rows = [(" ".join(plain[i % 9 :] + plain[: i % 5]), 0, "fit") for i in range(40)] + [(" ".join(plain[i % 7 :]) + " idiot", 1, "fit") for i in range(10)]
    rows.append((f"{rows[0][0]} zyxgrokq", 1, "fit"))
    model, _ = tx.train(spark.createDataFrame(rows, "text string, y long, part string"))
    assert np.isin(tx.grams_of(["zyxgrokq"])[0], model.grams).all()
    assert model.ratios(["zyxgrokq"])[0] > 0.7 > model.ratios(["dog"])[0]


def slow_score(texts, field):
    """Document scores by summing over all labellings of the lines."""
    own, length, sizes = q.line_buckets(texts)
    emit = field[0][q.with_neighbours(own, sizes)].sum(axis=1)
    at, out = 0, []
    for n in sizes.tolist():
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(field[2][y[0]] + sum(emit[at + i] * y[i] for i in range(n)) + sum(field[1][y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + w, good + w * np.array(y)
        size = length[at : at + n] + 1
        out.append((good / total * size).sum() / size.sum())
        at += n
    return np.array(out)


def test_quality_of_documents_by_enumeration():
    rnd = np.random.default_rng(3)
    field = (rnd.standard_normal(3 * q.N_STATS * q.N_BUCKETS) / 6, rnd.standard_normal((2, 2)), rnd.standard_normal(2))
    texts = ["One good line.\nAnother | one | here\n\n###", None, "", "a\nb", "x $$$ y\n" * 7]
    assert np.allclose(q.quality_of(texts, field), slow_score(texts, field))


def test_fit_descends_the_loss_of_document_labels(monkeypatch):
    """The first step follows the slope of the cross-entropy, taken here by enumeration."""
    texts, good = ["One fine line here.\nAnd | this | one\nok then", "$$$ ###\n| a | b", "Plain words in a row."], np.array([1, 0, 1])
    own, length, sizes = q.line_buckets(texts)
    monkeypatch.setattr(q, "STEPS", 1)
    w, trans, start = q.fit_field(own, sizes, length, good)

    def loss(field):
        s = slow_score(texts, field)
        return -np.mean(good * np.log(s) + (1 - good) * np.log(1 - s))

    zero = np.zeros(3 * q.N_STATS * q.N_BUCKETS), np.zeros((2, 2)), np.zeros(2)
    for got, k in ((w, 0), (trans.ravel(), 1), (start, 2)):
        for i in range(len(got)):
            up, down = [z.copy() for z in zero], [z.copy() for z in zero]
            up[k].reshape(-1)[i] += 1e-4
            down[k].reshape(-1)[i] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4
            assert np.sign(got[i]) == -np.sign(round(slope, 7)) or abs(slope) < 1e-6


def test_lines_of_a_text_differ():
    rnd = np.random.default_rng(4)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 9)))
    prose = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    junk = lambda: " | ".join("$" * rnd.integers(1, 5) + word() for _ in range(9))
    texts = ["\n".join((prose if i % 2 else junk)() for _ in range(5)) for i in range(60)]
    own, length, sizes = q.line_buckets(texts)
    field = q.fit_field(own, sizes, length, np.arange(60) % 2)
    p, _, _ = q.line_marginals(["\n".join([prose() for _ in range(4)] + [junk() for _ in range(4)])], field)
    assert p[:3].min() > 0.7 and p[-3:].max() < 0.3
    assert 0.2 < q.quality_of(["\n".join([prose() for _ in range(4)] + [junk() for _ in range(4)])], field)[0] < 0.8


def slow_ratio(word, teach):
    """log P(word | toxic) - log P(word | ordinary) by plain dictionaries: counts of a class in the longest order, Kneser-Ney
    continuation counts over both below; by the root of the length."""
    pad, order = b"\x01" * (tx.ORDER - 1), tx.ORDER
    grams = lambda w: [(pad + w + b"\x02")[i : i + order] for i in range(len(w) + 1)]
    top = [{}, {}]
    for w, y, n in teach:
        for g in grams(w.encode()):
            top[y][g] = top[y].get(g, 0) + n
    levels = [{g[-n:] for g in {*top[0], *top[1]}} for n in range(order, 0, -1)]  # distinct grams of each length

    def shared(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        counts = {}
        for longer in levels[order - n - 1]:
            counts[longer[1:]] = counts.get(longer[1:], 0) + 1
        same = {k: c for k, c in counts.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return shared(g[1:])
        return max(counts.get(g, 0) - tx.DISCOUNT, 0) / total + tx.DISCOUNT * len(same) / total * shared(g[1:])

    def of(g, y):
        same = {k: c for k, c in top[y].items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        lower = shared(g[1:])
        return (max(top[y].get(g, 0) - tx.DISCOUNT, 0) + tx.DISCOUNT * len(same) * lower) / total if total else lower

    w = word.encode()
    return sum(math.log(of(g, 1)) - math.log(of(g, 0)) for g in grams(w)) / math.sqrt(len(w) + 1)


def test_ratios_by_plain_dictionaries():
    teach = [("the", 0, 5), ("then", 0, 2), ("idiom", 0, 1), ("thee", 0, 1), ("idiot", 1, 3), ("the", 1, 2), ("übel", 1, 1)]
    grams, owner = tx.grams_of([w for w, _, _ in teach])
    n, y = np.array([n for _, _, n in teach])[owner], np.array([y for _, y, _ in teach])[owner]
    key, a, b = tx._sums(grams, n * (1 - y), n * y)
    model = tx.KneserNey(key, np.stack([a, b], 1))
    words = ["the", "idiot", "idio", "x", "übel", "thidiot", "a_very_long_word"]
    assert np.allclose(model.ratios(words), [slow_ratio(w, teach) for w in words])


def test_samples_are_bounded(spark):
    """Rows and bytes; several rows of an id count once."""
    docs = spark.createDataFrame([(i % 20, "x" * (10 + i % 20)) for i in range(400)] + [(50, "y" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(20), 50]], "doc_id long, toxic int")
    got = tx.labelled(docs, labels, "toxic", 12, 6).collect()
    assert len(got) == 18 and {r.part for r in got} == {"fit", "calibrate"}
    got = tx.labelled(docs, labels, "toxic", 30, 6, fit_bytes=100, text_bytes=1000).collect()
    assert 1 < len(got) < 10 and sum(len(r.text) for r in got) <= 100


def test_a_very_long_word_in_the_sample_costs_its_own_length(spark):
    words = [" ".join(f"w{(i * 7 + k) % 997}" for k in range(200)) for i in range(200)]
    rows = [(("scum " if i % 2 else "") + t, i % 2, "fit") for i, t in enumerate(words)] + [("x" * 60_000, 0, "fit")]
    # in one batch and by fixed width these 40,000 words would take 240 kB each
    model, _ = tx.train(spark.createDataFrame(rows, "text string, y long, part string").coalesce(1))
    assert model.ratios(["scum"])[0] > model.ratios(["w1"])[0]
