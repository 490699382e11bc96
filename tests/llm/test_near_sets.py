import random

import numpy as np
import pandas as pd

import corpus_pipeline as cp
from ledgerloom.llm import near_sets

D = "/root/testdata/sf0.01"


def sets_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Smallest doc_id over pairs with five-word Jaccard >= 0.8, all pairs compared."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 5 * len(s & t) >= 4 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def test_stage_is_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert {r.doc_id for r in cp.simhash(spark, docs, D).collect()} == {i for i, c in want.items() if i == c}
    assert {r.doc_id: r.component_id for r in near_sets.similar_groups(docs).collect()} == want


def test_edits_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "BLOCK", 8)
    rnd = random.Random(5)
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, "one two three four five")]
    base = [f"b{j}" for j in range(120)]
    for i in range(5, 120):
        words = list(base) if i % 3 else [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(1, 90))]
        if i % 7 == 0:
            words = rnd.choice(rows[5:] or [(0, "x")])[1].split()
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(50)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_sets.similar_groups(df).collect()} == brute(rows)
    assert near_sets.similar_groups(df.limit(0)).collect() == []


def test_sketches_never_rule_out_similar_sets():
    """The bits in which two sketches differ are no more than the shingles that only one set has."""
    rnd = np.random.default_rng(3)
    for size in (1, 30, 400, 5000):
        whole = rnd.integers(0, 2**63, size, dtype=np.uint64)
        for share in (0.0, 0.02, 0.1, 0.5):
            other = np.unique(np.concatenate([whole[rnd.random(size) >= share], rnd.integers(0, 2**63, int(size * share) + 1, dtype=np.uint64)]))
            one = np.unique(whole)
            bits = int(np.bitwise_count((near_sets._sketch(one) ^ near_sets._sketch(other)).view(np.uint64)).sum())
            only = len(np.setxor1d(one, other))
            assert bits <= only
            if len(np.intersect1d(one, other)) * 5 >= len(np.union1d(one, other)) * 4:
                assert near_sets._within_reach(bits, len(one) + len(other))


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Documents that share two thirds of their words, under the threshold, reach no text comparison."""
    rnd = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(i, passage + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = near_sets._similar
    monkeypatch.setattr(near_sets, "_similar", lambda pairs, texts: (seen.append(pairs.count()), plain(pairs, texts))[1])
    assert {r.doc_id: r.component_id for r in near_sets.similar_groups(df).collect()} == {i: i for i, _ in rows}
    assert sum(seen) == 0


def test_simhash_finds_the_pairs_within_its_bits(spark, monkeypatch):
    """Pairs within four bits come from SimHash and from nothing beside it; also those that its component's first text is not like."""
    rnd = random.Random(6)
    base = [f"b{j}" for j in range(400)]
    rows = [(i, " ".join(base[:200] + ([f"e{i}"] if i else []) + base[200:])) for i in range(6)]
    loud = "one line that all of them repeat so often that it drowns the rest " * 300
    tails = [[f"t{rnd.randrange(10**6)}" for _ in range(80)] for _ in range(4)]
    rows += [(10 + i, loud + " ".join([*tails[i % 4], f"x{i}"])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda: {r.doc_id: r.component_id for r in near_sets.similar_groups(df).collect()}
    assert got() == brute(rows) == {i: 0 if i < 6 else 10 + (i - 10) % 4 for i, _ in rows}
    monkeypatch.setattr(near_sets, "linked", lambda classes: classes.select("fp", classes["id"].alias("component_id")))
    assert {i: c for i, c in got().items() if i < 6} == {i: i for i in range(6)}


def test_codes_tell_shingles_apart_as_the_words_do():
    """Equal runs of words have equal codes, whatever the white space and case around them; others have others (F1: shingles one by one)."""
    rnd = random.Random(4)
    words = ["a", "b", "ab", "ba", "Ünd", "x" * 63, "x" * 64, "y" * 5000, "x" * 64 + "y"]
    texts = ["", "  ", "a", "a b", "A  b\n", " b a", "a b ab ba", "a b ab ba a", "x" * 64, "x" * 65] + [rnd.choice([" ", "\n ", "\t"]).join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    code_of = {}
    for t in texts:
        w = t.encode().translate(near_sets.LOWER).split()
        runs = [b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        codes = near_sets.shingle_codes(t).tolist()
        assert len(codes) == len(runs)
        assert all(code_of.setdefault(r, c) == c for r, c in zip(runs, codes, strict=True))
    assert len(set(code_of.values())) == len(code_of)


def test_pairs_that_codes_rule_out_are_not_read_as_shingles(spark, monkeypatch):
    """Sets of shingles are made only for pairs that are similar by their codes; right before and after (F1)."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(base[:-10]), " ".join(base[:100] + [f"v{i}" for i in range(100)])]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    runs = {}

    class Pairs:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInPandas(self, run, schema):
            runs["run"] = run
            return self

    near_sets._similar(Pairs(), frame)
    read = []
    plain = near_sets.shingles
    monkeypatch.setattr(near_sets, "shingles", lambda t: (read.append(t), plain(t))[1])
    rows = [(a, b, texts[a], texts[b]) for a, b in ((0, 1), (0, 2), (1, 2))]
    got = next(runs["run"](iter([pd.DataFrame(rows, columns=["a", "b", "x", "y"])])))
    assert got.to_numpy().tolist() == [[0, 1]] and len(read) == 2
    assert [tuple(r) for r in near_sets._similar(pairs, frame).collect()] == [(0, 1)]
