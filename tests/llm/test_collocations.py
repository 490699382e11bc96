import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from ledgerloom.llm import collocations
from ledgerloom.llm.collocations import Words, count_prefixes

SCHEMA = "text string, lang string, Phrase string, rank int"


def plain(rows, max_n=4, least=30, subsumed=80, top=2000):
    """Everything by whole dictionaries."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            lang = lang or "und" if lang is None else lang
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    often = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    made = {}
    for (g, p), a in often.items():
        score, k = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
        made[g, p] = (score, a, f[g, p[:k]], f[g, p[k:]])
    for (g, p), n in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if n * 100 >= often[g, p[i : i + m]] * subsumed:
                    made.pop((g, p[i : i + m]), None)
    out = []
    for g in {g for g, _ in made}:
        mine = sorted(((-s, -a, " ".join(p).encode(), l, r) for (h, p), (s, a, l, r) in made.items() if h == g))[:top]
        out += [(g, i + 1, x[2].decode(), -x[1], x[3], x[4], total[g], -x[0]) for i, x in enumerate(mine)]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(seed, n=400):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "ab", "é", "É", "x\x01", "x", "\x1f", "|", "中文", "a b"]
    parts = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?"]
    fixed = "new york city council"
    out = []
    for _ in range(n):
        t = "".join(rnd.choice(words) + rnd.choice(parts) for _ in range(rnd.randrange(0, 40)))
        out.append((t + (fixed if rnd.random() < 0.4 else "") + rnd.choice(["", " of the city", "."]), rnd.choice(["en", "en", "fr", "und", None])))
    return [*out, (None, "en"), ("", "de"), (None, None), (" . , ", "fr")]


@pytest.mark.parametrize(("least", "cells"), [(30, 1 << 24), (5, 1 << 24), (5, 1 << 16), (200, 1 << 16)])
def test_same_as_plain(spark, monkeypatch, least, cells):
    """Also with a filter so small that rare pairs pass, and counters beyond a byte."""
    monkeypatch.setattr(collocations, "CELLS", cells)
    rows = texts(least)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert got(collocations.collocations(df, least=least)) == plain(rows, least=least)


def test_few_at_the_top_and_other_bounds(spark):
    rows = texts(8)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(collocations.collocations(df, max_n=3, least=8, subsumed=50, top=7)) == plain(rows, max_n=3, least=8, subsumed=50, top=7)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_long_texts_and_hot_words(spark):
    rows = [("the the " * 900_000 + "in deed " * 40, "en"), ("w" * 5000 + " of it", "en"), *[("in deed", "en")] * 90, ("é" * 1500, "en")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(collocations.collocations(df)) == plain(rows)


def test_slices_give_all_words(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 50)
    rnd = random.Random(2)
    text = "".join(rnd.choice(["word", "x" * 70, "é", ",", " ", "\n"]) + rnd.choice([" ", "", "\t"]) for _ in range(500))
    words = Words("en", [text, "end"])
    assert [words.words[i].decode() for i in words.ids if i] == re.findall("[^ \t,\n]+", text) + ["end"]
    assert words.total == len(re.findall("[^ \t,\n]+", text)) + 1


def batches_of(rows, size):
    for a in range(0, len(rows), size):
        part = rows[a : a + size]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "suffix", "n"])


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_stack(size):
    """Prefixes that touch the first or last suffix go out whatever their count."""
    rows = [("en", b"c d ", 1), ("en", b"b ", 9), ("en", b"a x ", 3), ("en", b"a b ", 2), ("en", b"a ", 5), ("de", b"z q ", 1)]
    assert sorted(count_prefixes(batches_of(rows, size), 4, 4)) == [("de", b"z ", 1, 1), ("de", b"z q ", 2, 1), ("en", b"a ", 1, 10), ("en", b"b ", 1, 9), ("en", b"c ", 1, 1), ("en", b"c d ", 2, 1)]


@pytest.mark.parametrize("seed", range(30))
def test_stack_over_parts_gives_all_counts(seed):
    """Sorted suffixes cut into parts and batches anywhere: the sums of what comes out are the counts of all prefixes."""
    rnd = random.Random(seed)
    rows = [(rnd.choice(["en", "fr"]), b"".join(rnd.choice([b"a ", b"b ", b"a\x01 "]) for _ in range(rnd.randrange(1, 5))), rnd.randrange(1, 4)) for _ in range(rnd.randrange(1, 60))]
    want = Counter()
    for g, s, n in rows:
        words = s.split(b" ")[:-1]
        for k in range(1, len(words) + 1):
            want[g, b"".join(w + b" " for w in words[:k]), k] += n
    rows.sort(reverse=True)
    for parts in (1, 3):
        cuts = sorted([0, len(rows), *(rnd.randrange(len(rows) + 1) for _ in range(parts - 1))])
        got = Counter()
        for a, b in zip(cuts, cuts[1:], strict=False):
            for g, s, k, n in count_prefixes(batches_of(rows[a:b], rnd.randrange(1, 9)), 4, 6):
                got[g, s, k] += n
        assert {x: n for x, n in got.items() if n >= 6} == {x: n for x, n in want.items() if n >= 6}


def test_same_as_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    cur = con.execute(collocations.ORACLE)
    assert [c[0] for c in cur.description] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = sorted(cur.fetchall())
    assert want and got(collocations.op11_collocations(spark, d)) == want
