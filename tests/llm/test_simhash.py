import random

import numpy as np
import xxhash

from ledgerloom.llm import simhash


def brute(rows):
    def fp(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = low.encode().split()
        if not words:
            return 0
        sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [(i, fp(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    comp = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        comp[r] = min(comp.get(r, i), i)
    return {i: (f"{f:016x}", comp[find(k)]) for k, (i, f) in enumerate(prints)}


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "  \t"), (3, "One"), (4, "one two three")]
    for n in range(5, 120):
        base = rnd.choice(rows[5:])[1].split(" ") if n > 8 and rnd.random() < 0.6 else [rnd.choice(words) for _ in range(rnd.randint(1, 400))]
        base = list(base)
        if rnd.random() < 0.7:
            base[rnd.randrange(len(base))] = rnd.choice(words)
        rows.append((n, " ".join(base)))
    rows.append((120, rows[10][1]))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (f"{np.int64(r.fp).view(np.uint64):016x}", r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_spark_hash_is_the_same(spark):
    text = "ab cd ef gh"
    h = spark.sql(f"select xxhash64('{text}') h").first().h
    assert h == np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64)


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a"), (4, "a"), (4, "a")], schema)).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {4}


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = [(i, " ".join(f"t{j}" for j in range(300) if j != i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
