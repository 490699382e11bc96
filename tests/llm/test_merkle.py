import hashlib
import random
import zlib

import duckdb
import pytest

from ledgerloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, G string, pos int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows, fanout=8):
    """Trees level by level over whole lists; rows: (doc_id, text, lang, source, n_chars)."""

    def leaf(i, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][a : a + fanout])) for a in range(0, len(levels[-1]), fanout)])
        return levels

    def way(levels, j):
        out = []
        for level in levels[:-1]:
            a = j - j % fanout
            out.append(("".join(level[a:j]), "".join(level[j + 1 : a + fanout])))
            j //= fanout
        return out

    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    made = {g: sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[2] == g), key=lambda x: x[:3]) for g in langs}
    trees = {g: tree([x[2] for x in made[g]]) for g in langs}
    tops = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for j, (_, _, h, r) in enumerate(made[g]):
            path = way(trees[g], j) + way(tops, k)
            node = leaf(r[0], low(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else h
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], h, trees[g][-1][0], tops[-1][0], sha("".join(a + b for a, b in path)), node, node == tops[-1][0]))
    return out


def rows_of(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("levels", [1, 4])
def test_same_as_plain(spark, tmp_path, monkeypatch, levels):
    """Groups of one leaf, of whole and broken runs, null group and null fields, repeated rows; with small blocks several passes."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rnd = random.Random(1)
    rows = []
    for g, n in (("en", 700), ("fr", 64), ("de", 9), (None, 5), ("", 1), ("é", 513), *((f"x{i}", 1) for i in range(70))):
        rows += [(rnd.randrange(10**6), rnd.choice(["Some Text", "ÄÖ only é", "low", "", None]), g, rnd.choice(["s", None]), rnd.choice([1, None])) for _ in range(n)]
    rows += [rows[0], rows[0], (None, "A", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert order(rows_of(merkle.op12_merkle(spark, str(tmp_path)))) == order(plain(rows))


@pytest.mark.parametrize("rows", [[], [(3, "A", "en", "s", 1)], [(3, "A", None, "s", 1), (4, "B", "en", "s", 1)]])
def test_few_rows(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert order(rows_of(merkle.op12_merkle(spark, str(tmp_path)))) == order(plain(rows))


def test_long_text(spark, tmp_path):
    rows = [(1, "Ab" * 3_000_000, "en", "s", 6_000_000), (6, "Ab" * 3_000_000, "en", "s", 6_000_000)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert order(rows_of(merkle.op12_merkle(spark, str(tmp_path)))) == order(plain(rows))


def test_same_as_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    cur = con.execute(merkle.ORACLE)
    assert [c[0] for c in cur.description] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert order(cur.fetchall()) == order(rows_of(merkle.op12_merkle(spark, d)))
