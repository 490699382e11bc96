import numpy as np
import pytest

from ledgerloom.llm import embed_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, threshold):
    ok = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, np.float32).astype(float), lab)
    links = {i: set() for i in ok}
    for a, (x, la) in ok.items():
        for b, (y, lb) in ok.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in ok:
        seen, todo = {i}, [i]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        comp[i] = min(seen)
    return {i: (len(links[i]), comp[i]) for i in ok}


@pytest.mark.parametrize("block", [1024, 8])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((12, 32))
    rows = []
    for i in range(240):
        v = centres[rnd.integers(12)] + rnd.standard_normal(32) * rnd.choice([0.1, 0.27, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rnd.integers(3))))
    rows += [(240 + k, rows[k][1], rows[k][2]) for k in range(30)]
    rows += [(300, None, 1), (301, [0.0] * 32, 1), (302, [float("nan")] * 32, 1), (303, rows[0][1], None), (304, [None] + rows[0][1][1:], rows[0][2]), (305, [], 1), (306, rows[0][1][:16], rows[0][2])]
    got = {r.vec_id: r for r in ed.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    want = brute(rows, ed.THRESHOLD)
    assert len(got) == len(rows)
    for i, _, _ in rows:
        n, c = want.get(i, (0, i))
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, c, c == i), i


def test_empty_table_and_null_id(spark):
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    got = ed.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, ""), (3, [1.0, 0.0], 1, "")], SCHEMA)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(None, 0, None), (3, 0, 3)}


def test_enough_tables():
    for n in (10, 10_000, 10_000_000):
        tables, bits = ed.table_shape(n)
        assert (1 - (1 - np.arccos(ed.THRESHOLD) / np.pi) ** bits) ** tables <= ed.MISS


def test_sketches_lose_almost_nothing():
    assert 30 < ed.sketch_budget() < 50
    rnd = np.random.default_rng(2)
    a, r = rnd.standard_normal((2, 4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r -= (a * r).sum(1)[:, None] * a
    b = ed.THRESHOLD * a + np.sqrt(1 - ed.THRESHOLD**2) * r / np.linalg.norm(r, axis=1)[:, None]
    planes = np.random.default_rng([ed._SEED, 32]).standard_normal((32, ed.SKETCH))
    assert (((a @ planes > 0) != (b @ planes > 0)).sum(1) <= ed.sketch_budget()).all()


def test_doubles_stay_doubles(spark):
    """A pair whose cosine passes the threshold in double precision alone, and one that passes in single precision alone."""
    c = ed.THRESHOLD
    s = float(np.sqrt(1 - c * c))
    rows = [(0, [1.0, 0.0], 1), (1, [c + 1e-12, s], 1), (2, [1.0, 0.0], 2), (3, [c - 1e-12, s], 2)]
    got = {r.vec_id: r.n_links for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0}
