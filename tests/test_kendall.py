import random

import numpy as np
import pytest

from ledgerloom.operators import association, kendall


def plain(points):
    s = tx = ty = 0
    for i, (x, y) in enumerate(points):
        for u, v in points[:i]:
            s += ((x > u) - (x < u)) * ((y > v) - (y < v))
            tx += x == u
            ty += y == v
    p = len(points) * (len(points) - 1) / 2
    return s / ((p - tx) * (p - ty)) ** 0.5 if p > tx and p > ty else None


def cloud(seed, n):
    rnd = random.Random(seed)
    kinds = [lambda: (rnd.gauss(0, 1), rnd.gauss(0, 1)), lambda: (float(rnd.randrange(6)), float(rnd.randrange(4))), lambda: (7.0, rnd.random()), lambda: (rnd.random(), -3.0), lambda: (k := rnd.random(), k * k + rnd.random() / 5)]
    return [rnd.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_signed_pairs(seed):
    points = cloud(seed, 200)
    x, y = np.array(points).T
    want = sum(((a > u) - (a < u)) * ((b > v) - (b < v)) for i, (a, b) in enumerate(points) for u, v in points[:i])
    assert kendall.signed_pairs(x, y, np.ones(len(x), np.int64)) == want


@pytest.mark.parametrize(("strip", "seed"), [(10**6, 1), (40, 2), (7, 3)])
def test_tau_is_that_of_all_pairs(spark, monkeypatch, strip, seed):
    """One strip; a few; and many, among them strips of one value that a third of the rows have."""
    monkeypatch.setattr(kendall, "STRIP", strip)
    points = cloud(seed, 400) + [(7.0, float(i % 9)) for i in range(200)]
    df = spark.createDataFrame(points, "x double, y double")
    assert kendall.kendall_tau(df).first().correlation == pytest.approx(plain(points), rel=1e-12)


def test_pairs_of_columns_with_gaps(spark):
    rows = [(float(i % 7), float(i * i % 11) if i % 5 else None, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.var1, r.var2): r.correlation for r in association.correlation_pairs(df, method="kendall").collect()}
    assert got["a", "b"] == round(plain([(a, b) for a, b, _ in rows if b is not None]), 4)
    assert got["a", "c"] is None and got["b", "c"] is None
    assert association.correlation_pairs(df.limit(0), ["a", "b"], "kendall").first().correlation is None
