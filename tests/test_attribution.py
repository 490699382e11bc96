import io
import math
import random
from contextlib import redirect_stdout

import pytest

from ledgerloom.operators import attribution

DAY = 86400


def plain(rows, lookback, half):
    out = {}
    for c, _, v, t in rows:
        if c is None or t is None or not v or v <= 0:
            continue
        near = [(ch, 2.0 ** (-math.floor((t - u) / DAY) / half)) for k, ch, _, u in rows if k == c and u is not None and t - lookback * DAY <= u <= t]
        for ch, w in near:
            out[ch] = out.get(ch, 0) + v * w / sum(w for _, w in near)
    out.pop(None, None)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "c string, ch string, v double, t long").selectExpr("c", "ch", "v", "timestamp_seconds(t) t")


@pytest.mark.parametrize(("lookback", "half", "batch"), [(30, 7.0, 10_000), (3, 1.5, 3), (1, 7.0, 1), (0, 7.0, 2)])
def test_time_decay_over_blocks_and_batches(spark, lookback, half, batch):
    """Equal times, whole days exactly, times of day before and after, nulls, and batches that cut everywhere."""
    rnd = random.Random(lookback)
    rows = [(rnd.choice(["a", "a", "b", "c", None]), rnd.choice(["x", "y", "z", None]), rnd.choice([0.0, 0.0, 1.0, 2.5, None]), rnd.choice([rnd.randrange(40 * DAY), rnd.randrange(40) * DAY, None])) for _ in range(300)]
    rows += [("a", "x", 1.0, 5 * DAY), ("a", "y", 3.0, 5 * DAY), ("a", "y", 0.0, 2 * DAY)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.channel: r.attributed_conversions for r in attribution.time_decay(frame(spark, rows), "c", "ch", "v", "t", lookback, half).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(plain(rows, lookback, half), rel=1e-9)


def test_a_busy_customer_and_no_join(spark):
    """200,000 touches of one customer within a day, half of them conversions: all pairs would be 10^10."""
    df = spark.range(200_000).selectExpr("'a' c", "if(id % 3 = 0, 'x', 'y') ch", "cast(id % 2 as double) v", "timestamp_micros(id * 400000) t")
    made = attribution.time_decay(df, "c", "ch", "v", "t")
    got = {r.channel: r.attributed_conversions for r in made.collect()}
    assert sum(got.values()) == pytest.approx(100_000) and got["y"] / got["x"] == pytest.approx(2, rel=1e-3)
    out = io.StringIO()
    with redirect_stdout(out):
        attribution._decay(attribution._touches(df, "c", "ch", "v", "t", None), 30, 7).explain()
    assert "Join" not in out.getvalue()
