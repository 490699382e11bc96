"""Kendall's tau-b of any two columns: concordant less discordant pairs by strips, cells and a two-dimensional prefix sum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.semantics import ratio
from ledgerloom.functions.store import stored

#: Distinct pairs of values of a strip, and the most strips on a side (beyond that strips grow with the table).
STRIP, MOST = 200_000, 2048


def signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum over all pairs of points of sign(dx) sign(dy) n1 n2. Two different x part at one bit of their ranks: there the points of
    bit 0 are sorted by y, and those of bit 1 count who is below and above."""
    rx, ry = (np.unique(v, return_inverse=True)[1].astype(np.int64) for v in (x, y))
    if not len(rx):
        return 0.0
    width, s = int(ry.max()) + 1, 0.0
    for bit in range(int(rx.max()).bit_length()):
        block = rx >> (bit + 1)
        left = (rx >> bit) & 1 == 0
        key = block * width + ry
        order = np.argsort(key[left], kind="stable")
        keys = key[left][order]
        upto = np.append(0, np.cumsum(n[left][order]))
        right = ~left
        at = lambda k, side: upto[np.searchsorted(keys, k, side)]
        start = block[right] * width
        below = at(key[right], "left") - at(start, "left")
        above = at(start + width, "left") - at(key[right], "right")
        s += float(np.sum(n[right].astype(np.float64) * (below - above)))
    return s


def between_cells(bx: np.ndarray, by: np.ndarray, n: np.ndarray) -> float:
    """The same over pairs of cells that differ in both numbers: counts before and behind from prefix sums over the grid."""
    grid = np.zeros((int(bx.max()) + 1, int(by.max()) + 1), np.int64)
    np.add.at(grid, (bx, by), n)
    left = np.cumsum(grid, 0) - grid  # of smaller bx, each by
    below = np.cumsum(left, 1) - left
    above = left.sum(1, keepdims=True) - below - left
    return float(np.sum(grid.astype(np.float64) * (below - above)))


def _cuts(kinds: DataFrame, strips: int) -> dict[str, np.ndarray]:
    """Starts of strips of about equal size for x and y; a value that fills a strip has one of its own. Any cuts give the same sum."""
    probs = [i / strips for i in range(1, strips)]
    found = kinds.approxQuantile(["x", "y"], probs, 1 / (4 * strips)) if strips > 1 else [[], []]
    out = {}
    for c, q in zip(("x", "y"), found, strict=True):
        values, times = np.unique(np.array(q, np.float64), return_counts=True)
        out[c] = np.unique(np.concatenate([values, np.nextafter(values[times > 1], math.inf)]))
    return out


def kendall_tau(d: DataFrame) -> DataFrame:
    """One row: correlation, tau-b of the columns x and y (doubles, not null); null where one has a single value.

    Rows become distinct pairs of values with their counts. Both axes are cut into strips: pairs of points within a strip are
    counted there, in a task a strip; pairs that differ in both strips only by the numbers of the cells they lie in, from a
    grid of MOST x MOST at most. A strip of a single value has no pair that counts and is not gathered, however large."""
    kinds = stored(d.groupBy("x", "y").agg(F.count("*").alias("n")))
    strips = min(MOST, max(1, -(-kinds.count() // STRIP)))
    cuts = _cuts(kinds, strips)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(bx=np.searchsorted(cuts["x"], b["x"], "right"), by=np.searchsorted(cuts["y"], b["y"], "right"))

    def single(c: str) -> list[int]:
        """Strips of one value alone."""
        starts = cuts[c]
        return [i + 1 for i in range(len(starts) - 1) if starts[i + 1] == np.nextafter(starts[i], math.inf)]

    def across(strip: pd.DataFrame) -> pd.DataFrame:
        """Pairs within a strip of x, without those of one cell: the strips of y have them."""
        x, y, n, by = (strip[c].to_numpy() for c in ("x", "y", "n", "by"))
        order = np.argsort(by, kind="stable")
        cells = np.split(order, np.flatnonzero(np.diff(by[order])) + 1)
        return pd.DataFrame({"s": [signed_pairs(x, y, n) - sum(signed_pairs(x[c], y[c], n[c]) for c in cells)]})

    def along(strip: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [signed_pairs(strip["x"].to_numpy(), strip["y"].to_numpy(), strip["n"].to_numpy())]})

    placed = kinds.mapInPandas(place, "x double, y double, n long, bx int, by int")
    if strips == 1:
        parts = placed.groupBy("by").applyInPandas(along, "s double")
    else:
        placed = stored(placed)
        cells = placed.groupBy("bx", "by").agg(F.sum("n").alias("n")).toPandas()
        told = between_cells(cells["bx"].to_numpy(), cells["by"].to_numpy(), cells["n"].to_numpy())
        parts = placed.where(~F.col("bx").isin(single("x"))).groupBy("bx").applyInPandas(across, "s double")
        parts = parts.union(placed.where(~F.col("by").isin(single("y"))).groupBy("by").applyInPandas(along, "s double"))
        parts = parts.union(d.sparkSession.createDataFrame([(told,)], "s double"))
    s = parts.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    tied = lambda c: kinds.groupBy(c).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2))
    n = F.sum("n").cast("double")
    t = s.crossJoin(tied("x").toDF("tx")).crossJoin(tied("y").toDF("ty")).crossJoin(kinds.agg((n * (n - 1) / 2).alias("p")))  # one row each
    return t.select(ratio(F.col("s"), F.sqrt((F.col("p") - F.col("tx")) * (F.col("p") - F.col("ty")))).alias("correlation"))
