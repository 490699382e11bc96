"""Helpers shared by the training-data operators: tables, stored intermediates, blocked pair search, components."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.store import passing, shared_dir, stored  # noqa: F401

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each row, ``size`` of them, one row after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Remembered:
    """What ``learn`` makes of each string of a stream that repeats many: (values, how many of them each string has).

    Beyond ``limit`` strings half of that stay at most: those used most since the last time."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.learn, self.limit = learn, limit
        self.known: defaultdict[str, int] = defaultdict(count().__next__)  # a string not seen yet gets the next number
        self.values, (self.first, self.length, self.uses) = None, np.zeros((3, 0), np.int64)

    def _forget(self) -> None:
        least = 2
        while (keep := np.flatnonzero(self.uses >= least)).size > self.limit // 2:
            least *= 2
        strings = list(self.known)
        self.known = defaultdict(count(len(keep)).__next__, zip([strings[i] for i in keep.tolist()], range(len(keep)), strict=True))
        self.values, self.length = self.values[ragged(self.first[keep], self.length[keep])], self.length[keep]
        self.first, self.uses = np.cumsum(self.length) - self.length, np.ones(len(keep), np.int64)

    def of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(values of the strings, one after the other; how many each has)."""
        if len(self.known) >= self.limit:
            self._forget()
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))
        if len(self.known) > before or self.values is None:
            values, length = self.learn(list(islice(self.known, before, None)))
            self.first = np.append(self.first, (0 if self.values is None else len(self.values)) + np.cumsum(length) - length)
            self.values = values if self.values is None else np.append(self.values, values)
            self.length, self.uses = np.append(self.length, length), np.append(self.uses, np.zeros(len(length), np.int64))
        self.uses += np.bincount(at, minlength=len(self.uses))
        size = self.length[at]
        return self.values[ragged(self.first[at], size)], size


def extended(docs: DataFrame, **made: str) -> tuple[DataFrame, str]:
    """``docs`` without columns named like those an operator adds, in any case, and the schema with the added ones, for
    mapInPandas: an added column takes the place of one of its name."""
    names = {n.lower() for n in made}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {t}" for n, t in made.items()]
    return docs, ", ".join(fields)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest index reachable over the links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(label, high, low)
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above


def in_blocks(rows: DataFrame, key: str, block_rows: int) -> DataFrame:
    """Rows of each bucket ``key`` dealt to pairs of blocks.

    A bucket of at most ``block_rows`` rows is one block. A larger one is split by a hash of the row into c blocks and
    every row goes to the c pairs (i, j), i <= j, that its block takes part in, so any two rows meet in some task
    and no task holds more than about two blocks of a bucket. Adds ``blk``, ``bi``, ``bj``.
    Only buckets beyond a block, few by their size, take part in the join that tells c."""
    share = max(1, min(16, block_rows // 64))  # sizes are told from so small a share of the rows: they decide on blocks alone
    some = rows.where(F.pmod(F.hash("id", F.lit(13)), F.lit(share)) == 0)
    large = some.groupBy(key).agg((F.count("*") * share).alias("n_in")).where(F.col("n_in") > block_rows)
    large = stored(large.select(key, F.ceil(F.col("n_in") / block_rows).cast("int").alias("n_large")))
    dealt = rows.join(large, key, "left").withColumn("n_blk", F.coalesce("n_large", F.lit(1))).drop("n_large")
    # the blocks of a bucket: from the row's own columns, so that a retried task deals as before
    blk = F.when(F.col("n_blk") == 1, 0).otherwise(F.pmod(F.hash("id", F.lit(11)), F.col("n_blk")))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1))
    out = dealt.withColumn("blk", blk).withColumn("other", other)
    return out.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).drop("other", "n_blk")


def over_groups(work: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], key: str) -> Callable:
    """For mapInPandas on rows that are sorted by (key, bi, bj): calls ``work(rows, start, end)`` on whole groups,
    many at once; start and end bound the group of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(frame):
                cols = [frame[c].to_numpy() for c in (key, "bi", "bj")]
                new = np.ones(len(frame), bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
                first = np.flatnonzero(new)
                sizes = np.diff(np.append(first, len(frame)))
                out = work(frame, np.repeat(first, sizes), np.repeat(first + sizes, sizes))
                if len(out):
                    yield out

        for batch in batches:
            if not len(batch):
                continue
            last = batch.iloc[-1]
            same = (batch[key].to_numpy() == last[key]) & (batch["bi"].to_numpy() == last["bi"]) & (batch["bj"].to_numpy() == last["bj"])
            cut = len(batch) - int(same.sum())
            if cut == 0 and held:
                prev = held[-1].iloc[-1]
                if prev[key] == last[key] and prev["bi"] == last["bi"] and prev["bj"] == last["bj"]:
                    held.append(batch)
                    continue
            yield from flush(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
            held = [batch.iloc[cut:]]
        if held:
            yield from flush(pd.concat(held, ignore_index=True))

    return run


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of equal ``keys``, from batches in which the rows of a group follow one another."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= rows:
            frame = pd.concat(held, ignore_index=True)
            same = np.logical_and.reduce([(frame[k] == frame[k].iloc[-1]).to_numpy() for k in keys])
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if cut:
                yield frame.iloc[:cut]
            held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def pairs_by_lag(frame: pd.DataFrame, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, lag by lag; of a pair of blocks only those across both."""
    blk, across = frame["blk"].to_numpy(), (frame["bi"] != frame["bj"]).to_numpy()
    left = np.arange(len(frame))
    lag = 0
    while True:
        lag += 1
        left = left[left + lag < end[left]]
        if not len(left):
            return
        right = left + lag
        keep = ~across[left] | (blk[left] != blk[right])
        yield left[keep], right[keep]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b), for every node with a link.

    Each round points every node to its smallest neighbour, follows the pointers up to four steps, and contracts
    the links to what the ends point to. Counts of links, never links, reach the driver; a node with very many
    links is aggregated map-side and its joins can be split by adaptive execution."""
    links = stored(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    levels: list[DataFrame] = []
    while levels == [] or not links.isEmpty():
        both = links.union(links.select("v", "u"))
        points = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        for _ in range(2):
            up = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
            points = stored(points.join(up, "p").select("u", F.col("q").alias("p")))
        levels.append(points)
        pu, pv = points.select("u", F.col("p").alias("pu")), points.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = links.join(pu, "u").join(pv, "v").where("pu <> pv")
        links = stored(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    found = levels[-1]
    for level in reversed(levels[:-1]):
        above = found.select(F.col("u").alias("p"), F.col("p").alias("q"))
        found = stored(level.join(above, "p", "left").select("u", F.coalesce("q", "p").alias("p")))
    return found.select(F.col("u").alias("node"), F.col("p").alias("component"))
