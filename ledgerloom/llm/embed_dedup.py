"""Embedding near-dedup: random-hyperplane signatures in several tables, exact cosine, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, in_blocks, local_components, over_groups, pairs_by_lag, passing, stored, table

THRESHOLD = 0.93
#: Share of pairs exactly at the threshold that no table may bring together; pairs above it are missed less often.
MISS = 1e-6
#: Distinct vectors that a bucket should hold on average, and rows of a bucket that are compared as one block.
PER_BUCKET, BLOCK = 16, 1024
#: Bits of the sketch that tells which rows of a bucket may have a partner there, before any vector moves.
SKETCH = 128
_SEED = 20_260_101


def table_shape(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits) for ``n`` distinct vectors: bits grow with log n, tables so that ``miss`` holds."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / (PER_BUCKET * 4))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-agree)), bits


def sketch_budget(threshold: float = THRESHOLD, miss: float = MISS / 10) -> int:
    """Bits by which the sketches of a pair at the threshold differ at most, but for a share ``miss``."""
    p = math.acos(threshold) / math.pi
    left, k = 1.0, -1
    while left > miss:
        k += 1
        left -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


def _valid(v: np.ndarray | None) -> bool:
    if v is None or not len(v):
        return False
    x = np.array(v, np.float64)  # null components turn into nan
    return bool(np.isfinite(x).all() and x.any())


def _keyed(vectors: DataFrame) -> tuple[DataFrame, np.dtype]:
    """vec_id, label, v (the components' bytes), digest; digest is null where a vector links with nothing. And the bytes' kind:
    components of single precision stay so, all others are doubles."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = np.dtype(np.float32 if kind == "float" else np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = [
                hashlib.blake2b(np.asarray(v, dtype).tobytes(), digest_size=16).hexdigest() if lab is not None and lab == lab and _valid(v) else None
                for v, lab in zip(batch["v"], batch["label"], strict=True)
            ]
            yield batch.assign(digest=digests, v=[None if v is None else np.asarray(v, dtype).tobytes() for v in batch["v"]])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{'float' if dtype.itemsize == 4 else 'double'}>").alias("v"))
    return rows.mapInPandas(run, "vec_id long, label long, v binary, digest string"), dtype


def _signed(classes: DataFrame, tables: int, bits: int, dtype: np.dtype) -> DataFrame:
    """id, label, size, sigs (of each table, long by long), s1 and s2 (the sketch): made once, so that all passes see the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch["v"].map(len).to_numpy()
            for b in np.unique(size):
                d = int(b) // dtype.itemsize
                if d not in planes:
                    planes[d] = np.random.default_rng([_SEED, d]).standard_normal((d, tables * bits + SKETCH))
                for at in range(0, int((size == b).sum()), 4096):
                    part = batch[size == b].iloc[at : at + 4096]
                    x = np.frombuffer(b"".join(part["v"]), dtype).reshape(-1, d).astype(np.float64)
                    above = x @ planes[d] > 0
                    sigs = (above[:, SKETCH:].reshape(len(x), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                    sketch = np.packbits(above[:, :SKETCH], axis=1).view(np.int64)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "label": part["label"].to_numpy(), "size": b, "sigs": [r.tobytes() for r in sigs], "s1": sketch[:, 0], "s2": sketch[:, 1]})

    return classes.select("id", "label", "v").mapInPandas(run, "id long, label long, size long, sigs binary, s1 long, s2 long")


def _dealt(signed: DataFrame) -> DataFrame:
    """A row for each class and table: label, size, t, sig, id, s1, s2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sigs = np.frombuffer(b"".join(batch["sigs"]), np.int64).reshape(len(batch), -1)
            for t in range(sigs.shape[1]):
                yield batch.drop(columns="sigs").assign(t=t, sig=sigs[:, t])

    rows = signed.mapInPandas(run, "id long, label long, size long, s1 long, s2 long, t int, sig long")
    return rows.select(F.xxhash64("label", "size", "t", "sig").alias("key"), "id", "t", "s1", "s2")


def _partnered(budget: int):
    def work(frame: pd.DataFrame, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        """The rows with another in their bucket whose sketch is near enough."""
        s1, s2 = frame["s1"].to_numpy().view(np.uint64), frame["s2"].to_numpy().view(np.uint64)
        has = np.zeros(len(frame), bool)
        for a, b in pairs_by_lag(frame, end):
            near = np.bitwise_count(s1[a] ^ s1[b]).astype(np.int64) + np.bitwise_count(s2[a] ^ s2[b]) <= budget
            has[a[near]] = has[b[near]] = True
        return frame.loc[has, ["key", "bi", "bj", "blk", "id", "t"]]

    return work


def _link(threshold: float, dtype: np.dtype):
    def work(frame: pd.DataFrame, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        ids, t, label, same = (frame[c].to_numpy() for c in ("id", "t", "label", "n_same"))
        d = frame["v"].map(len).to_numpy() // dtype.itemsize
        x, sigs = np.zeros((len(frame), int(d.max()))), np.frombuffer(b"".join(frame["sigs"]), np.int64).reshape(len(frame), -1)
        for n in np.unique(d):
            at = np.flatnonzero(d == n)
            x[at, :n] = np.frombuffer(b"".join(frame["v"].to_numpy()[at]), dtype).reshape(-1, n)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        links, found = np.zeros(len(frame), np.int64), []
        for a, b in pairs_by_lag(frame, end):
            ok = (label[a] == label[b]) & (d[a] == d[b])
            a, b = a[ok], b[ok]
            close = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[close], b[close]
            if not len(a):
                continue
            # a pair counts in the first table that brings it together, so no link counts twice
            new = (sigs[a] == sigs[b]).argmax(axis=1) == t[a]
            a, b = a[new], b[new]
            np.add.at(links, a, same[b])
            np.add.at(links, b, same[a])
            found.append((a, b))
        if not found:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        root = local_components(len(frame), np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found]))
        seen = np.flatnonzero(links)
        return pd.DataFrame({"a": ids[seen], "b": ids[root[seen]], "links": links[seen]})

    return work


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Rows of equal label and equal vector form a class, held by its smallest vec_id and linked with one another; only
    distinct vectors are compared, in buckets of any size, block by block. Sketches of SKETCH bits go to the buckets first;
    vectors follow only for rows that may have a partner there. Recall: a pair at the threshold meets in one of the
    tables but for a share MISS, and its sketches differ by more than the budget in a tenth of that; no pair below it is
    linked. Null label, null, empty or zero vector, null or non-finite component: no links, a component of its own. Vectors of
    different lengths don't link. Null vec_id: kept, linked with nothing. Other columns are ignored; an empty table
    gives no rows."""
    keyed, dtype = _keyed(vectors)
    keyed = stored(keyed)
    with passing(vectors.sparkSession):
        valid = keyed.where("digest is not null and vec_id is not null")
        classes = stored(valid.groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("n_same"), F.first("v").alias("v")))
        tables, bits = table_shape(classes.count(), threshold)
        signed = stored(_signed(classes, tables, bits, dtype))
        dealt = in_blocks(_dealt(signed), "key", BLOCK).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id")
        met = stored(dealt.mapInPandas(over_groups(_partnered(sketch_budget(threshold)), "key"), "key long, bi int, bj int, blk int, id long, t int"))
        full = met.join(signed.select("id", "sigs"), "id").join(classes.select("id", "v", "label", "n_same"), "id")
        full = full.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id")
        pairs = stored(full.mapInPandas(over_groups(_link(threshold, dtype), "key"), "a long, b long, links long"))
        linked = stored(pairs.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links")))
        found = components(pairs.where("a <> b").select("a", "b"))
        per_class = (
            classes.select("label", "digest", "id", "n_same").join(linked, "id", "left").join(found, F.col("id") == F.col("node"), "left")
            .select("label", "digest", (F.col("n_same") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        )
        per_class = stored(per_class, outlives=True)
    out = keyed.select("vec_id", "label", "digest").join(per_class, ["label", "digest"], "left")
    alone = F.col("component_id").isNull() | F.col("vec_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE list_dot_product(e, e) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
reach(a, b) AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
  SELECT a, b FROM r),
comp AS (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, e.vec_id) AS component_id,
  coalesce(comp.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN cnt ON e.vec_id = cnt.a LEFT JOIN comp ON e.vec_id = comp.a
"""
