"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through pigeonring candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, components, in_blocks, local_components, over_groups, pairs_by_lag, passing, stored, table

#: Bits by which linked fingerprints differ at most, and the ring of segments as (lowest bit, bits).
MAX_BITS = 4
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SHINGLE, SEED = 4, 42
#: Rows of a bucket that are compared as one block.
BLOCK = 1024
#: Hashes turned into bits at a time.
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each shingle of a text, repeats included; of fewer words that of all, without a word none."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.array([digest(view[a:b], SEED) for a, b in spans], np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """Bit b is 1 if over half of the hashes have it; of none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return bits_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "fp": fps})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


def ring_keys() -> list:
    """Of each start in the ring two keys: its segment, and either half of the next one.

    Chains of a linked pair obey the budgets of some start: no bit in its segment, at most one in the first two. So one
    half of the second segment is equal too."""
    keys = []
    for i, (low, n) in enumerate(RING):
        low2, n2 = RING[(i + 1) % len(RING)]
        own = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1))
        half = n2 // 2
        for h, (a, m) in enumerate(((low2, half), (low2 + half, n2 - half))):
            part = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << m) - 1))
            keys.append((own * 128 + part) * 16 + (2 * i + h))
    return keys


def _link(frame: pd.DataFrame, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    fp, ids = frame["fp"].to_numpy().view(np.uint64), frame["id"].to_numpy()
    first = (frame["key"].to_numpy() % 16) // 2
    masks = np.array([((1 << n) - 1) << low for low, n in RING], np.uint64)
    found = []
    for a, b in pairs_by_lag(frame, end):
        x = fp[a] ^ fp[b]
        ok = np.ones(len(x), bool)
        used = np.zeros(len(x), np.int64)
        for step in range(len(RING)):  # the chain from the bucket's start, as long as it stays within budget
            used += np.bitwise_count(x & masks[(first[a] + step) % len(RING)])
            ok &= used * len(RING) <= (step + 1) * MAX_BITS
        if ok.any():
            found.append((a[ok], b[ok]))
    if not found:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    label = local_components(len(frame), np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    moved = np.flatnonzero(label != np.arange(len(frame)))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def linked(classes: DataFrame) -> DataFrame:
    """fp, component_id of each row of ``classes`` (id, fp; no fp twice): the smallest id reachable over fingerprints that differ
    in MAX_BITS or less. Buckets of any size are compared in blocks."""
    keyed = classes.select("id", "fp", F.explode(F.array(*ring_keys())).alias("key"))
    dealt = in_blocks(keyed, "key", BLOCK).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id")
    edges = dealt.mapInPandas(over_groups(_link, "key"), "a long, b long")
    found = components(edges)
    return classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs`` (doc_id, text), by shingles of ``shingle`` words.

    Documents of one fingerprint are one class, held by its smallest doc_id; only distinct fingerprints are compared, so
    copies cost a count. Null or empty text: fingerprint zero, which links
    like any other. Null doc_id: kept, with its fingerprint's component. Repeated rows are kept; other columns
    are ignored; an empty table gives no rows."""
    prints = stored(fingerprints(docs, shingle))
    with passing(docs.sparkSession):
        classes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
        label = stored(linked(classes), outlives=True)
    return prints.join(label, "fp", "left").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
