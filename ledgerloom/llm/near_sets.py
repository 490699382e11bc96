"""Near-duplicate documents by SimHash, prefix buckets for what lies beyond its bits, and a check of the Jaccard similarity on the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, components, in_blocks, over_groups, pairs_by_lag, passing, stored
from ledgerloom.llm.simhash import MAX_BITS, bits_of, linked, ring_keys, shingle_hashes
from ledgerloom.llm.suffix_dedup import piece_hashes, token_codes, word_places

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, NUM, DEN = 5, 4, 5
#: Shingles go rare first: counters of a sample of about so many documents, from COMMON on. Any order gives the same links.
SLOTS, SAMPLE, COMMON = 1 << 22, 20_000, 8
#: Rows of a bucket that are compared as one block, and bits of the filter that tells which texts are worth a shuffle.
BLOCK, FILTER_BITS = 1024, 1 << 24
#: Bits of the parity sketch of a set.
SKETCH_BITS = 1024
#: Bytes of a word from which on its hash is XXH64.
LONG_WORD = 64


def shingles(text: str | None) -> set[bytes]:
    """All runs of SHINGLE words, A-Z in lower case; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def shingle_codes(text: str | None) -> np.ndarray:
    """A 64-bit code of each run of SHINGLE words, repeats included; of fewer words that of all, without a word none. Cheaper than
    ``shingle_hashes``, which are SimHash's."""
    raw = (text or "").encode("utf-8", "replace").translate(LOWER)
    start, end = word_places(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    words = piece_hashes(token_codes(raw), start, end)
    for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
        words[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]])
    width = min(len(words), SHINGLE)
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[j : n + j]
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(33))


def _hashes(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def _set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "big", signed=True)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities: of the shingles of each class of hashes, whether their number is odd. Every bit in which two sketches
    differ tells of a shingle that only one of the sets has, so sets that differ in many bits can't be similar."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _within_reach(differ: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` shingles together may be similar if ``differ`` of them at least are in one only."""
    return differ * (DEN + NUM) <= n * (DEN - NUM)


def _common(docs: DataFrame) -> np.ndarray:
    """Counters of shingles over a sample: under COMMON as 0. At most SLOTS rows come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = [(_hashes(t) & np.uint64(SLOTS - 1)).astype(np.int64) for t in batch["text"]]
            kinds, n = np.unique(np.concatenate([np.zeros(0, np.int64), *slot]), return_counts=True)
            yield pd.DataFrame({"slot": kinds, "n": n})

    share = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    got = some.mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).toPandas()
    out = np.zeros(SLOTS, np.uint16)
    out[got["slot"].to_numpy(np.int64)] = np.minimum(got["n"].to_numpy(np.int64), 65_535)
    return out


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), id (hash of the shingle set), n, keys: the shingles, rare first, of which two similar
    sets share one at least, the set's sketch, and fp, the SimHash fingerprint of the text."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sizes, keys, sketches, prints = [], [], [], [], []
            for text in batch["text"]:
                all_of_it = shingle_hashes(text, SHINGLE)
                prints.append(bits_of(all_of_it))
                h = np.unique(all_of_it)
                n = len(h)
                rank = common.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
                keys.append(h[np.lexsort((h, rank))][: n - (NUM * n + DEN - 1) // DEN + 1].view(np.int64))
                ids.append(_set_id(h))
                sizes.append(n)
                sketches.append(_sketch(h))
            made = {"id": np.array(ids, np.int64), "n": np.array(sizes, np.int64), "keys": pd.Series(keys, dtype=object), "sketch": pd.Series(sketches, dtype=object)}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], **made, "fp": np.array(prints, np.uint64).view(np.int64)})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInPandas(run, "doc_id long, th long, id long, n long, keys array<long>, sketch array<long>, fp long")


def _pairs(frame: pd.DataFrame, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket that SimHash does not link and whose sizes and places still allow the similarity; rows of a bucket come
    in order of size."""
    n, pos, fp = frame["n"].to_numpy(), frame["pos"].to_numpy(), frame["fp"].to_numpy()
    for a, b in pairs_by_lag(frame, _within(n, end)):
        # if the bucket's shingle is the first they share, no more than this is shared
        most = np.minimum(n[a] - pos[a], n[b] - pos[b])
        ok = most * (NUM + DEN) >= NUM * (n[a] + n[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) > MAX_BITS
        yield a[ok], b[ok]


def _print_pairs(frame: pd.DataFrame, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket that SimHash links and whose sizes allow the similarity."""
    n, fp = frame["n"].to_numpy(), frame["fp"].to_numpy()
    for a, b in pairs_by_lag(frame, _within(n, end)):
        ok = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= MAX_BITS
        yield a[ok], b[ok]


def _within(n: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row the end of the rows after it that are not too large, by bisection within its group."""
    low, high = np.arange(len(n)), end.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        fits = open_ & (n[np.minimum(mid, len(n) - 1)] * NUM <= n * DEN)
        low, high = np.where(fits, mid + 1, low), np.where(open_ & ~fits, mid, high)
    return low


def _partnered(frame: pd.DataFrame, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """The rows with a partner in their bucket, and of each one partner to try first (its own id: none)."""
    ids, first, has = frame["id"].to_numpy(), np.arange(len(frame)), np.zeros(len(frame), bool)
    for a, b in _pairs(frame, end):
        fresh = first[b] == b
        first[b[fresh]] = a[fresh]
        has[a] = has[b] = True
    out = frame.assign(other=ids[first])[has]
    return out[["key", "id", "n", "fp", "pos", "blk", "bi", "bj", "other"]]


def _apart(frame: pd.DataFrame, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Pairs of a bucket of keys (with places ``pos``) or of fingerprints that no link joins yet and whose sketches allow the similarity."""
    ids, part, n = frame["id"].to_numpy(), frame["part"].to_numpy(), frame["n"].to_numpy()
    sketch = np.stack(frame["sketch"].to_numpy()).view(np.uint64)
    found = [np.zeros((0, 2), np.int64)]
    for a, b in _pairs(frame, end) if "pos" in frame else _print_pairs(frame, end):
        differ = part[a] != part[b]
        a, b = a[differ], b[differ]
        if len(a):
            near = _within_reach(np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64), n[a] + n[b])
            found.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1)[near])
    out = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches allow the similarity."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    differ = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(_within_reach(differ, F.col("n_a") + F.col("n_b"))).select("a", "b")


def _texts(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, text of the sets in ``pairs`` (a, b); a filter of fixed size goes before the shuffle of the texts. Of several texts
    of a doc_id the hash tells the one that is meant."""
    want = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(nodes.select("id", "doc_id", "th"), "id")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = want.select(slot.alias("b")).distinct().groupBy(F.shiftright("b", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(b & 7 AS INT))")).alias("bits")).toPandas()
    passes = np.zeros(FILTER_BITS // 8, np.uint8)
    passes[bits["byte"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(passes)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            b = batch["b"].to_numpy(np.int64)
            yield batch.loc[(shared.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1, ["doc_id", "th", "text"]]

    few = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", slot.alias("b")).mapInPandas(some, "doc_id long, th long, text string")
    return few.join(want, ["doc_id", "th"]).select("id", "text").dropDuplicates(["id"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets are similar, by the shingles themselves; their codes tell first which are not."""

    def near(x: str, y: str, s: np.ndarray, t: np.ndarray) -> bool:
        both = len(np.intersect1d(s, t, assume_unique=True))
        if both * DEN < NUM * (len(s) + len(t) - both):
            return False
        one, other = shingles(x), shingles(y)
        both = len(one & other)
        return both * DEN >= NUM * (len(one) + len(other) - both)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, last = [], {}
            for x, y in zip(batch["x"], batch["y"], strict=True):
                last = {z: last[z] if z in last else np.unique(shingle_codes(z)) for z in (x, y)}  # pairs of a text follow one another
                keep.append(near(x, y, last[x], last[y]))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, component_id, first for each row of ``docs`` (doc_id, text) with a doc_id: the smallest doc_id
    reachable over documents with a Jaccard similarity of NUM / DEN or more between their sets of shingles, and whether the
    row has it (of several texts with that doc_id: the one of smallest hash).

    Pairs of MAX_BITS or less differing bits are SimHash's alone: each text is tried with its fingerprint's component, then
    with those of its buckets that are not joined by that. The prefix buckets take the pairs that differ in more bits and no
    other: sets of n shingles that are so similar share one of the first n - ceil(n NUM / DEN) + 1 in any common order, so no
    pair is missed. Equal sets, also those without a word, are one node. First one partner a row and bucket is checked, then only
    pairs that these links have not joined, so a group of copies costs no pairs. Parity sketches of fixed size tell most pairs
    that can't be similar, such as documents that share a passage, before any text is sent; what they leave is checked exactly."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with passing(docs.sparkSession):
        sets = stored(_sets(docs))
        nodes = stored(sets.groupBy("id").agg(F.min(F.struct("doc_id", "th", "n", "keys", "sketch", "fp")).alias("s")).select("id", "s.*"))
        prints = linked(stored(nodes.groupBy("fp").agg(F.min("id").alias("id"))))
        near = stored(nodes.join(prints, "fp").select("id", "n", "fp", "sketch", "component_id"))
        keyed = nodes.select("id", "n", "fp", F.posexplode("keys").alias("pos", "key"))
        order = ("key", "bi", "bj", "n", "id")
        dealt = in_blocks(keyed, "key", BLOCK).select("key", "id", "n", "fp", "pos", "blk", "bi", "bj").repartition("key", "bi", "bj").sortWithinPartitions(*order)
        met = stored(dealt.mapInPandas(over_groups(_partnered, "key"), "key long, id long, n long, fp long, pos int, blk int, bi int, bj int, other long"))
        tries = met.where("id <> other").select("id", "other").union(near.where("id <> component_id").select("id", "component_id"))
        tries = tries.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        tries = stored(_plausible(tries, nodes))
        links = stored(_similar(tries, stored(_texts(docs, tries, nodes))))
        part = components(links)
        left = met.drop("other").join(part, met["id"] == part["node"], "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component")
        left = left.join(nodes.select("id", "sketch"), "id").repartition("key", "bi", "bj").sortWithinPartitions(*order)
        near = near.join(part, near["id"] == part["node"], "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component")
        unsettled = near.groupBy("component_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("component_id")
        close = near.join(unsettled, "component_id").select("id", "n", "fp", "sketch", "part", F.explode(F.array(*ring_keys())).alias("key"))
        close = in_blocks(close, "key", BLOCK).repartition("key", "bi", "bj").sortWithinPartitions(*order)
        apart = [d.mapInPandas(over_groups(_apart, "key"), "a long, b long") for d in (left, close)]
        more = stored(apart[0].union(apart[1]).distinct())
        more = stored(_similar(more, stored(_texts(docs, more, nodes))))
        found = components(links.unionByName(more))
        label = nodes.select("id", "doc_id", "th").join(found, F.col("id") == found["node"], "left").select("id", "doc_id", "th", F.coalesce("component", "id").alias("part"))
        first = label.groupBy("part").agg(F.min(F.struct("doc_id", "th")).alias("least"))
        label = stored(label.join(first, "part").select("id", F.col("least.doc_id").alias("component_id"), F.col("least.th").alias("least_th")), outlives=True)
        rows = stored(sets.select("doc_id", "th", "id"), outlives=True)
    out = rows.join(label, "id")
    return out.select("doc_id", F.col("th").alias("text_hash"), "component_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("least_th"))).alias("first"))
