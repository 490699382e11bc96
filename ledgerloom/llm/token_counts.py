"""Token counts of whole texts: byte-pair merges on ragged arrays, rank by rank for many pre-tokens at once."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.common import extended, table

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that are held at once; a longer text is counted in parts of so many.
HELD = 1_000_000
#: Pre-tokens whose counts a Python worker remembers; beyond it the memory starts afresh.
REMEMBERED = 500_000
#: Sequences of more symbols than this are merged rank after rank instead of round after round.
LONG = 256
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it can be seen, else the next free one from 256."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in seen else next(free)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> TokenCounter:
    """One counter for all tasks of a Python worker."""
    return TokenCounter(path)


class TokenCounter:
    """Counts what the library's byte-level BPE of a .json file makes of a text, without making the tokens.

    Takes files whose every merge joins what earlier merges or bytes give: then merging all places of a sequence's
    lowest-ranked pair at once is the same as merging them one by one. Others are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            made = json.load(lines)
        model, before = made["model"], made["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or made["normalizer"] or not plain:
            raise ValueError(f"{path}: only plain byte-level BPE is counted")
        vocab: dict[str, int] = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, product = (np.array([vocab[x] for x in side], np.int64) for side in zip(*[(a, b, a + b) for a, b in pairs], strict=True))
        born = np.full(max(vocab.values()) + 1, NONE, np.int64)
        born[self.of_byte] = -1
        born[product] = np.minimum(born[product], np.arange(len(pairs)))
        if len(np.unique(product)) < len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: its merges don't build on earlier ones alone")
        self.base, self.product = len(born), product.astype(np.int32)
        keys = left * self.base + right
        self.rank_at = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank_at]
        self.special = self._special(made["added_tokens"])
        self.find = regex.compile(public_tokenizers.PATTERN)
        self.unknown = self._unknown_signs(Tokenizer.from_file(path))
        self.known: dict[str, int] = {}

    @staticmethod
    def _special(added: list[dict]) -> regex.Pattern | None:
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens with conditions around them are not counted")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, names))) if names else None

    @staticmethod
    def _unknown_signs(library: Tokenizer) -> dict[int, str]:
        """Letters and digits of our Unicode tables that the library's, which may be older, don't know; to a sign that is neither."""
        signs = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
        starts = {a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str("".join(["!" + c for c in signs]))}
        return {ord(c): "\uffff" for i, c in enumerate(signs) if 2 * i + 1 not in starts}

    def pieces(self, text: str) -> Iterator[str]:
        if text.isascii() or self.unknown.keys().isdisjoint(map(ord, set(text))):
            return (m[0] for m in self.find.finditer(text))
        return (text[slice(*m.span())] for m in self.find.finditer(text.translate(self.unknown)))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank_at[at], NONE)

    def count_pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token (none of them empty)."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        counts = np.empty(len(pieces), np.int64)
        for some, work in ((sizes <= LONG, self.by_rounds), (sizes > LONG, self.by_rank)):
            if some.any():
                data = b"".join(p for p, s in zip(pieces, some, strict=True) if s)
                counts[some] = work(self.of_byte[np.frombuffer(data, np.uint8)], sizes[some])
        return counts

    def by_rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each round every sequence merges all places of its own lowest-ranked pair; who has none left is counted and leaves."""
        counts, who = np.empty(len(sizes), np.int64), np.arange(len(sizes))
        seq = np.repeat(who, sizes)  # the sequence of a symbol, as a place in who
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair of a symbol and the next one

        def renew(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(symbols) - 1)]
            inner = seq[at] == seq[at + 1]
            rank[at] = NONE
            rank[at[inner]] = self.ranks(symbols[at[inner]], symbols[at[inner] + 1])

        renew(np.arange(len(symbols)))
        while len(who):
            starts = np.searchsorted(seq, np.arange(len(who)))
            low = np.minimum.reduceat(rank, starts)
            ended = low == NONE
            if ended.any():
                counts[who[ended]] = np.diff(np.append(starts, len(seq)))[ended]
                stay = ~ended[seq]
                symbols, rank, seq = symbols[stay], rank[stay], (np.cumsum(~ended) - 1)[seq[stay]]
                who, low = who[~ended], low[~ended]
                if not len(who):
                    break
            at = np.flatnonzero(rank == low[seq])
            # a pair of two equal symbols can overlap itself: every second place of a row of them, from the left
            first = np.append(True, np.diff(at) > 1)
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            symbols[at] = self.product[rank[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            at = at - (np.cumsum(gone)[at])
            symbols, rank, seq = symbols[~gone], rank[~gone], seq[~gone]
            rank[at] = NONE
            renew(np.unique(np.concatenate([at - 1, at])))
        return counts

    def by_rank(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All sequences merge all places of one rank, then of the next rank there is: merges only give pairs of higher ranks.
        Time goes with the symbols and the different ranks, not with their product."""
        n = len(symbols)
        seq = np.repeat(np.arange(len(sizes)), sizes)
        after, prior = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, alive = np.full(n, NONE, np.int32), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def renew(at: np.ndarray) -> None:
            to = after[at]
            inner = to < n
            inner[inner] = seq[at[inner]] == seq[to[inner]]
            rank[at] = NONE
            at = at[inner]
            rank[at] = self.ranks(symbols[at], symbols[after[at]])
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            values, first = np.unique(rank[at], return_index=True)
            for value, part in zip(values.tolist(), np.split(at, first[1:]), strict=False):
                if value not in waiting:
                    heapq.heappush(heap, value)
                waiting.setdefault(value, []).append(part)

        renew(np.arange(n))
        while heap:
            value = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(value)))
            at = at[alive[at] & (rank[at] == value)]
            if not len(at):
                continue
            first = np.append(True, after[at[:-1]] != at[1:])
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            gone = after[at]
            symbols[at], alive[gone], after[at] = self.product[value], False, after[gone]
            prior[after[at][after[at] < n]] = at[after[at] < n]
            renew(np.unique(np.concatenate([at, prior[at][prior[at] >= 0]])))
        return np.bincount(seq[alive], minlength=len(sizes))

    def learn(self, pieces: list[str]) -> dict[str, int]:
        """The memory, with the counts of all these pre-tokens in it."""
        new = list(set(pieces).difference(self.known))
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, list(set(pieces))
            self.known.update(zip(new, self.count_pieces([p.encode("utf-8") for p in new]).tolist(), strict=True))
        return self.known

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. No more than about HELD pre-tokens are held."""
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            known = self.learn([p for _, pieces in held for p in pieces])
            for i, pieces in held:
                totals[i] += sum(map(known.__getitem__, pieces))
            held.clear()

        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                totals[i] += len(parts) - 1
            for part in parts:
                found = self.pieces(part)
                while pieces := list(islice(found, HELD)):
                    held.append((i, pieces))
                    size += len(pieces)
                    if size >= HELD:
                        flush()
                        size = 0
        flush()
        return totals


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: str | None = None, text_too: bool = True) -> DataFrame:
    """``docs`` with n_bytes (of UTF-8), n_tokens and over_limit (n_tokens > ``limit``); columns of these names are replaced.

    ``vocabulary``: path of a tokenizer .json that every executor can open; the public package's by default. Special
    strings in a text are one token each, as the library has it by default; nothing is added, cut or padded. Null or
    empty text: no bytes, no tokens. Rows are independent: repeated rows, null ids and other columns pass as they are
    (the text only with ``text_too``), an empty table gives none, and a text or a pre-token of any length is counted whole."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_of(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            n = np.array(counter.count(texts), np.int64)
            out = batch if text_too else batch.drop(columns="text")
            yield out.assign(n_bytes=[len(t.encode("utf-8")) for t in texts], n_tokens=n, over_limit=n > limit)

    docs, schema = extended(docs.withColumn("text", F.col("text").cast("string")), n_bytes="long", n_tokens="long", over_limit="boolean")
    return docs.mapInPandas(run, schema if text_too else schema.replace("`text` string, ", "", 1))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), text_too=False)
