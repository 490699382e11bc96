"""Byte-level BPE: exact merges in linear time by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Remembered, ragged, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Columns of the results.
MADE = ("doc_id", "text", "ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")
#: Words and token pairs remembered by a Python worker; beyond it only words used again stay. Pairs of many pieces at once have slots.
REMEMBERED, PAIR_BITS = 300_000, 20
#: Characters of the texts that are encoded together, and pieces from which on they go back side by side.
_AT_ONCE, _FEW = 1 << 21, 64
#: A space that a word does not follow.
_ODD = re.compile(r" (?:\s|\Z)")
_NONE = 1 << 62


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> BytePairCodec:
    """One codec for all tasks of a Python worker."""
    return BytePairCodec(path)


class BytePairCodec:
    """Encoder and decoder for one rank file.

    A token sequence is what the merges give exactly if every two neighbours are what the merges give for their joined
    bytes. So the encoder walks left to right, tries the longest token first, and accepts it after the one before if the
    two are compatible; where none fits it goes back a token and marks the place as dead, so each place is left once.
    Many pieces go side by side, a step of each at a time; those that the longest tokens alone spell need no step."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = ahocorasick.Automaton()
        n = max(self.bytes_of) + 1
        #: Of each token its bytes, the next shorter one that it starts with (none: -1), and the two that it is merged from (of a byte: itself).
        self.size, self.shorter = np.zeros(n, np.int64), np.full(n, -1)
        self.left, self.right = np.arange(n), np.arange(n)
        for t, i in self.rank.items():
            self.size[i] = len(t)
            halves = self._parts(t, len(t) > 1)
            if len(halves) == 1 + (len(t) > 1) and (len(t) == 1 or b"".join(halves) in self.rank):
                self.words.add_word(t.decode("latin-1"), i)
                self.left[i], self.right[i] = self.rank[halves[0]], self.rank[halves[-1]]
        self.words.make_automaton()
        for t, i in self.rank.items():
            start = next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n].decode("latin-1") in self.words), None)
            if start is not None:
                self.shorter[i] = self.rank[start]
        made = np.flatnonzero(self.left != np.arange(n))
        code = self.left[made] << 32 | self.right[made]
        order = np.argsort(code)
        self.merge_codes, self.merge_ids = np.append(code[order], _NONE), np.append(made[order], _NONE)
        #: Whether all tokens can be reached, each from two of lower rank, as training makes them; else pieces are encoded one by one.
        self.plain = len(self.words) == len(self.rank) and bool((np.maximum(self.left, self.right)[made] < made).all())
        self.pair_codes, self.pair_fits = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)
        self.spelled = pa.array([self.bytes_of.get(i, b"") for i in range(n)], pa.binary())
        self.decimal = pa.array([b"%d " % i for i in range(n)], pa.binary())
        #: Tokens of three bytes and more, and those of two by their bytes.
        self.long, self.two = ahocorasick.Automaton(), np.full(1 << 16, -1)
        for t, i in self.rank.items():
            if len(t) == 2:
                self.two[t[0] << 8 | t[1]] = i
            elif len(t) > 2:
                self.long.add_word(t.decode("latin-1"), i)
        self.long.make_automaton()
        self.one = np.array([self.rank.get(bytes([i]), -1) for i in range(256)])
        #: Tokens of words: one with a space before it goes by itself, any other string behind a space.
        self.words_known = Remembered(self._learn, REMEMBERED)

    def _parts(self, piece: bytes, before_last: bool = False) -> list[bytes]:
        """The merges as defined: the pair of lowest rank first, the leftmost of equals. Quadratic, for short pieces. ``before_last``: without
        the one that makes a single token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while not (before_last and len(parts) == 2):
            best = min(((self.rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def merged(self, piece: bytes) -> list[int]:
        return [self.rank[p] for p in self._parts(piece)]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs: the merges of both are undone, the last one first; the tokens that touch then must not have
        had a merge of their own before it."""
        fits, limit, at = np.ones(len(a), bool), np.full(len(a), _NONE), np.arange(len(a))
        while len(at):
            code = a << 32 | b
            slot = np.searchsorted(self.merge_codes, code)
            ok = (self.merge_codes[slot] != code) | (self.merge_ids[slot] >= limit)
            fits[at[~ok]] = False
            right, left = self.right[a], self.left[b]
            undo_a = (right != a) & ((a > b) | (left == b))
            go = ok & (undo_a | (left != b))
            limit = np.where(undo_a, a, b + 1)[go]
            a, b, at = np.where(undo_a, right, a)[go], np.where(undo_a, b, left)[go], at[go]
        return fits

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        slot_of = lambda x: (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        slot = slot_of(code)
        fits, fresh = self.pair_fits[slot], self.pair_codes[slot] != code
        if fresh.any():
            kinds, back = np.unique(code[fresh], return_inverse=True)
            found = self._fit(kinds >> 32, kinds & 0xFFFFFFFF)
            fits[fresh] = found[back]
            slot = slot_of(kinds)
            self.pair_codes[slot], self.pair_fits[slot] = kinds, found
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, i in self.words.iter(piece.decode("latin-1")):  # of a start the longest comes last
            longest[end - len(self.bytes_of[i]) + 1] = i
        alive = bytearray(b"\x01") * (len(piece) + 1)
        made: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token >= 0:
                end = at + len(self.bytes_of[token])
                if alive[end] and (not made or self.compatible(made[-1], token)):
                    break
                token = int(self.shorter[token])
            if token < 0:
                alive[at] = 0
                token = made.pop()
                at -= len(self.bytes_of[token])
                token = int(self.shorter[token])
            else:
                made.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
        return made

    def _matches(self, pieces: list[bytes], longest_only: bool) -> tuple[np.ndarray, ...]:
        """(start of each piece, its bytes, start and token of each match) in the pieces of UTF-8, with a place between any two.
        ``longest_only``: from left to right, each behind the one before; else those of three bytes and more by their ends, the
        others before them."""
        raw = b"\xff".join(pieces)
        text = raw.decode("latin-1").replace("\xff", "\u0100")  # no token has such a character
        found = self.words.iter_long(text) if longest_only else self.long.iter(text)
        end, token = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T  # one by one: a list of all would be much to collect
        at = end - self.size[token] + 1
        if not longest_only:
            codes = np.frombuffer(raw, np.uint8).astype(np.int64)
            pair = self.two[codes[:-1] << 8 | codes[1:]]
            short = self.one[codes]
            short[:-1] = np.where((pair >= 0) & (codes[1:] != 0xFF), pair, short[:-1])
            at, token = np.append(np.arange(len(codes)), at), np.append(short, token)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.cumsum(size + 1) - size - 1, size, at, token

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many of them each piece has) of pieces of UTF-8."""
        if not (self.plain and pieces):
            made = [self.encode_piece(p) for p in pieces]
            return np.array([t for m in made for t in m], np.int32), np.array([len(m) for m in made], np.int64)
        start, size, at, token = self._matches(pieces, longest_only=True)
        owner = np.searchsorted(start, at, side="right") - 1
        open_ = np.bincount(owner, weights=self.size[token], minlength=len(pieces)) != size
        next_to = np.flatnonzero(owner[1:] == owner[:-1])
        fits = self.all_compatible(token[next_to], token[next_to + 1])
        open_[owner[next_to[~fits]]] = True
        left = np.flatnonzero(open_)
        if len(left):
            at2, token2 = self._back_and_forth([pieces[i] for i in left.tolist()], start[left])
            keep = ~open_[owner]
            at, token = np.append(at[keep], at2), np.append(token[keep], token2)
            order = np.argsort(at)
            at, token = at[order], token[order]
        bounds = np.append(np.searchsorted(at, start), len(at))
        return token.astype(np.int32), np.diff(bounds)

    def _back_and_forth(self, pieces: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode_piece`` of pieces at ``place``, a step of each at a time: (place, token). The last few go on alone."""
        start, size, begin, token = self._matches(pieces, longest_only=False)
        stop = start + size
        n = int(stop[-1]) + 1
        longest, accepted, back, alive = np.full(n, -1), np.full(n, -1), np.full(n, -1), np.ones(n, bool)
        longest[begin] = token  # of a start the longest comes last
        now, at, token, before = np.arange(len(pieces)), start.copy(), longest[start], np.full(len(pieces), -1)
        while len(now) > _FEW:
            some = token >= 0
            end = at + self.size[token] * some
            ok = some & alive[end]
            check = np.flatnonzero(ok & (before >= 0))
            ok[check] = self.all_compatible(before[check], token[check])
            dead = np.flatnonzero(~some)
            accepted[at[ok]], back[end[ok]] = token[ok], at[ok]
            alive[at[dead]] = False
            at[dead] = back[at[dead]]
            new = np.where(ok, longest[end], self.shorter[token])
            new[dead] = self.shorter[accepted[at[dead]]]
            before = np.where(ok, token, before)
            first = at[dead] == start[now[dead]]
            before[dead] = np.where(first, -1, accepted[back[at[dead]]])
            at, token = np.where(ok, end, at), new
            on = at < stop[now]
            now, at, token, before = now[on], at[on], token[on], before[on]
        done = np.ones(len(pieces), bool)
        done[now] = False
        places, tokens = [], []
        at, shift, to = start[done], (place - start)[done], stop[done]
        while len(at):
            token = accepted[at]
            places.append(at + shift)
            tokens.append(token)
            at = at + self.size[token]
            on = at < to
            at, shift, to = at[on], shift[on], to[on]
        for i in now.tolist():
            token = np.array(self.encode_piece(pieces[i]), np.int64)
            places.append(place[i] + np.cumsum(self.size[token]) - self.size[token])
            tokens.append(token)
        return np.concatenate(places), np.concatenate(tokens)

    def _learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many each has) of words not known yet."""
        led, alone = [i for i, k in enumerate(fresh) if k[0] != " "], [i for i, k in enumerate(fresh) if k[0] == " "]
        # a piece never goes on over a space that a word follows, so many words are one text
        pieces = self.find(" " + " ".join([fresh[i] for i in led])) if led else []
        upto = np.cumsum([len(fresh[i]) + 1 for i in led])
        owner = np.array(led, np.int64)[np.searchsorted(upto, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))]
        own = [self.find(fresh[i][1:]) for i in alone]
        pieces += chain.from_iterable(own)
        owner = np.append(owner, np.repeat(np.array(alone, np.int64), list(map(len, own))))
        number: defaultdict[str, int] = defaultdict(count().__next__)
        which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        tokens, size = self.encode_pieces([p.encode("utf-8", "replace") for p in number])
        order = np.argsort(owner, kind="stable")
        which, owner = which[order], owner[order]
        length = np.bincount(owner, weights=size[which], minlength=len(fresh)).astype(np.int64)
        return tokens[ragged((np.cumsum(size) - size)[which], size[which])], length

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, one after the other; where each text's begin, and the end of all)."""
        words, n = [], []
        for t in texts:
            if _ODD.search(t):
                own = [p[1:] if len(p) > 1 and p[0] == " " and not p[1].isspace() else " " + p for p in self.find(t)]
            else:
                own = t.split(" ")
                own[0] = " " + own[0]
            words += own
            n.append(len(own))
        ids, size = self.words_known.of(words)
        return ids, np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n, dtype=np.int64))]

    def encode(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space."""
        return " ".join(map(str, self.encode_texts([text])[0].tolist()))

    def spell(self, ids: np.ndarray, bounds: np.ndarray, decimal: bool = False) -> pa.BinaryArray:
        """The bytes that the ids of each text stand for, or the ids in ``decimal`` with a space behind each."""
        made = (self.decimal if decimal else self.spelled).take(pa.array(ids))
        ends = np.frombuffer(made.buffers()[1], np.int32)[: len(ids) + 1]
        return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds].tobytes()), made.buffers()[2]])

    def decode(self, ids: str) -> bytes:
        return b"".join([self.bytes_of[int(i)] for i in ids.split(" ")]) if ids else b""


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of about _AT_ONCE characters at most; null: empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= _AT_ONCE or i == len(texts) - 1:
            yield at, held
            at, held, size = i + 1, [], 0


def encode_documents(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in ``keep``, ids (array), n_tokens, decoded (binary) for each row of ``docs``. A column of ``keep``
    named like one of these, in any case, gives way to it.

    ``vocabulary``: path of a rank file that every executor can open; the public package's by default. Null or empty
    text: no ids, no bytes. Rows are independent: repeated rows and null ids pass as they are, other columns are left out, an
    empty table gives none, and a very long piece takes time in proportion to its length."""
    return _encoded(docs, vocabulary, keep, texts=True)


def _encoded(docs: DataFrame, vocabulary: str | None, keep: tuple[str, ...], texts: bool) -> DataFrame:
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    keep = tuple(c for c in keep if c.lower() not in MADE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            names = [n for n in batch.schema.names if n != "text"]
            for at, part in _slices(batch.column(at_text)):
                ids, bounds = codec.encode_texts(part)
                decoded = codec.spell(ids, bounds)
                made = {n: batch.column(n).slice(at, len(part)) for n in names} | {"n_tokens": pa.array(np.diff(bounds))}
                if texts:
                    made |= {"ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), "decoded": decoded}
                else:
                    numbers = [x.as_buffer() for x in codec.spell(ids, bounds, decimal=True)]
                    made["ids_sha256"] = pa.array([hashlib.sha256(memoryview(x)[: max(0, x.size - 1)]).hexdigest() for x in numbers])
                    made["decoded_sha256"] = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded])
                yield pa.RecordBatch.from_pydict(made)

    rows = docs.select("doc_id", *keep, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*fields, "n_tokens long", *(["ids array<int>", "decoded binary"] if texts else ["ids_sha256 string", "decoded_sha256 string"])]))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(table(spark, sf_dir, "documents"), None, (), texts=False)
