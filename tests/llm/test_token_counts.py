import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import token_counts

PATH = public_tokenizers.path(token_counts.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def of_library(library, texts):
    return [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]


def some_texts():
    rnd = random.Random(3)
    texts = ["", " ", "\n\n \t x", "Hello  world\n\n\tHow're you?", "naïve café — ÆØÅ 漢字 🙂🙂", "x1y2 3.14159 'll 'LL  ", "\u0000\u0007  wide  　 a"]
    texts += ["<|endoftext|>", "a <|endoftext|><|endoftext|>  b <|endoftex|>", " <|endoftext|> "]
    texts += ["a" * n for n in (2, 3, 4, 5, 7, 255, 256, 257, 5000)] + ["=-" * 900, "Qüark" * 300, " " * 3000, "ab" * 4001 + "a"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 1200), rnd.randrange(0x3000, 0xA000), 10])) for _ in range(200)) for _ in range(50)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(1, 900))) for _ in range(200)]
    return texts


def test_same_as_library(library):
    texts = some_texts()
    assert token_counts.counter_of(PATH).count(texts) == of_library(library, texts)


def test_every_character_as_library(library):
    signs = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}a" for c in signs[i : i + 5000]) for i in range(0, len(signs), 5000)]
    assert token_counts.counter_of(PATH).count(texts) == of_library(library, texts)


def test_both_ways_of_merging_agree():
    counter, rnd = token_counts.TokenCounter(PATH), random.Random(5)
    pieces = ["".join(rnd.choice("aab etn") for _ in range(rnd.randrange(1, 300))).encode() for _ in range(300)]
    sizes = token_counts.np.array([len(p) for p in pieces])
    symbols = counter.of_byte[token_counts.np.frombuffer(b"".join(pieces), token_counts.np.uint8)]
    assert (counter.by_rounds(symbols.copy(), sizes) == counter.by_rank(symbols.copy(), sizes)).all()


def test_slices_and_memory(library, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", 7)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    texts = some_texts()
    assert token_counts.TokenCounter(PATH).count(texts) == of_library(library, texts)


def test_very_long_piece(library):
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    assert token_counts.counter_of(PATH).count([text]) == of_library(library, [text])


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "ab ab", 6), (2, "ab ab", 6), (None, "c", 7), (4, "", 8)], "doc_id long, text string, N_Tokens int")
    got = token_counts.count_tokens(df, limit=1).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.text) == [(0, "c", 1, 1, False), (2, "ab ab", 5, 2, True), (2, "ab ab", 5, 2, True)]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got if not r.text) == [(1, 0, 0, False), (4, 0, 0, False)]
    assert token_counts.count_tokens(df.limit(0)).collect() == []


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = dict(zip(docs, of_library(library, list(docs.values())), strict=True))
    got = token_counts.op13_token_counts(spark, d).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(docs[i].encode()), n, n > 1024) for i, n in want.items()}
