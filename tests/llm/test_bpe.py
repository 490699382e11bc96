import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from ledgerloom.llm import bpe


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello  world\n\n\tHow're you?", "naïve café — ÆØÅ 漢字 🙂🙂", "a" * 5000, "=-" * 900, "x1y2 3.14159 'll 'LL", "\u0000\u0007  wide", "Qüark" * 300]


def test_same_as_library(reference):
    codec = bpe.codec_of(public_tokenizers.path(bpe.VOCABULARY))
    rnd = random.Random(1)
    texts = TEXTS + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 1200), 10])) for _ in range(200)) for _ in range(50)]
    texts += ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(1, 80))) for _ in range(200)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == " ".join(map(str, reference.encode_ordinary(t)))
        assert codec.decode(ids) == t.encode()


def test_rows(spark, reference):
    df = spark.createDataFrame([(1, None, 5), (2, "ab ab", 6), (2, "ab ab", 6), (None, "c", 7)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(df).collect()
    assert len(got) == 4
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == 0 and by[1].ids == [] and bytes(by[1].decoded) == b""
    assert by[2].ids == reference.encode_ordinary("ab ab") and bytes(by[2].decoded) == b"ab ab"
    assert bpe.encode_documents(df.limit(0)).collect() == []


def test_query(spark, reference, tmp_path):
    spark.createDataFrame([(7, "Some text, twice: some text"), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op6_bpe(spark, str(tmp_path)).collect()}
    ids = reference.encode_ordinary("Some text, twice: some text")
    assert got[7].n_tokens == len(ids)
    assert got[7].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[7].decoded_sha256 == hashlib.sha256(b"Some text, twice: some text").hexdigest()
    assert got[8].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[8].n_tokens == 0


def test_kept_columns_give_way_to_made_ones(spark, reference):
    df = spark.createDataFrame([(1, "ab", "x", 2, "y", "z")], "doc_id long, text string, ids string, N_Tokens int, decoded string, lang string")
    got = bpe.encode_documents(df, keep=("ids", "N_Tokens", "decoded", "text", "doc_id", "lang")).collect()
    assert [(r.doc_id, r.lang, r.ids, r.n_tokens, bytes(r.decoded)) for r in got] == [(1, "z", reference.encode_ordinary("ab"), len(reference.encode_ordinary("ab")), b"ab")]


def _invented(n, seed):
    rnd = random.Random(seed)
    parts = ["ción", "the", "heit", "onre", "ll", "eau", "ñas", "é", "ou", "ich", "11", "qu", "Z", "漢"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 7))) for _ in range(n)]


def test_new_words_are_encoded_together(reference, monkeypatch):
    """Words never seen before are no work of their own each (F1: the pipeline's last stage did not end in time)."""
    monkeypatch.setattr(bpe, "REMEMBERED", 3_000)
    codec, alone = bpe.BytePairCodec(public_tokenizers.path(bpe.VOCABULARY)), []
    words = _invented(20_000, 3)
    one_by_one = codec.encode_piece
    monkeypatch.setattr(codec, "encode_piece", lambda p: alone.append(p) or one_by_one(p))
    for at in range(0, len(words), 2_000):
        texts = [" ".join(words[i : i + 100]) + "." for i in range(at, min(at + 4_000, len(words)), 100)]
        ids, bounds = codec.encode_texts(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [reference.encode_ordinary(t) for t in texts]
    assert len(alone) <= 10 * bpe._FEW and len(codec.words_known.known) < 3_000 + 4_000
    alone.clear()
    ids, bounds = codec.encode_texts(_invented(20_000, 4))
    assert len(alone) <= bpe._FEW
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [reference.encode_ordinary(t) for t in _invented(20_000, 4)]


def test_white_space_of_all_kinds(reference):
    codec = bpe.codec_of(public_tokenizers.path(bpe.VOCABULARY))
    spaces = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (chr(i).isspace() or codec.find(chr(i) * 2 + "a") == [chr(i), chr(i), "a"])]
    assert {" ", "\n", "\xa0", " ", "　"} <= set(spaces)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice([rnd.choice(spaces), " ", " ", "ab", "Ünd", ".", "'s", "12", "\x1c", "​"]) for _ in range(40)) for _ in range(600)]
    texts += ["  a", "a  ", "a ", " \n", "a \n b", "a\n b", "a\n\n b", " a", "Ā Ā", "ÿ ÿÿ", "a" * 3000 + " " + "=-" * 900]
    ids, bounds = codec.encode_texts(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [reference.encode_ordinary(t) for t in texts]
    assert codec.spell(ids, bounds).to_pylist() == [t.encode() for t in texts]
    assert codec.spell(ids, bounds, decimal=True).to_pylist() == ["".join(f"{i} " for i in reference.encode_ordinary(t)).encode() for t in texts]


def test_pairs_at_once_as_one_by_one(reference):
    codec = bpe.codec_of(public_tokenizers.path(bpe.VOCABULARY))
    rng = np.random.default_rng(6)
    known = np.array(sorted(codec.bytes_of))
    a, b = rng.choice(known[:3000], 4000), rng.choice(known, 4000)
    assert codec.all_compatible(a, b).tolist() == [codec.compatible(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_slices_of_a_batch(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "_AT_ONCE", 50)
    texts = pa.array([None, "x" * 60, "", "a b", None, "c d", "y" * 49, "z"])
    got = list(bpe._slices(texts))
    assert [t for _, part in got for t in part] == [t or "" for t in texts.to_pylist()]
    assert [at for at, _ in got] == [0, 2, 7] and list(bpe._slices(texts[:0])) == []
