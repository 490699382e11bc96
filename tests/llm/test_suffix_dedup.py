import hashlib
import random
from collections import Counter

import pytest

from ledgerloom.llm import suffix_dedup


def brute(texts, t, words=False):
    raw = [(x or "").encode().split() if words else (x or "").encode() for x in texts]
    raw = [tuple(r) for r in raw] if words else raw
    times = Counter(r[i : i + t] for r in raw for i in range(len(r) - t + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - t + 1):
            if times[r[i : i + t]] > 1:
                gone[i : i + t] = b"\x01" * t
        out.append(gone)
    return raw, out


def texts(seed, n, t):
    rnd = random.Random(seed)
    make = lambda k: "".join(rnd.choice("abcdefgh é\n") for _ in range(k))
    shared = [make(t // 2), make(t + 3), make(3 * t), make(t)]
    out = [None, "", "short", "x" * (t + 40), "xy" * t, "xy" * t + "z"]
    for _ in range(n):
        parts = [make(rnd.randrange(0, 2 * t))]
        for _ in range(rnd.randrange(0, 4)):
            parts += [rnd.choice(shared), make(rnd.randrange(0, t))]
        out.append("".join(parts))
    out += [out[8], out[9][:-5] + "Q" + out[9][-4:]]
    return out


@pytest.mark.parametrize("seed,t", [(1, 40), (2, 400), (3, 64)])
def test_matches_brute_force(spark, seed, t):
    rows = list(enumerate(texts(seed, 40, t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw, gone = brute([x for _, x in rows], t)
    got = {r.doc_id: suffix_dedup._listed(r.spans, len(raw[r.doc_id]), t) for r in suffix_dedup.with_spans(df, t, ("doc_id", "text")).collect()}
    for i, _ in rows:
        mask = bytearray(len(raw[i]))
        for s, e in got[i]:
            mask[s:e] = b"\x01" * (e - s)
        assert mask == gone[i], i


def test_query(spark, tmp_path):
    rows = list(enumerate(texts(5, 20, 400)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    raw, gone = brute([x for _, x in rows], 400)
    for i, _ in rows:
        kept = bytes(b for b, g in zip(raw[i], gone[i]) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw[i]), sum(gone[i]), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == sum(g and (k == 0 or not gone[i][k - 1]) for k, g in enumerate(gone[i]))


@pytest.mark.parametrize("seed,t", [(1, 5), (2, 51)])
def test_words_match_brute_force(spark, seed, t):
    rnd = random.Random(seed)
    make = lambda k: [rnd.choice(["a", "bb", "ccc", "d\u00e9"]) + str(rnd.randrange(40)) for _ in range(k)]
    shared = [make(t - 1), make(t), make(t + 9)]
    made = [None, "", " \n ", "one two", " ".join(["x"] * (t + 3))]
    for _ in range(30):
        words = make(rnd.randrange(2 * t))
        for _ in range(rnd.randrange(3)):
            words += rnd.choice(shared) + make(rnd.randrange(t))
        made.append(rnd.choice(["", " "]) + rnd.choice([" ", "\n\t"]).join(words))
    made += [made[8], "one two"]
    rows = list(enumerate(made))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw, gone = brute(made, t, words=True)
    got = {r.doc_id: r for r in suffix_dedup.with_spans(df, t, ("doc_id", "text"), words=True).collect()}
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, t, words=True).collect()}
    for i, text in rows:
        mask = bytearray(len(raw[i]))
        for s, e in suffix_dedup._listed(got[i].spans, len(raw[i]), t):
            mask[s:e] = b"\x01" * (e - s)
        assert mask == gone[i], i
        assert (cut[i].text or "").encode().split() == [w for w, g in zip(raw[i], gone[i]) if not g]
        assert cut[i].text == text or any(gone[i])


def test_chunks_of_a_long_text(spark, monkeypatch):
    x = suffix_dedup.coded(("abcdefg hij" * 30 + "".join(random.Random(3).choices("abc", k=900))).encode(), False)[0]
    whole = suffix_dedup.anchors(x, 40, 20)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 97)
    parts = suffix_dedup.anchors(x, 40, 20)
    at = lambda runs: {p: (h, a) for h, a, s, e in zip(*runs) for p in range(s, e + 1)}
    assert {p: a for p, (_, a) in at(parts).items()} == {p: a for p, (_, a) in at(whole).items()}


def test_copies_cost_no_more_than_themselves(spark):
    """Spans of a text do not grow with its copies, of one id, of null ids or of different ones."""
    text = "".join(random.Random(9).choices("abcdefgh", k=1500))
    for n in (4, 64):
        df = spark.createDataFrame([(1 if i % 2 else None, text) for i in range(n)], "doc_id long, text string")
        found = suffix_dedup.repeated_spans(df).collect()
        assert len(found) == 1 and len(found[0].spans) == 1
        assert [r.n_removed for r in suffix_dedup.remove_repeats(df).collect()] == [1500] * n


def test_texts_stay_whole_characters(spark):
    shared = "äöü" * 300
    df = spark.createDataFrame([(1, "ã" + shared + "end", "x", 1, 2), (2, "å" + shared + "fin", "y", 1, 2), (None, None, None, 1, 2)], "doc_id long, text string, N_removed string, spans int, k1 int")
    got = suffix_dedup.remove_repeats(df).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].text == "ãend" and by[2].text == "åfin" and by[None].text is None
    assert by[1].n_removed == 1800 and by[1].spans == 1 and by[1].k1 == 2 and len(got[0]) == 5
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_windows_that_do_not_fit_a_run_are_refused(spark):
    import pytest

    with pytest.raises(ValueError, match="threshold"):
        suffix_dedup.repeated_spans(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 1 << 16)
