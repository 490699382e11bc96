from collections import Counter

import corpus_pipeline as cp
from test_near_sets import brute as brute_groups

D = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], D)
        if name != cp.STAGES[-1][0]:
            assert sorted(out.columns) == sorted(cp.COLUMNS)
        seen.append(out.cache())
    rows = [d.count() for d in seen]
    assert rows[0] > rows[1] > rows[2] >= rows[3] > rows[4] == rows[5]
    toxic = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in seen[1].collect()}
    assert len(toxic & kept) < 0.5 * len(toxic) and rows[1] > 0.8 * rows[0]
    from ledgerloom.llm import decontaminate

    comp = brute_groups([(r.doc_id, r.text) for r in seen[1].collect()])
    assert {r.doc_id for r in seen[2].collect()} == {i for i, c in comp.items() if i == c}
    before = {r.doc_id: r.text.split() for r in seen[2].collect()}
    times = Counter(tuple(w[i : i + 51]) for w in before.values() for i in range(len(w) - 50))
    left = {r.doc_id: r.text.split() for r in seen[3].collect()}
    for i, w in before.items():  # every word in a passage of 51 words that stands elsewhere too, and no other
        gone = [False] * len(w)
        for k in range(len(w) - 50):
            if times[tuple(w[k : k + 51])] > 1:
                gone[k : k + 51] = [True] * 51
        assert left.get(i, []) == [x for x, g in zip(w, gone) if not g], i
    leaks = {r.doc_id for r in decontaminate.find_leaks(seen[3], spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in seen[4].collect()} == {r.doc_id for r in seen[3].collect()} - leaks
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    assert all(r.text == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in seen[5].collect())


def test_null_and_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "one two three four five", "en", "s", 23), (3, "one two three four five", "en", "s", 23)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never seen in any text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in docs.collect()) == [(0, 3), (1, 0), (3, 5)]


def test_ids_with_several_texts_and_a_short_passage(spark):
    """Two texts of one doc_id are two documents, in any order; null ids are checked for benchmark items."""
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long, "b"), (1, long + " x", "a"), (1, "quite another text of nine words in all here", "a"), (1, long, "a"), (2, long.upper(), "a"), (None, long, "a")]
    docs = spark.createDataFrame([(i, t, s, s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text.lower()[-6:], r.lang) for r in cp.simhash(spark, docs, "").collect())
    assert len(got) == 3 and got[0][0] == 0
    assert {g[:2] for g in got} in ({(0, "28 w29"), (1, "l here"), (1, "28 w29")}, {(0, "28 w29"), (1, "l here"), (1, " w29 x")})
    passage = " ".join(f"s{i}" for i in range(51))  # 193 bytes
    docs = spark.createDataFrame([(i, f"only{i} here {passage} and there{i}", "en", "s", 9) for i in range(3)], docs.schema)
    assert [r.text.split()[:2] for r in sorted(cp.suffix_array(spark, docs, "").collect(), key=lambda r: r.doc_id)] == [[f"only{i}", f"there{i}"] for i in range(3)]
    assert all(passage not in r.text for r in cp.suffix_array(spark, docs, "").collect())
