from ledgerloom.llm import decontaminate as dc

ITEM = "Alice has 3 apples and Bob has 5 apples, how many apples does Alice give to Bob after 2 hours?"


def leaks(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame(list(docs), "doc_id long, text string, item_id string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in dc.find_leaks(d, b).collect()}


def test_copies_and_new_parameters(spark):
    got = leaks(spark, [
        (1, f"Before. {ITEM} After", ""), (2, "In class Carol has 7 apples and Dan has 9 apples, how many apples does Carol give to Dan after 4 days?", ""),
        (3, "Here Carol has 7 apples and Dan has 9 apples, how many apples does Eve give to Fred after 4 days?", ""), (4, None, ""), (5, "", ""), (6, "apples and oranges are fruit", ""), (None, ITEM, ""),
    ])
    assert got[1, 1].exact and got[1, 1].share == 1
    assert not got[2, 1].exact and got[2, 1].share > 0.5
    assert {d for d, _ in got} == {1, 2}


def test_repeated_rows_short_items_and_empty_tables(spark):
    got = leaks(spark, [(1, "x ab cd ef gh y", ""), (1, "x ab cd ef gh y", "")], [(2, "ab cd ef gh"), (2, "ab cd ef gh"), (3, "ab cd"), (5, "cd ab"), (None, ITEM), (4, None)])
    assert set(got) == {(1, 2), (1, 3)} and got[1, 2].n_windows == 1
    assert leaks(spark, []) == {} and leaks(spark, [(1, ITEM, "")], []) == {}


def test_a_document_may_hold_an_item_twice(spark):
    got = leaks(spark, [(1, f"{ITEM} And then. {ITEM.replace('Alice', 'Zoe').replace('3', '8')}", "")])
    assert got[1, 1].exact


def sequences(text):
    """Of a text the three sequences of (token, values, place), by plain loops."""
    tokens, place = ["\n", *dc._TOKEN.findall(text or "")], 0
    literal, made = [], ([], [])
    for i, t in enumerate(tokens):
        kind, before = dc._kind(t), dc._kind(tokens[i - 1]) if i else dc._BREAK
        if kind == dc._BREAK:
            continue
        cap, first = kind == dc._CAPITAL, before == dc._BREAK
        slot = "number" if kind == dc._NUMBER else "unit" if kind == dc._SIGN or (kind == dc._UNIT and before == dc._NUMBER) else "name" if cap and not first else None
        literal.append((t.lower(), [t.lower()] if slot else [], place, False))
        for k, out in enumerate(made):
            if cap and not first and (k or dc._kind(tokens[i - 1]) == dc._CAPITAL) and dc._kind(tokens[i - 1]) == dc._CAPITAL and out and out[-1][0] == "<name>":
                out[-1][1][0] = t.lower()
            elif slot or (k and cap):
                out.append((f"<{slot or 'name'}>", [t.lower()], place, cap and first))
            else:
                out.append((t.lower(), [], place, cap and first))
        place += 1
    return literal, *made


def plain_windows(text, n):
    out = []
    for kind, seq in enumerate(sequences(text)):
        for p in range(len(seq) - n + 1):
            w = seq[p : p + n]
            vals = tuple(v for x in w for v in x[1])
            if kind and (n < dc.TEMPLATE or 2 * sum(x[0][0] == "<" for x in w) > n or (kind == 2 and not any(x[3] for x in w))):
                continue
            out.append(((kind > 0, tuple(x[0] for x in w)), w[0][2], kind, vals))
    return out


def brute(docs, items):
    """{doc_id: [item_id]}: every window of every item held against every window of every document."""
    got = {i: [] for i, _ in docs}
    for item, text in items:
        size = len(sequences(text)[0])
        n = min(dc.WINDOW, size)
        own = plain_windows(text, n) if n else []
        by = {}
        for w in own:
            by.setdefault(w[0], []).append(w)
        n_plain, n_made = sum(w[2] == 0 for w in own), len({w[1] for w in own if w[2]})
        for doc, body in docs:
            met = [(ip, dp, kind, iv, iv if dk == 0 else dv) for key, dp, dk, dv in plain_windows(body, n) for _, ip, kind, iv in by.get(key, [])] if n else []
            met.sort(key=lambda w: w[1] - w[0])
            parts = []
            for w in met:
                if parts and (w[1] - w[0]) - (parts[-1][-1][1] - parts[-1][-1][0]) <= size:
                    parts[-1].append(w)
                else:
                    parts.append([w])
            for part in parts:
                votes = {}
                for w in part:
                    for pair in set(zip(w[3], w[4])):
                        votes[pair] = votes.get(pair, 0) + 1

                def sole(pair, votes=votes):
                    for side in (0, 1):
                        rivals = [n for p, n in votes.items() if p[side] == pair[side] and p != pair]
                        if rivals and 3 * max(rivals) > votes[pair]:
                            return False
                    return True

                good = [w for w in part if w[2] == 0 or all(map(sole, zip(w[3], w[4])))]
                if not good:
                    continue
                at = sorted({w[0] for w in good})
                runs, start = [], at[0]
                for a, b in zip(at, at[1:] + [10**9]):
                    if b - a > dc.STEP:
                        runs.append(a - start + n)
                        start = b
                shares = [len({w[0] for w in good if w[2] == 0}) / n_plain, len({w[0] for w in good if w[2]}) / n_made if n_made else 0]
                if (max(shares) >= dc.SHARE or max(runs) >= dc.RUN_TOKENS) and item not in got[doc]:
                    got[doc].append(item)
    return got


def test_whole_tables_by_brute_force(spark):
    """Whole tables of the test data and documents with items under other names and numbers: no document differs."""
    import re

    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(docs, items)
    got = {r.doc_id: r.items for r in dc.op4_decontaminate(spark, d).collect()}
    assert {i: sorted(x) for i, x in want.items()} == got
    words = {i: " ".join(re.findall(r"\w+", t.lower())) for i, t in items}
    for i, text in docs:  # and every document that holds an item's words in full is among them
        own = f" {' '.join(re.findall(r'\w+', (text or '').lower()))} "
        assert all(k in got[i] for k, w in words.items() if f" {w} " in own)
    items += [(1000, ITEM), (1001, "Mary Ann Lee pays 3 euros. Tom pays 4 euros. Who of Mary Ann Lee and Tom pays more, and how much more?"), (1002, "Go now"), (1003, "zebra")]
    more = [(i, re.sub(r"\d+", str(i), t).replace("Alice", ["Zoe", "Bob", "Ann Lou"][i % 3]).replace("Tom", "Al B") + [" zebra", " go now", ""][i % 3]) for i, (_, t) in enumerate(items)]
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for r in dc.find_leaks(spark.createDataFrame(more, "doc_id long, text string"), b).collect():
        found.setdefault(r.doc_id, []).append(r.item_id)
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in brute(more, items).items() if x}


def test_names_short_items_and_single_bad_slots(spark):
    got = leaks(spark, [
        (1, "Carol has 7 red apples.", ""), (2, "We ask: Mary Ann has 7 red apples.", ""), (3, "He asked What is the capital of France? and left", ""), (4, "it is so, Red Fox", ""),
        (5, "Compute 3 12 45 77 and 9 now 81 5", ""),
    ], [(1, "Alice has 3 red apples."), (2, "What is the capital of France?"), (3, "red fox"), (4, "Compute 3 12 45 77 and 9 now 81 5")])
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)}
    assert not got[1, 1].exact and got[5, 4].exact
    # one slot that is filled otherwise takes its windows out, not the whole passage
    other = ITEM.replace("after 2 hours", "after 9 hours").replace("Alice give", "Zed give")
    found = leaks(spark, [(1, f"Before. {other}", "")])
    assert found[1, 1].share >= 0.5 and not found[1, 1].exact


def test_boilerplate_is_judged_beside_other_windows(spark, monkeypatch):
    monkeypatch.setattr(dc, "OWN_ITEMS", 3)
    common = "choose the right answer among these four and explain it in one short sentence of yours"
    items = [(i, f"{common} {' '.join(f'q{i}w{k}' * 2 for k in range(9))}") for i in range(6)] + [(9, common)]
    got = leaks(spark, [(i, t, "") for i, t in items[:2]] + [(7, f"please {common}", "")], items)
    assert set(got) == {(0, 0), (1, 1), (0, 9), (1, 9), (7, 9)} and got[0, 0].share == 1


def test_items_full_of_slots(spark):
    sums, row = "What is 12 + 35 + 47 + 58?", "What number comes next in 2, 4, 6, 8, 10, 12, 14, 16"
    got = leaks(spark, [(1, f"Now. {sums} Yes", ""), (2, f"He asks: {row}", ""), (3, "What is 13 + 35 + 47 + 58?", ""), (4, row.replace("2, 4, 6, 8", "1, 3, 5, 7"), "")], [(1, sums), (2, row)])
    assert got[1, 1].exact and got[1, 1].share == 1
    assert got[2, 2].exact and got[2, 2].n_windows == 8 and got[2, 2].share == 1
    assert (3, 1) not in got and not got[4, 2].exact


def test_windows_of_many_items_find_them_alone(spark, monkeypatch, tmp_path):
    """Items of one template, and items that begin alike: documents with only what over OWN_ITEMS of them share are found by all rows of the query."""
    monkeypatch.setattr(dc, "OWN_ITEMS", 3)
    common = "choose the right answer among these four and explain it in one short sentence of yours"
    tail = "kappa lambda sigma omega theta gamma delta epsilon zeta iota".split()
    items = [(i, ITEM.replace("3", str(i + 10)).replace("5", str(i + 30))) for i in range(6)]
    items += [(i + 10, f"{common} {' '.join(t + 'abcdef'[i] for t in tail)}") for i in range(6)]
    docs = [(1, ITEM.replace("Alice", "Carol").replace("3", "7").replace("5", "9")), (2, f"please {common}"), (3, common[:40]), (4, items[7][1]), (5, "nothing of it")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.items for r in dc.op4_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {i: sorted(x) for i, x in brute(docs, items).items()}
    assert got[1] == list(range(6)) and got[2] == list(range(10, 16)) and not got[3] and not got[5]


def test_reading_hashes_a_token_once(monkeypatch):
    """A token is hashed and judged when it is first seen, and never put in a set of a batch's tokens; kinds are by the same rules."""
    judged = []
    plain = dc._kind
    monkeypatch.setattr(dc, "_kind", lambda t: (judged.append(t), plain(t))[1])
    reader = dc.Reader()
    tokens = ["cm", "Word", "word", "3.5", "²a", "$", ".", "NASA", "word", "cm", "字"]
    h, k = reader.of(tokens)
    assert k.tolist() == [dc._UNIT, dc._CAPITAL, dc._LOWER, dc._NUMBER, dc._NUMBER, dc._SIGN, dc._BREAK, dc._LOWER, dc._LOWER, dc._UNIT, dc._LOWER]
    again, _ = reader.of(["word", "Word", "cm", "new"])
    assert again[0] == again[1] == h[2] == h[1] and again[2] == h[0]
    assert judged == [*dict.fromkeys(tokens), "new"]  # in order of first sight: from one pass over the tokens
