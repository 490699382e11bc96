from ledgerloom.llm import url_filter as uf


def judged(spark, urls):
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)]
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(uf.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")).collect(), key=lambda r: r.page_id)]


def test_rules_and_vocabulary(spark):
    got = judged(spark, [
        "http://WWW.Example.com/en/700?x#y", "http://a.com/en/8", "https://a.net/de/9", "http://example.net/de/85", "http://x.org/es/", "http://badcom/en/1",
        None, "", "no scheme", "http://host", "http://host#f/en/", "http://casino.site/a", "http://casinos.site/a", "http://free.site/win?click", "http://free.site/free", "http://h/PORN",
    ])
    assert got == [
        ("www.example.com", "/en/700", "example.com/en/7", "allow"), ("a.com", "/en/8", "com/en/", "block"), ("a.net", "/de/9", "net/de/", "allow"),
        ("example.net", "/de/85", "example.net/de/8", "block"), ("x.org", "/es/", "org/es/", "block"), ("badcom", "/en/1", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("host", "", None, "allow"), ("host", "", None, "allow"),
        ("casino.site", "/a", None, "block"), ("casinos.site", "/a", None, "allow"), ("free.site", "/win", None, "block"), ("free.site", "/free", None, "allow"), ("h", "/PORN", None, "block"),
    ]


def test_empty_table(spark):
    assert judged(spark, []) == []


def test_vocabulary_from_a_table_long_urls_and_repeated_rows(spark):
    terms = spark.createDataFrame([("Bad", "strict", None), ("a-b", "soft", 0.75), ("b", "soft", 0.5), ("b", "soft", 0.25), ("", "strict", 1.0), (None, "soft", 1.0)], "term string, kind string, weight double")
    urls = ["http://a-b/b", "http://a-b/", "http://\u00e9bad.x/", "http://bad2.x/", "http://x/" + "q/" * 200_000 + "bad", "http://a-b/b"]
    rows = spark.createDataFrame([(1, u) for u in urls], "page_id long, url string")
    got = [(r.verdict, r.n_strict, r.n_soft, r.soft_weight) for r in uf.judge_urls(rows, (), terms, 1.25).collect()]
    # "b" stands in "a-b" too, between boundaries
    assert sorted(got) == sorted([("block", 0, 2, 1.25)] * 3 + [("block", 1, 0, 0.0)] * 2 + [("allow", 0, 0, 0.0)])
    assert {r.verdict for r in uf.judge_urls(rows, (), ()).collect()} == {"allow"}


def test_one_soft_term_rejects_nothing_alone(spark):
    terms = (("loan", "soft", 5.0), ("win", "soft", 0.1))
    rows = spark.createDataFrame([(1, "http://loan.x/loan"), (2, "http://loan.x/win")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.n_soft) for r in uf.judge_urls(rows, (), terms, 2.0).collect()} == {1: ("allow", 1), 2: ("block", 2)}
