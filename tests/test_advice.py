import pytest

from ledgerloom.operators import advice


def plain(kind, figures):
    """The rules one by one."""
    out = []
    for rule_set, rule, conditions, priority, *_ in advice.RULES:
        if rule_set == kind and all((v := figures.get(m)) is not None and (over is None or v > over) and (to is None or v <= to) and (least is None or v >= least) and (under is None or v < under) for m, (over, to, least, under) in conditions.items()):
            out.append((-advice.PRIORITIES[priority], rule))
    return [r for _, r in sorted(out)]


CASES = {
    "ab_test": [{"significant": s, "lift_pct": lift, "sample_size": n} for s in (0.0, 1.0) for lift in (-5.0, 0.0, 10.0, 10.1) for n in (999.0, 1000.0)],
    "cohort": [{"retention_1": a, "retention_6": b, "churn_rate": c} for a in (49.9, 50.0) for b in (None, 0.0, 19.0, 20.0) for c in (50.0, 50.1)],
    "campaign": [{"roi": r, "cac": c, "yoy_change": y} for r in (1.9, 2.0, 5.0, 5.1, float("nan")) for c in (None, 100.0, 101.0) for y in (None, -10.0, -11.0)],
}


@pytest.mark.parametrize("kind", list(CASES))
def test_every_bound(spark, kind):
    rows = [(i, m, v) for i, figures in enumerate(CASES[kind]) for m, v in figures.items()]
    got = {}
    for r in advice.recommend(spark.createDataFrame(rows, "id int, metric string, value double"), kind, "id").collect():
        got.setdefault(r.id, []).append((r.place, r.rule))
    for i, figures in enumerate(CASES[kind]):
        want = plain(kind, {k: v for k, v in figures.items() if v is not None and v == v})
        assert [r for _, r in sorted(got.get(i, []))] == want and [p for p, _ in sorted(got.get(i, []))] == list(range(1, len(want) + 1)), figures


def test_texts(spark):
    r = advice.recommend(spark.createDataFrame([("x", "roi", 1.25), ("x", "cac", 120.456)], "subject string, metric string, value double"), "campaign").orderBy("place").collect()
    assert [(x.rule, x.description, len(x.action_items) > 2) for x in r] == [("low_roi", "returns of 1.3", True), ("costly_customers", "120.46 a customer", True)]
    assert advice.recommend(spark.createDataFrame([], "subject string, metric string, value double"), "campaign").collect() == []
