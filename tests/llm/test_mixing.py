import random

from veloframe.llm.mixing import budgets, mix, mix_report


def run(spark, rows, targets, **kw):
    counts = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, n_tokens long, id string")
    t = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    chosen, plan = mix(counts, t, "doc_id", **kw)
    return chosen, plan, mix_report(counts, chosen, t)


def test_shares_and_limits(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 10 + ["mid"] * 3 + ["small", "other", None]), rng.randrange(0, 60)) for i in range(3000)]
    targets = [("big", 50.0, 1), ("mid", 30.0, 2), ("small", 20.0, 3), ("absent", 10.0, 2), ("none", 0.0, 5)]
    chosen, plan, report = run(spark, rows, targets)
    got = chosen.collect()
    size = {i: n for i, _, n in rows}
    by = {}
    for r in got:
        assert r.n_tokens == size[r.doc_id] > 0
        by.setdefault(r.source, []).append(r)
    assert set(by) == {"big", "mid", "small"} and len({r.doc_id for r in got}) == len(got)
    limit = {s: k for s, _, k in targets}
    total = sum(r.repeats * r.n_tokens for r in got)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        used = sum(r.repeats * r.n_tokens for r in by[s])
        assert max(r.repeats for r in by[s]) <= limit[s] and max(r.repeats for r in by[s]) - min(r.repeats for r in by[s]) <= 1
        assert abs(used - plan[s]["budget"]) <= 30 and abs(used / total - share) < 0.01  # half a document at most
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "mid", "small", "other", None, "absent", "none"} and rep["other"].chosen_tokens == 0 and rep["absent"].n_docs == 0
    again = {(r.doc_id, r.repeats) for r in run(spark, rows, targets)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in got}


def test_budgets():
    plan = budgets([("a", 1.0, 1), ("b", 1.0, 4), ("c", 2.0, 0)], {"a": 100, "b": 30})
    assert plan["a"]["budget"] == 100 and plan["b"] == {"share": 0.5, "budget": 100.0, "whole": 3, "rest": 10.0} and plan["c"]["budget"] == 0
    plan = budgets([("a", 1.0, 1), ("b", 1.0, 2)], {"a": 100, "b": 30}, total=400.0)
    assert plan["a"]["budget"] == 100 and plan["b"]["whole"] == 2 and plan["b"]["rest"] == 0.0


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1.0, 1)])[0].count() == 0
    assert run(spark, [(1, "a", 5)], [])[0].count() == 0
    assert run(spark, [(1, "a", 0), (2, "a", None)], [("a", 1.0, 1)])[0].count() == 0
