import math
import random

import pytest
from pyspark.sql import functions as F

from veloframe.operators import selection as se

PLANS = "person string, plan_idx int, score double, selected boolean, msa_n int"


def plans(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], PLANS)


ROWS = [("a", 0, 5.0, False), ("a", 1, 7.0, True), ("a", 2, 7.0, False), ("b", 0, None, True), ("b", 1, -3.0, False), ("c", 0, math.nan, False), ("c", 1, 1.0, False), ("c", 2, 1.0, True), ("d", 0, 4.0, True), ("e", 0, None, True), ("f", 0, 1.0, True), ("f", 1, 1.0, True)]


def pick(df):
    return {r.person: r.plan_idx for r in df.collect()}


def test_selectors(spark):
    p = plans(spark, ROWS)
    assert pick(se.best(p)) == {"a": 2, "b": 1, "c": 0, "d": 0, "f": 1}
    assert pick(se.worst(p)) == {"a": 0, "b": 1, "c": 0, "d": 0, "e": 0, "f": 0}
    assert {r.person for r in se.selection_errors(p).collect()} == {"f"}
    assert pick(se.keep_selected(p.filter("person <> 'f'"))) == {"a": 1, "b": 0, "c": 2, "d": 0, "e": 0}
    assert pick(se.at_random(p, F.lit(0.999))) == {"a": 2, "b": 1, "c": 2, "d": 0, "e": 0, "f": 1}
    assert se.best(p.limit(0)).count() == 0


def test_memory_is_repeated_removal(spark):
    rng = random.Random(1)
    rows = []
    for k in range(30):
        n = rng.randrange(1, 9)
        s = rng.randrange(n)
        rows += [(f"p{k}", i, rng.choice([None, math.nan, 1.0, 2.0, 3.0]), i == s) for i in range(n)]
    want = set()
    for k in range(30):
        mine = [r for r in rows if r[0] == f"p{k}"]
        while len(mine) > 3:
            rank = lambda r: (r[3], -math.inf if r[2] is None or math.isnan(r[2]) else r[2], r[1])
            mine.remove(min(mine, key=rank))
        want |= {r[:2] for r in mine}
    assert {(r.person, r.plan_idx) for r in se.bounded(plans(spark, rows), 3).collect()} == want


def test_logit(spark):
    p = se.logit(plans(spark, ROWS), 1.0).collect()
    got = {(r.person, r.plan_idx): r.probability for r in p}
    assert got["a", 0] == pytest.approx(math.exp(-2) / (2 + math.exp(-2))) and got["b", 0] == 1 and got["b", 1] == 0 and got["c", 0] == 1 and got["e", 0] == 1
    assert {round(r.probability, 9) for r in se.logit(plans(spark, ROWS[:3]), 0).collect()} == {round(1 / 3, 9)}
    assert pick(se.by_logit(plans(spark, ROWS[:3]), F.lit(0.0))) == {"a": 0} and pick(se.by_logit(plans(spark, ROWS[:3]), F.lit(0.999))) == {"a": 2}


def test_strategies(spark):
    persons = spark.createDataFrame([("x", "s"), ("y", None), ("z", "t")], "person string, subpopulation string")
    w = spark.createDataFrame([("s", "ReRoute", 1.0), ("s", "BestScore", 1.0), (None, "ReRoute", 2.0), ("t", "BestScore", 0.0)], "subpopulation string, strategy string, weight double")
    at = lambda u, on=True: {r.person: r.strategy for r in se.strategies(persons, w, F.lit(u), on).collect()}
    assert at(0.4) == {"x": "BestScore", "y": "ReRoute"} and at(0.6) == {"x": "ReRoute", "y": "ReRoute"} and at(0.6, False) == {"x": "BestScore"}
    assert se.innovation_off(5, 0, 10, 0.5) and not se.innovation_off(4, 0, 10, 0.5) and se.innovation_off(0, 0, 0, 1.0)


def test_copies_and_averages(spark):
    p = plans(spark, ROWS[:5])
    c = se.copy_selected(p, spark.createDataFrame([("a",)], "person string"))
    assert {(r.person, r.plan_idx, r.score, r.selected) for r in c.collect()} == {("a", 0, 5.0, False), ("a", 1, 7.0, False), ("a", 2, 7.0, False), ("a", 3, None, True), ("b", 0, None, True), ("b", 1, -3.0, False)}
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "person string, score double")
    once = se.assign_scores(p, new, True)
    assert {(r.person, r.plan_idx): (r.score, r.msa_n) for r in once.filter("selected").collect()} == {("a", 1): (1.0, 1), ("b", 0): (2.0, 0)}
    twice = se.assign_scores(once, spark.createDataFrame([("a", 4.0)], "person string, score double"), True)
    assert {r.person: (r.score, r.msa_n) for r in twice.filter("selected").collect()} == {"a": (2.5, 2), "b": (2.0, 0)}
    assert se.averaging_start(0, 10, 0.8) == 8
