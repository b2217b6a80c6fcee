import bisect
import math
import random

import pytest

from veloframe.llm import quantiles
from veloframe.llm.quantiles import code, code_range, merge, percentiles, sketch
from pyspark.sql import functions as F

POINTS = [0.01, 0.5, 0.9, 0.99, 1.0]


def test_codes_keep_order_and_contain_their_values(spark):
    rng = random.Random(1)
    v = sorted({*range(-3000, 3000, 7), *(s * (2**k + d) for s in (1, -1) for k in range(62) for d in (-1, 0, 1)), 2**63 - 1, -(2**63), *(rng.randrange(-(2**62), 2**62) for _ in range(200))})
    got = [(r.v, r.c) for r in spark.createDataFrame([(x,) for x in v], "v long").select("v", code(F.col("v")).alias("c")).orderBy("v").collect()]
    assert [c for _, c in got] == sorted(c for _, c in got) and 0 <= got[0][1] and got[-1][1] < 1 << quantiles.BITS
    for x, c in got:
        lo, hi = code_range(c)
        assert lo <= x <= hi and (hi - lo) <= abs(x) / 1024


def data(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        g = rng.choice(["hot"] * 7 + ["b", None, ""])
        out.append((g, rng.randrange(3), rng.choice([None, 0, int(rng.lognormvariate(12, 3)), int(rng.lognormvariate(12, 3)), -5, 2**60])))
    return out + [("const", 0, 7)] * 50 + [("lone", 1, 123456789)] + [("nulls", 1, None)] * 3


@pytest.mark.parametrize("sparse", [0, 200, 8192])
def test_bounds_hold_for_merged_days(spark, monkeypatch, sparse):
    monkeypatch.setattr(quantiles, "SPARSE", sparse)
    rows = data(sparse, 6000)
    df = spark.createDataFrame(rows, "g string, day int, v long")
    days = sketch(df, ["g", "day"], "v")
    got = percentiles(merge(days, ["g"]), ["g"], POINTS).collect()
    by = {}
    for g, _, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert {(r.g, r.q) for r in got} == {(g, q) for g in by for q in POINTS}
    for r in got:
        v = sorted(by[r.g])
        exact = v[max(1, math.ceil(r.q * len(v) - 1e-9)) - 1]
        assert r.n == len(v) and r.lower <= exact <= r.upper
        low, high = code_range_of(r.estimate)
        rank = bisect.bisect_left(v, low), bisect.bisect_right(v, high)
        assert rank[0] - r.rank_error - 1 <= r.q * len(v) <= rank[1] + r.rank_error + 1
        assert r.rank_error <= 0.35 * len(v) + 200


def test_bound_says_something_at_the_tail(spark):
    """A constant group, and days of far more codes than are kept, half of them one value."""
    wide = spark.range(120_000).selectExpr("'wide' as g", "cast(id % 3 as int) as day", "case when rand(5) < 0.5 then 7 else cast(pow(2.0D, 11 + 36 * rand(6)) as bigint) end as v")
    df = wide.unionByName(spark.range(3000).selectExpr("'const' as g", "0 as day", "123456789L as v")).cache()
    days = sketch(df, ["g", "day"], "v")
    assert days.filter("cell >= 0").count() > 0
    exact = {}
    for r in df.collect():
        exact.setdefault(r.g, []).append(r.v)
    for r in percentiles(merge(days, ["g"]), ["g"], [0.3, 0.75, 0.9, 0.99]).collect():
        v = sorted(exact[r.g])
        assert r.rank_error <= 0.004 * r.n and r.lower <= v[math.ceil(r.q * len(v) - 1e-9) - 1] <= r.upper
        assert r.upper < v[-1] if r.g == "wide" else (r.rank_error == 0 and r.upper - r.lower <= 123456789 / 1024)


def code_range_of(v):
    width = max(abs(v) // 1024, 1)
    return v - width, v + width


def test_deletion_gives_the_sketch_of_the_rest(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SPARSE", 0)
    df = spark.createDataFrame(data(9, 2000), "g string, day int, v long")
    all_ = sketch(df, ["g"], "v").unionByName(sketch(df.filter("day = 1"), ["g"], "v", sign=-1))
    rest = {tuple(r) for r in sketch(df.filter("day <> 1"), ["g"], "v").collect()}
    assert {tuple(r) for r in merge(all_, ["g"]).collect()} == rest


def test_empty(spark):
    e = sketch(spark.createDataFrame([], "g string, v long, cell int, n int"), ["g"], "v")
    assert percentiles(merge(e, ["g"]), ["g"], POINTS).count() == 0
