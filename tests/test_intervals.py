import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veloframe.operators.intervals import gaps, islands, periods, single_days


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    p, g = [], []
    for k, v in by.items():
        v.sort()
        cur = [*v[0], 0]
        for s, e in v:
            if s > cur[1]:
                p.append((k, *cur))
                g.append((k, cur[1], s))
                cur = [s, e, 1]
            else:
                cur = [cur[0], max(cur[1], e), cur[2] + 1]
        p.append((k, *cur))
    order = lambda r: (r[0] is None, str(r[0]), *r[1:])
    return sorted(p, key=order), sorted(g, key=order)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "k string, s long, e long, start_ns string, _pid int, n_rows int")
    lab = islands(df, ["k"], "s", "e")
    order = lambda r: (r[0] is None, str(r[0]), *r[1:])
    return sorted(map(tuple, periods(lab, ["k"]).collect()), key=order), sorted(map(tuple, gaps(lab, ["k"]).collect()), key=order)


def test_hot_key_over_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None, ""]), s := rng.randrange(3000), s + rng.choice([0, 1, 2, 3, 40, -4])) for _ in range(900)]
    rows += rows[:50] + [("a", None, 3), ("a", 3, None), ("hot", 0, 10**15)]
    assert run(spark, rows) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.sampled_from(["h", "i", None]), st.integers(0, 40), st.integers(0, 44)), max_size=60))
def test_any_rows(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_days(spark):
    df = spark.createDataFrame([(1, "WkEnd"), (2, None), (3, "Mon"), (4, "never"), (5, "wkday"), (6, "")], "i int, open_day string")
    got = {}
    for r in single_days(df).collect():
        got.setdefault(r.i, []).append(r.open_day)
    assert got == {1: ["sat", "sun"], 2: ["mon", "tue", "wed", "thu", "fri", "sat", "sun"], 3: ["mon"], 5: ["mon", "tue", "wed", "thu", "fri"]}
