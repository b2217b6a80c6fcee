import random

import pytest

from veloframe.operators import features
from veloframe.operators.features import feature_rows, feature_table, maintain, signed_deltas

SCHEMA = "seq long, iteration int, time_ns long, person string, act_type string, at long, n string, last string"
COLS = ["person", "act_type", "iteration", "time_ns"]


def make(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = rng.randrange(10)
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            r = (k, rng.randrange(3), rng.choice([None, *range(50)]), rng.choice(["hot", "hot", "p", "q", "", None]), rng.choice(["home", "work", None]), at, "n", "l")
            rows += [r] * rng.choice([1, 1, 2])
            at += rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows


def brute(rows):
    cur = {}
    for r in rows:
        if r[0] not in cur or r[5] > cur[r[0]][5]:
            cur[r[0]] = r
    out = {}
    for r in cur.values():
        n, last = out.get((r[3], r[4]), (0, None))
        when = (r[1], r[2]) if r[1] is not None and r[2] is not None else None
        out[r[3], r[4]] = (n + 1, max(x for x in (last, when) if x is not None) if last or when else None)
    return out


def state_of(df):
    return {(r.person, r.act_type): (r.n, tuple(r.last) if r["last"] is not None else None) for r in df.collect()}


@pytest.mark.parametrize(("seed", "hot"), [(1, None), (2, 3)])
def test_whole_log_and_batches(spark, monkeypatch, seed, hot):
    """hot: so many rows make an event hot."""
    if hot:
        monkeypatch.setattr(features, "HOT_ROWS", hot)
        monkeypatch.setattr(features, "HOT_SHARE", 10_000)
    for rows in (make(seed), make(seed + 10)):
        df = spark.createDataFrame(rows, SCHEMA)
        deltas = signed_deltas(df, "seq", "at", COLS).cache()
        args = (["person", "act_type"], "seq", ["iteration", "time_ns"])
        whole = maintain(None, deltas, deltas, *args)
        assert state_of(whole) == brute(rows)
        state = None
        for lo, hi in ((None, 4), (4, 9), (9, 99)):
            batch = deltas.filter(f"_at <= {hi}" + (f" and _at > {lo}" if lo else ""))
            state = maintain(state, batch, deltas.filter(f"_at <= {hi}"), *args)
        assert state_of(state) == brute(rows)


def test_hot_events(spark, monkeypatch):
    monkeypatch.setattr(features, "HOT_ROWS", 50)
    rows = make(7, 40) + [(999, 0, t % 7, "hot", "home", t // 3, "n", "l") for t in range(240)] + [(998, 0, 1, "hot", "home", None, "n", "l")] * 60
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(features.hot_keys(df, "seq")) == [998, 999]
    clean = [r if r[5] is not None else (*r[:5], -1, *r[6:]) for r in rows]
    want = sum(1 for _ in {(r[0], r[5]) for r in clean})
    deltas = signed_deltas(df, "seq", "at", COLS)
    assert deltas.filter("_sign = 1").count() == want and deltas.filter("_sign = -1").count() == want - len({r[0] for r in rows})


def test_wide_and_odd_values(spark):
    """Latest values of more bits than a long has, of a text, and totals."""
    big = 2**62
    rows = [("p", 1, -(2**31), -big, 2, 1), ("p", 2, 2**31 - 1, big, 3, 1), ("p", 2, 2**31 - 1, big, None, -1), ("q", 3, 5, None, 4, 1)]
    df = spark.createDataFrame(rows, "g string, seq long, i int, t long, v int, _sign int")
    got = {r.g: (r.n, tuple(r["last"]) if r["last"] else None, r.total_v) for r in maintain(None, df, df, ["g"], "seq", ["i", "t"], ("v",)).collect()}
    assert got == {"p": (1, (-(2**31), -big), 5), "q": (1, None, 4)}
    words = spark.createDataFrame([("p", 1, "a", 1), ("p", 2, "b", 1), ("p", 2, "b", -1)], "g string, seq long, w string, _sign int")
    assert [(r.n, r["last"].w) for r in maintain(None, words, words, ["g"], "seq", ["w"]).collect()] == [(1, "a")]


def test_tables(spark):
    rows = make(5, 30)
    deltas = signed_deltas(spark.createDataFrame(rows, SCHEMA), "seq", "at", COLS)
    state = maintain(None, deltas, deltas, ["person", "act_type"], "seq", ["iteration", "time_ns"])
    end = max(v[1] for v in brute(rows).values() if v[1])
    for r in feature_rows(state, "person", "act_type").collect():
        if r.last_time_ns is not None:
            assert r.distance_ns == (end[0] - r.last_iteration) * 86_400_000_000_000 + end[1] - r.last_time_ns
    table = {r.person: r for r in feature_table(state, "person", "act_type").collect()}
    assert set(table) == {p for p, _ in brute(rows)} - {None}
    for p, r in table.items():
        assert r.n_events == sum(v[0] for (q, _), v in brute(rows).items() if q == p) and r.n_kinds == len(r.features)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    deltas = signed_deltas(df, "seq", "at", COLS)
    state = maintain(None, deltas, deltas, ["person", "act_type"], "seq", ["iteration", "time_ns"])
    assert state.count() == 0 and feature_table(state, "person", "act_type").count() == 0
