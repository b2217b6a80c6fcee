import math
import random

from veloframe.operators import dualtree
import pytest

from veloframe.operators.dualtree import containing_regions, located, near_counts, near_pairs, nearest_segment


def brute(rows, r):
    pts = {(i, x, y) for i, x, y in rows if i is not None and x is not None and y is not None and math.isfinite(x) and math.isfinite(y) and not (x == 0 and y == 0)}
    return sorted({(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) <= r * r})


def pairs(spark, rows, r):
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], "id string, x double, y double, level string, n int")
    return sorted(map(tuple, near_pairs(df, "id", "x", "y", r).collect()))


def test_uneven_density(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "LEAF_PAIRS", 16)
    monkeypatch.setattr(dualtree, "CHUNK", 5)
    rng = random.Random(2)
    rows = [(f"p{i}", rng.gauss(500, 30), rng.gauss(-300, 30)) for i in range(120)] + [(f"q{i}", rng.uniform(-9e4, 9e4), rng.uniform(-9e4, 9e4)) for i in range(60)]
    rows += [("s1", 100.0, 100.0), ("s2", 130.0, 140.0), ("s3", 130.0, 140.0000001), ("z", 0.0, 0.0), ("n", None, 1.0), ("m", math.nan, 1.0), (None, 100.0, 100.0), ("i", math.inf, 2.0)]
    rows += [(f"d{i}", 7.0, 7.0) for i in range(30)] + rows[:9] + [("s1", 9000.0, 9000.0), ("q0", 9000.0, 9001.0)]
    got = pairs(spark, rows, 50.0)
    assert got == brute(rows, 50.0) and ("s1", "s2") in got and ("s1", "s3") not in got


@pytest.mark.parametrize("radius", [0.0, 0.5, 50.0])
def test_many_points_on_one_spot(spark, monkeypatch, radius):
    """A hundredth of the points, and more around them, without a pair being written out in the counts; far coordinates share a cell."""
    monkeypatch.setattr(dualtree, "LEAF_PAIRS", 64)
    monkeypatch.setattr(dualtree, "CHUNK", 8)
    rng = random.Random(6)
    rows = [(f"h{i:03d}", 500.25, 500.25) for i in range(60)] + [(f"n{i:03d}", 500.25 + rng.uniform(-30, 30), 500.25 + rng.uniform(-30, 30)) for i in range(60)]
    rows += [(f"w{i:03d}", rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for i in range(200)] + [("far", 1e300, -1e300), ("far2", 1e300, -1e300), ("z", 0.0, 0.0), (None, 500.25, 500.25), ("n", None, 1.0)]
    want = brute(rows, radius)
    assert pairs(spark, rows, radius) == want
    n = {i: 0 for i, x, y in rows if i is not None and x is not None and (x, y) != (0.0, 0.0)}
    for p in want:
        for i in p:
            n[i] += 1
    df = spark.createDataFrame([(*x, "e", 1, "p") for x in rows + rows[:9]], "id string, x double, y double, level string, w int, place string")
    got = near_counts(df, "id", "x", "y", radius)
    assert {r.id: r.n_near for r in got.collect()} == n and got.filter("id = 'h000'").first().place == "500.25,500.25"


def test_empty_and_single(spark):
    assert pairs(spark, [], 50.0) == [] and pairs(spark, [], 0.0) == []
    assert pairs(spark, [("a", 1.0, 1.0)], 50.0) == []
    df = spark.createDataFrame([("a", 1.0, 1.0)], "id string, x double, y double")
    assert [(r.id, r.n_near) for r in near_counts(df, "id", "x", "y", 5.0).collect()] == [("a", 0)] and near_counts(df.filter("false"), "id", "x", "y", 5.0).count() == 0
    with pytest.raises(ValueError, match="radius"):
        near_pairs(df, "id", "x", "y", -1.0)


def test_regions(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "LEAF_PAIRS", 32)
    monkeypatch.setattr(dualtree, "CHUNK", 8)
    rng = random.Random(8)
    shapes = {"box": [[(0, 0), (900, 0), (900, 700), (0, 700)]], "ring": [[(100, 100), (800, 100), (800, 600), (100, 600)], [(300, 300), (500, 300), (500, 400), (300, 400)]], "star": [[(500 + (400 if k % 2 else 150) * math.cos(k * math.pi / 9), 350 + (400 if k % 2 else 150) * math.sin(k * math.pi / 9)) for k in range(18)]], "away": [[(1e6, 1e6), (1e6 + 1, 1e6), (1e6, 1e6 + 1)]]}
    edges = [(r, *map(float, (*p, *q))) for r, rings in shapes.items() for ring in rings for p, q in zip(ring, ring[1:] + ring[:1])]
    pts = [(f"p{i}", rng.uniform(-100, 1000), rng.uniform(-100, 800)) for i in range(150)] + [(f"d{i}", 510.0 + i / 1e3, 350.0) for i in range(90)] + [("no", None, 1.0), ("zero", 0.0, 0.0), (None, 400.0, 350.0), ("corner", 900.0, 700.0), ("edge", 100.0, 200.0)]

    def within(x, y, r):
        hits = [e for e in edges if e[0] == r and (e[2] > y) != (e[4] > y) and x < e[1] + (y - e[2]) / (e[4] - e[2]) * (e[3] - e[1])]
        return len(hits) % 2 == 1

    want = sorted((i, r) for i, x, y in pts if i is not None and x is not None and i != "zero" for r in shapes if within(x, y, r))
    P, E = "id string, x double, y double, region string, level int", "region string, x0 double, y0 double, x1 double, y1 double, id int"
    p = spark.createDataFrame([(*x, "r", 1) for x in pts + pts[:5]], P)
    e = spark.createDataFrame([(*x, 1) for x in edges + edges[:3]] + [(None, 0.0, 0.0, 9.0, 9.0, 1), ("bad", None, 1.0, 1.0, 1.0, 1), ("nan", math.nan, 1.0, 1.0, 1.0, 1)], E)
    assert sorted(map(tuple, containing_regions(p, e).collect())) == want
    assert ("p0", "away") not in want and ("edge", "ring") in want and ("corner", "box") not in want
    assert containing_regions(p.filter("false"), e).count() == 0 and containing_regions(p, e.filter("false")).count() == 0


@pytest.mark.parametrize(("leaf", "chunk"), [(2048, 2048), (24, 5)])
def test_nearest_segment(spark, monkeypatch, leaf, chunk):
    monkeypatch.setattr(dualtree, "LEAF_PAIRS", leaf)
    monkeypatch.setattr(dualtree, "CHUNK", chunk)
    rng = random.Random(4)
    seg = [(f"l{i}", x := rng.uniform(0, 20000), y := rng.uniform(0, 20000), x + rng.uniform(-9000, 9000), y + rng.uniform(-300, 300)) for i in range(40)]
    seg += [("k0", *seg[0][1:]), ("dot", 5.0, 5.0, 5.0, 5.0), ("bad", None, 1.0, 1.0, 1.0), seg[3]]
    pts = [(f"p{i}", rng.uniform(-500, 21000), rng.uniform(-500, 21000)) for i in range(60)] + [("mid", (seg[0][1] + seg[0][3]) / 2, (seg[0][2] + seg[0][4]) / 2), ("no", None, 2.0)]
    pts += [(f"d{i}", 9000.0 + i / 7, 9000.0) for i in range(40)]  # a dense place
    seg += [(f"e{i}", 9000.0, 9010.0 + i, 9003.0, 9010.0 + i) for i in range(30)]

    def dist(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        l2 = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / l2)) if l2 > 0 else 0.0
        px, py = s[1] + t * dx, s[2] + t * dy
        return math.sqrt((p[1] - px) * (p[1] - px) + (p[2] - py) * (p[2] - py))

    ok = [s for s in seg if s[1] is not None]
    want = {p[0]: min((dist(p, s), s[0]) for s in ok) for p in pts if p[1] is not None}
    got = nearest_segment(spark.createDataFrame(pts, "id string, x double, y double"), spark.createDataFrame(seg, "id string, x0 double, y0 double, x1 double, y1 double"))
    assert {r.id: (r.distance, r.segment) for r in got.collect()} == want
    assert want["mid"][1] == "k0"
    none = spark.createDataFrame([], "id string, x0 double, y0 double, x1 double, y1 double")
    assert nearest_segment(located(spark.createDataFrame(pts, "id string, x double, y double"), "id", "x", "y"), none).count() == 0
