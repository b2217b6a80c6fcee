"""Operators that must not slow down with the length of a queue or the depth of a network."""

import random

from veloframe.operators import network, transit


def test_hops_of_a_deep_network_take_few_jobs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(network, "materialize", lambda df, name="table", f=network.materialize: written.append(name) or f(df, name))
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("n00", "n20"), ("x", "y"), ("n05", "n05")]
    links = spark.createDataFrame(chain, "from_node string, to_node string")
    start = spark.createDataFrame([("n00",), ("zz",)], "node string")
    want = {f"n{i:02d}": min(i, abs(i - 20) + 1) for i in range(41)} | {"zz": 0}
    assert {r.node: r.hops for r in network.hop_distances(links, links, start).collect()} == want and len(written) <= 3
    assert {r.node: r.hops for r in network.hop_distances(links, links, start, directed=True).collect()} == {f"n{i:02d}": i if i < 20 else i - 19 for i in range(41)} | {"zz": 0}
    assert network.hop_distances(links, links, spark.createDataFrame([(None,)], "node string")).collect() == [(None, 0)]
    monkeypatch.setattr(network, "MOST_EDGES", 0)
    short = links.filter("from_node <= 'n03' or from_node >= 'x'")
    assert {r.node: r.hops for r in network.hop_distances(short, short, start).collect()} == {"n00": 0, "n01": 1, "n02": 2, "n03": 3, "n04": 4, "n20": 1, "zz": 0}


def test_boardings_look_back_and_over_slices(spark, capsys):
    r = random.Random(1)
    hour = 3600 * 10**9
    calls = [(f"L{k % 3}", "R", f"d{k:02d}", pos, f"s{(pos + k) % 3}", None, t + pos) for k in range(30) for t in [r.choice([0, 1, 5, 30]) * hour + r.randint(0, 3)] for pos in range(3)]
    waits = [(i, f"s{r.randint(0, 2)}", f"s{r.randint(0, 3)}", r.choice([None, "L0", "L1"]), r.choice([0, 1, 5, 30]) * hour + r.randint(-3, 5)) for i in range(120)]
    got = transit.boardings(spark.createDataFrame(waits, "agent int, stop string, egress string, line string, time_ns long"), spark.createDataFrame(calls, "line string, route string, departure string, pos int, facility string, arr_ns long, dep_ns long"))
    want = {}
    for a, stop, egress, line, t in waits:
        fit = [(c[6], c[0], c[1], c[2]) for c in calls if c[4] == stop and c[6] >= t and line in (None, c[0]) and any(d[2] == c[2] and d[3] > c[3] and d[4] == egress for d in calls)]
        if fit:
            want[a] = min(fit)
    assert 30 < len(want) < 120 and {x.agent: (x.boarding_ns, x.line, x.route, x.departure) for x in got.collect()} == want
    got.explain(True)
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()  # such a frame is begun anew for every row
