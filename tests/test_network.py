import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenario import links, nodes
from veloframe.operators import network, planops, routing, transit


def random_network(spark, seed, n=60, m=110):
    rng = random.Random(seed)
    ns = [(f"n{i:02d}", rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(n)]
    ls = [(f"l{i:03d}", rng.choice(ns)[0], rng.choice(ns)[0], rng.uniform(1, 100), rng.choice([5.0, 10.0]), 1000.0, 1.0, ["car"]) for i in range(m)]
    return ns, ls, spark.createDataFrame(ns, "id string, x double, y double"), spark.createDataFrame(ls, links(spark).schema)


def floyd(ns, ls):
    at = {x[0]: i for i, x in enumerate(ns)}
    d = np.full((len(ns), len(ns)), np.inf)
    np.fill_diagonal(d, 0)
    for x in ls:
        d[at[x[1]], at[x[2]]] = min(d[at[x[1]], at[x[2]]], x[3] / x[4])
    for k in range(len(ns)):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return at, d


def test_searches_agree(spark):
    for seed in (1, 2):
        ns, ls, n, l = random_network(spark, seed)  # noqa: E741
        at, d = floyd(ns, ls)
        g = routing.build_graph(n, l, "car")
        cost = routing.free_cost(g)
        routing.prepare_landmarks(g, routing.choose_landmarks(g, 4), cost)
        g.core = routing.dead_end_nodes(g)
        for x in ls[:25]:
            for y in ls[:25]:
                want = d[at[x[2]], at[y[1]]] if x[0] != y[0] else 0.0
                for alt in (True, False):
                    p = routing.path(g, x[0], y[0], 0.0, cost, alt)
                    assert (p is None) == np.isinf(want) and (p is None or p[2] == pytest.approx(want))
        src = ls[0][2]
        got = {r.node: r.cost for r in network.relaxed_costs(l.select("from_node", "to_node", (F.col("length_m") / F.col("freespeed")).alias("cost")), spark.createDataFrame([(src,)], "node string")).collect()}
        assert got == pytest.approx({x[0]: d[at[src], at[x[0]]] for x in ns if np.isfinite(d[at[src], at[x[0]]])})


def test_dead_ends_components_hops(spark):
    ns, ls, n, l = random_network(spark, 3, m=62)  # noqa: E741
    near = {x[0]: set() for x in ns}
    for x in ls:
        if x[1] != x[2]:
            near[x[1]].add(x[2])
            near[x[2]].add(x[1])
    core = set(near)
    while drop := {x for x in core if len(near[x] & core) < 2}:
        core -= drop
    assert {r.node for r in network.dead_ends(n, l).collect()} == set(near) - core
    g = routing.build_graph(n, l)
    assert {x for x, dead in zip(g.nodes, routing.dead_end_nodes(g), strict=True) if dead} == set(near) - core
    seen, comp = set(), {}
    for x in sorted(near):
        todo = [x]
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                comp[u] = x
                todo += near[u]
    assert {r.node: r.component for r in network.components(n, l).collect()} == comp
    hops, front, k = {"n00": 0}, ["n00"], 0
    while front:
        k += 1
        front = sorted({v for u in front for v in near[u]} - set(hops))
        hops |= dict.fromkeys(front, k)
    assert {r.node: r.hops for r in network.hop_distances(n, l, spark.createDataFrame([("n00",)], "node string")).collect()} == hops


def test_time_dependent_costs_and_requests(spark):
    g = routing.build_graph(nodes(spark), links(spark), "car")
    slow = routing.observed_cost(g, {g.link("rise"): [100.0, 300.0]}, 900.0)
    assert slow(g.link("rise"), 10.0)[0] == 100 and slow(g.link("rise"), 5000.0)[0] == 300 and routing.observed_cost(g, {g.link("rise"): [100.0]}, 900.0, 2.0)(g.link("rise"), 0.0)[0] == 300
    q = spark.createDataFrame([("x", "quay", "loop", 0.0), ("same", "rise", "rise", 0.0), ("return", "loop", "quay", 0.0), ("unknown", "zz", "quay", 0.0), ("none", None, "quay", 0.0)], "request string, from_link string, to_link string, dep_s double")
    got = {r.request: (r.links, r.travel_s, r.distance_m) for r in routing.least_cost_paths(q, g).collect()}
    assert got == {"x": (["quay", "rise", "loop"], 130.0, 1000.0), "same": (["rise"], 0.0, 0.0), "return": (None, None, None), "unknown": (None, None, None), "none": (None, None, None)}
    with pytest.raises(ValueError):
        routing.routed_by_mode(q.withColumn("mode", F.lit("fly")), {"walk": lambda df: df})


def test_edits_partitions_routes(spark):
    n, l, bad = network.edited(nodes(spark), links(spark), add_links=links(spark).limit(1), drop_nodes=spark.createDataFrame([("fork",)], "id string"))  # noqa: E741
    assert {r.id for r in l.collect()} == {"quay", "rise"} and {(r.kind, r.id) for r in bad.collect()} == {("repeated link", "quay")}
    parts = network.partitions(nodes(spark), 2)
    assert sorted(r["count"] for r in parts.groupBy("partition_no").count().collect()) == [1, 4]
    got = network.partition_rest(nodes(spark), links(spark), parts.filter("node <> 'hill'"), ["car"])
    assert {r.node: r.partition_no for r in got.collect()}["hill"] == {r.node: r.partition_no for r in parts.collect()}["fork"]
    r = spark.createDataFrame([("one", ["quay"]), ("all", ["quay", "rise", "loop"]), ("gap", ["quay", "loop"]), ("odd", ["quay", "zz"])], "route_id string, links array<string>")
    assert {x.route_id: x.distance for x in network.route_distance(r, links(spark)).collect()} == {"one": 0.0, "all": 1000.0, "gap": 400.0, "odd": None}
    assert {x.route_id: x.distance for x in network.route_distance(r, links(spark), from_position=F.lit(0.25), to_position=F.lit(0.5)).collect()}["all"] == 375 + 600 + 200
    assert {x.route_id: x.valid for x in network.connected(r, links(spark), mode="bike").collect()} == {"one": True, "all": False, "gap": False, "odd": False}


def test_plan_operators(spark):
    E = "person string, plan_idx int, elem_idx int, kind string, act_type string, end_ns long, max_dur_ns long, mode string, routing_mode string, trav_ns long, route_trav_ns long"
    rows = [("home", 100, None), ("L", 5, None), ("x interaction", None, 2), ("L", None, None), ("work", None, 7), ("shop", None, 3), ("L", 4, 9), ("home", None, None)]
    el = spark.createDataFrame([("p", 0, i, "leg" if t == "L" else "act", None if t == "L" else t, None if t == "L" else a, None if t == "L" else b, "car" if t == "L" else None, None, a if t == "L" else None, b if t == "L" else None) for i, (t, a, b) in enumerate(rows)], E)
    assert [tuple(r)[2:] for r in planops.trip_spans(el).orderBy("trip").collect()] == [(1, 0, 4), (3, 5, 7)]
    assert [r.at_ns for r in planops.plan_times(el).orderBy("elem_idx").collect()] == [100, 105, 107, None, None, None, None, None]
    fixed = planops.plan_times(el.withColumn("end_ns", F.when(F.col("elem_idx") == 4, 200).otherwise(F.col("end_ns")).cast("long")))
    assert [r.at_ns for r in fixed.orderBy("elem_idx").collect()][4:] == [200, 203, 212, None]
    assert [(r.trip, r.departure_ns) for r in planops.departures(el).orderBy("trip").collect()] == [(1, 100), (3, None)]
    span = planops.trip_spans(el).filter("trip = 1")
    new = spark.createDataFrame([("p", 0, 0, 0, "leg", "walk"), ("p", 0, 0, 1, "leg", "car")], "person string, plan_idx int, origin_idx int, pos int, kind string, mode string")
    assert [r["mode"] or r.act_type for r in planops.spliced(el, span, new).orderBy("elem_idx").collect()] == ["home", "walk", "car", "work", "shop", "car", "home"]


def test_transit_tables(spark):
    stops = spark.createDataFrame([("L", "R", 0, "s1", None, 0), ("L", "R", 1, "s2", 100, 130), ("L", "R", 2, "s3", 200, None)], "line string, route string, pos int, facility string, arr_ns long, dep_ns long")
    dep = spark.createDataFrame([("L", "R", "d2", 1000, "v"), ("L", "R", "d1", 0, "v"), ("L", "R", "d3", 1000, "w")], "line string, route string, id string, dep_ns long, vehicle string")
    assert {r.id: r.sequence for r in transit.sequences(dep).collect()} == {"d1": 0, "d2": 1, "d3": 2}
    assert {r.id: (r.vehicle, r.copied_from) for r in transit.own_vehicles(dep).collect()} == {"d1": ("v_L_R_d1", "v"), "d2": ("v_L_R_d2", "v"), "d3": ("w", None)}
    t = transit.timetable(dep, stops)
    late = transit.delayed(t, F.when(F.col("pos") == 0, F.lit(50)).otherwise(0).cast("long"))
    assert [r.delay_ns for r in late.filter("departure = 'd1'").orderBy("pos").collect()] == [50, 20, 20]
    w = spark.createDataFrame([("x", "s2", "s3", None, 140), ("y", "s3", "s1", None, 0), ("z", "s1", "s3", "Q", 0)], "agent string, stop string, egress string, line string, time_ns long")
    assert [tuple(r) for r in transit.boardings(w, t).collect()] == [("x", "L", "R", "d2", 1130)]
    rides = spark.createDataFrame([("r", "L", "R", "quay", "loop"), ("s", "L", "R", "rise", "rise")], "ride string, line string, route string, access_link string, egress_link string")
    routes = spark.createDataFrame([("L", "R", ["quay", "rise", "loop"])], "line string, route string, links array<string>")
    assert {r.ride: r.distance for r in transit.ride_distance(rides, routes, links(spark)).collect()} == {"r": 1000.0, "s": 0.0}
    fac = spark.createDataFrame([("s1", "quay"), ("s2", None)], "id string, link string")
    assert {(r.kind, r.what) for r in transit.schedule_errors(stops, fac, dep, routes).collect()} == {("stop without link", "s2"), ("unknown stop", "s3")}
