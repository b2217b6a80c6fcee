import pytest
from pyspark.sql import functions as F

from scenario import LOG, NETWORK, P, POPULATION, ROUTE, V, VEHICLES, events, links, nodes
from veloframe.operators import events as ev
from veloframe.operators import mobsim, planops, prepare, routing
from veloframe.sources import xml

FIELDS = ["person", "link", "vehicle", "act_type", "leg_mode", "routing_mode", "network_mode", "mode", "distance", "relative_position"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("xml")
    for name, text in (("network", NETWORK), ("population", POPULATION), ("vehicles", VEHICLES)):
        (d / f"{name}.xml").write_text(text)
    return d


def test_scans(spark, files):
    n, l, cell = xml.network(spark, f"{files}/network.xml")  # noqa: E741
    assert cell == 7.5 and {(r.id, r.partition_no, r.weight) for r in n.collect()} == {("dock", 0, 1), ("mill", 1, 1), ("gate", 0, 1), ("fork", 0, 1), ("hill", 0, 1)}
    assert {r.id: r.modes for r in l.collect()} == {"quay": ["car", "bike"], "rise": ["car", "bike"], "loop": ["car"], "spur": ["car"], "back": ["bike"]}
    p = xml.population(spark, f"{files}/population.xml").orderBy("plan_idx", "elem_idx").collect()
    chosen = [r for r in p if r.person == P and r.plan_idx == 0]
    assert [r.kind for r in chosen] == ["act", "leg"] * 4 + ["act"] and chosen[5].links == ROUTE and chosen[5].vehicle == V and chosen[5].trav_ns is None and chosen[3].route_trav_ns == 30_000_000_000
    assert chosen[0].score == 7.25 and chosen[0].person_attributes == {"age": "33"} and {r.person for r in p} == {P, "rest"}
    assert {(r.person, r.subpopulation) for r in xml.persons(spark.createDataFrame(p, xml.population(spark, f"{files}/population.xml").schema)).collect()} == {(P, "person"), ("rest", "person")}
    t, v = xml.vehicles(spark, f"{files}/vehicles.xml")
    assert {(r.id, r.length, r.max_v, r.pce) for r in t.collect()} == {("car", 5.0, 33.0, 1.0), ("plain", 7.5, float("inf"), 1.0)} and [tuple(r) for r in v.collect()] == [(V, "car", 33.0, 1.0)]


def plan(spark, files):
    return xml.population(spark, f"{files}/population.xml").filter("selected").withColumn("scenario", F.lit("s"))


def test_more_links_or_vehicles_than_a_task_takes_are_an_error(spark, files, monkeypatch):
    monkeypatch.setattr(mobsim, "MOST_ELEMENTS", 10)
    fleet = lambda n: spark.range(n).selectExpr("cast(id as string) as vehicle", "1.0D as pce", "5.0D as max_v")
    assert mobsim.simulate(plan(spark, files), links(spark), fleet(10)).count() == len(LOG)
    with pytest.raises(ValueError, match="11 vehicles"):
        mobsim.simulate(plan(spark, files), links(spark), fleet(11))
    net = spark.range(11).selectExpr("cast(id as string) as id", "'p' as from_node", "'q' as to_node", "1.0D as length_m", "1.0D as freespeed", "1.0D as capacity", "1.0D as permlanes")
    with pytest.raises(ValueError, match="11 links"):
        mobsim.simulate(plan(spark, files), net)


def test_exact_log(spark, files):
    got = mobsim.simulate(plan(spark, files), links(spark))
    assert ev.difference(got.drop("x", "y"), events(spark), FIELDS).collect() == []
    assert ev.out_of_order(got).count() == 0


def test_many_scenarios_and_storage(spark, files):
    p = plan(spark, files)
    crowd = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumns({"person": F.concat(F.lit("q"), F.lpad(F.col("i").cast("string"), 3, "0")), "vehicle": F.when(F.col("vehicle").isNotNull(), F.concat(F.lit("w"), F.col("i").cast("string"))), "scenario": F.lit("crowd")}).drop("i")
    log = mobsim.simulate(p.unionByName(crowd), links(spark), settings=mobsim.Settings(sample=0.1)).cache()
    assert ev.difference(log.filter("scenario = 's'"), mobsim.simulate(p, links(spark), settings=mobsim.Settings(sample=0.1)), FIELDS).collect() == []
    out = [r.time_ns // 10**9 for r in log.filter("scenario = 'crowd' and type = 'left link' and link = 'rise'").orderBy("time_ns").collect()]
    assert len(out) == 60 and min(b - a for a, b in zip(out, out[1:])) >= 39  # the quay lets a car pass every 40 s
    assert log.filter("type = 'stuckAndAbort'").count() == 0
    inside = log.filter("scenario = 'crowd' and link = 'rise' and type in ('entered link', 'left link')").orderBy("seq").collect()
    load = most = 0
    for r in inside:
        load += 1 if r.type == "entered link" else -1
        most = max(most, load)
    assert most <= 600 / 7.5 * 0.1


def test_kinematic_waves_passing_and_stuck(spark, files):
    p = plan(spark, files)
    for s in (mobsim.Settings(kinematic=True), mobsim.Settings(passing=True)):
        assert ev.difference(mobsim.simulate(p, links(spark), settings=s), events(spark), FIELDS).collect() == []
    early = mobsim.simulate(p, links(spark), settings=mobsim.Settings(end_s=22300))
    last = early.orderBy(F.desc("seq")).first()
    assert (last.type, last.person, last.link, last.leg_mode, last.time_ns) == ("stuckAndAbort", P, "loop", "car", 22300 * 10**9)
    sleeping = mobsim.simulate(p, links(spark), settings=mobsim.Settings(end_s=100)).collect()
    assert [(r.type, r.link) for r in sleeping] == [("stuckAndAbort", None)]


def test_teleported_plans_need_no_kernel(spark, files):
    p = plan(spark, files).filter("elem_idx in (0, 1, 2, 3, 8)").withColumn("scenario", F.lit("t"))
    flat = p.withColumn("elem_idx", F.least("elem_idx", F.lit(4))).withColumn("plan_idx", F.lit(0))
    flat = flat.withColumn("end_ns", F.when(F.col("elem_idx") == 2, F.lit(20_000 * 10**9)).otherwise(F.col("end_ns")))  # over before it begins
    log = mobsim.simulate(flat.withColumn("max_dur_ns", F.lit(None).cast("long")), links(spark)).collect()
    want = sorted((r.time_ns, r.type) for r in log if r.type in ("departure", "arrival"))
    got = planops.teleport_schedule(flat).collect()
    assert sorted([(r.dep_ns, "departure") for r in got] + [(r.arr_ns, "arrival") for r in got]) == want


def test_prepared_plans(spark, files):
    """Without access legs and routes a trip is routed; the result can be simulated and is valid."""
    raw = plan(spark, files).filter("elem_idx in (2, 5, 8)").withColumn("elem_idx", ((F.col("elem_idx") - 2) / 3).cast("int")).withColumns({"links": F.lit(None).cast("array<string>"), "distance": F.lit(None).cast("double")})
    g = routing.build_graph(nodes(spark), links(spark), "car")
    ready = prepare.prepared(raw, links(spark), nodes(spark), g, ["car"])
    rows = ready.orderBy("elem_idx").collect()
    assert [r["mode"] or r.act_type for r in rows] == ["bakery", "walk", "car interaction", "car", "car interaction", "walk", "kiln"]
    assert rows[3].links == ROUTE and rows[3].distance == 1300 and rows[3].vehicle == f"{P}_car" and [rows[1].distance, rows[2].x, rows[2].y, rows[5].distance] == pytest.approx([13.0, 150, 200, 26.0])
    assert [r.valid for r in planops.trip_validity(ready, links(spark), ["car"]).collect()] == [True]
    log = mobsim.simulate(ready.withColumn("scenario", F.lit(0)), links(spark))
    assert log.filter("type = 'arrival'").count() == 3


def test_routes_that_cannot_go_on(spark, files):
    """Only the vehicle whose route is broken is taken out."""
    p = plan(spark, files)
    broken = lambda name, links_: p.withColumns({"person": F.lit(name), "vehicle": F.lit(None).cast("string"), "links": F.when(F.col("links").isNotNull(), F.array(*map(F.lit, links_)))})
    log = mobsim.simulate(p.unionByName(broken("gap", ["quay", "loop"])).unionByName(broken("odd", ["quay", "zz"])).unionByName(broken("lost", ["zz", "rise"])), links(spark), settings=mobsim.Settings(sample=1.0)).cache()
    got = {r.person: (r.link, r.leg_mode) for r in log.filter("type = 'stuckAndAbort'").collect()}
    assert got == {"gap": ("quay", "car"), "odd": ("quay", "car"), "lost": ("zz", "car")}
    assert log.filter(F.col("person") == P).filter("type = 'arrival'").count() == 4


def transit_tables(spark, n=3, gap=60):
    df = spark.createDataFrame
    ns = 10**9
    return {
        "departures": df([("L", "R", f"d{i}", (100 + gap * i) * ns, "bus") for i in range(n)], "line string, route string, id string, dep_ns long, vehicle string"),
        "routes": df([("L", "R", "train", ROUTE[:3])], "line string, route string, mode string, links array<string>"),
        "route_stops": df([("L", "R", 0, "s1", None, 0), ("L", "R", 1, "s2", 50 * ns, 70 * ns), ("L", "R", 2, "s3", 100 * ns, None)], "line string, route string, pos int, facility string, arr_ns long, dep_ns long"),
        "stop_facilities": df([("s1", "quay"), ("s2", "rise"), ("s3", "loop")], "id string, link string"),
    }


def rider(name, egress, at, line="L"):
    leg = dict(person=name, elem_idx=1, kind="leg", mode="pt", routing_mode="pt", start_link="quay", end_link="loop", line=line, route="R", access_facility="s1", egress_facility=egress, route_type="default_pt")
    return [dict(person=name, elem_idx=0, kind="act", act_type="home", link="quay", end_ns=at * 10**9), leg, dict(person=name, elem_idx=2, kind="act", act_type="work", link="loop")]


def test_schedule_based_transit(spark):
    rows = rider("x", "s3", 90) + rider("y", "s2", 101) + rider("lost", "s3", 90, "Q")
    kinds = "person string, elem_idx int, kind string, act_type string, link string, end_ns long, mode string, routing_mode string, start_link string, end_link string, line string, route string, access_facility string, egress_facility string, route_type string"
    names = [c.split()[0] for c in kinds.split(", ")]
    e = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], kinds).withColumn("scenario", F.lit(0))
    log = mobsim.simulate(e, links(spark), transit_tables=transit_tables(spark)).orderBy("seq").collect()
    at = lambda **f: [r.time_ns // 10**9 for r in log if all(r[k] == v for k, v in f.items())]
    bus = lambda i: f"bus_L_R_d{i}"
    assert at(type="PersonEntersVehicle", person="x", vehicle=bus(0)) == [100] and at(type="PersonLeavesVehicle", person="x") == [200] and at(type="actstart", person="x") == [201]
    assert at(type="PersonEntersVehicle", person="y", vehicle=bus(1)) == [160] and at(type="arrival", person="y") == [210]
    assert at(type="stuckAndAbort") == [86400] and at(type="stuckAndAbort", person="lost") == [86400] and at(type="waitingForPt", agent="lost") == [90]
    assert at(type="VehicleArrivesAtFacility", vehicle=bus(0)) == [100, 150, 200] and at(type="VehicleDepartsAtFacility", vehicle=bus(0)) == [100, 170, 200]
    assert at(type="TransitDriverStarts") == [100, 160, 220] and at(type="arrival", person="pt_L_R_d2") == [320]


def test_transit_never_overtakes(spark):
    """Vehicles that would catch up with a late one stay behind it."""
    buses = mobsim.schedule(transit_tables(spark, 4, 5))
    buses[0].stops[1] = ("s2", buses[0].stops[1][1] + 300 * 10**9, buses[0].stops[1][2] + 300 * 10**9)
    sim = mobsim.Simulation(links(spark).toPandas(), __import__("pandas").DataFrame({"person": [], "elem_idx": []}), {}, mobsim.Settings(), buses)
    log = sim.run()
    for stop in ("s1", "s2", "s3"):
        for kind in ("VehicleArrivesAtFacility", "VehicleDepartsAtFacility"):
            mine = [(t, f["vehicle"]) for t, k, f in log if k == kind and f["facility"] == stop]
            assert [v for _, v in mine] == [f"bus_L_R_d{i}" for i in range(4)] and mine == sorted(mine, key=lambda x: x[0])
    assert not [e for e in log if e[1] == "stuckAndAbort"]


def test_agents_who_look_for_a_route(spark, files):
    """A planned route over a slow link is replaced before the departure, in the agent's own copy only."""
    l = links(spark)  # noqa: E741
    two = l.union(spark.createDataFrame([("fast", "mill", "gate", 100.0, 10.0, 3600.0, 1.0, ["car"])], l.schema))
    p = plan(spark, files).withColumn("horizon_ns", F.when(F.col("act_type") == "bakery", F.lit(600 * 10**9)))
    went = lambda df: [r.link for r in df.filter("type = 'entered link'").orderBy("seq").collect()]
    g = routing.build_graph(nodes(spark), two, "car")
    assert went(mobsim.simulate(p, two, graph=g)) == ["fast", "loop", "spur"]
    assert went(mobsim.simulate(p.drop("horizon_ns"), two, graph=g)) == ROUTE[1:]
    assert went(mobsim.simulate(p, two)) == ROUTE[1:]
