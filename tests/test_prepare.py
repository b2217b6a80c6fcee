from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scenario import NETWORK, VEHICLES, links, nodes
from veloframe.functions import attributes
from veloframe.operators import network, planops, prepare, transit
from veloframe.sources import folders, sinks, xml

E = "person string, plan_idx int, elem_idx int, kind string, act_type string, link string, facility string, x double, y double, end_ns long, max_dur_ns long, mode string, routing_mode string, route_type string, start_link string, end_link string, trav_ns long, route_trav_ns long, distance double, vehicle string, links array<string>, line string, route string, access_facility string, egress_facility string"
NAMES = [c.split()[0] for c in E.replace("array<string>", "array").split(", ")]


def table(spark, rows):
    return prepare.normal(spark.createDataFrame([tuple(dict(dict(person="p", plan_idx=0, elem_idx=i), **r).get(c) for c in NAMES) for i, r in enumerate(rows)], E))


def act(t, **kw):
    return dict(kind="act", act_type=t, **kw)


def leg(mode, **kw):
    return dict(kind="leg", mode=mode, **{"routing_mode": "car", **kw})


def test_locations(spark):
    fac = spark.createDataFrame([("f", 90.0, 5.0, "rise")], "id string, x double, y double, link string")
    e = table(spark, [act("home", facility="f", link="quay", x=1.0, y=1.0), act("mid", link="rise"), act("near", x=500.0, y=1004.0), act("own", link="loop", x=7.0, y=8.0), act("lost"), act("odd", facility="zz")])
    got = {r.act_type: (r.link, r.x, r.y) for r in planops.located_activities(e, fac, links(spark), nodes(spark)).collect()}
    assert got == {"home": ("rise", 90.0, 5.0), "mid": ("rise", 300.0, 700.0), "near": ("loop", 500.0, 1004.0), "own": ("loop", 7.0, 8.0), "lost": (None, None, None), "odd": (None, None, None)}
    found = planops.issues(e, fac)
    assert {(r.elem_idx, r.message) for r in found.collect()} >= {(5, "unknown facility"), (4, "no place")}
    assert {r.message: (r.n, len(r.examples)) for r in planops.issue_report(found, 1).collect()}["no place"] == (1, 1)


def test_facilities_and_modal_links(spark):
    fac = spark.createDataFrame([("near loop", 510.0, 1004.0, None), ("on quay", 30.0, 40.0, "quay")], "id string, x double, y double, link string")
    got = {r.id: (r.link, r.mode_links) for r in planops.prepared_facilities(fac, links(spark), nodes(spark), ["car", "bike"]).collect()}
    assert got == {"near loop": ("loop", {"bike": "back"}), "on quay": ("quay", {})}


def test_distances_times_vehicles(spark):
    e = table(spark, [act("home"), leg("car", route_type="links", links=["quay", "rise"], distance=1.0, trav_ns=5), act("car interaction"), leg("car", route_type="links", links=["rise", "loop"], vehicle="own"), act("work"), leg("walk", distance=3.0, route_type="generic", route_trav_ns=9), act("home")])
    d = [r.distance for r in planops.filled_distances(e, links(spark)).orderBy("elem_idx").collect()]
    assert d == [None, 600.0, None, 400.0, None, 3.0, None]
    s = planops.synchronised(e).orderBy("elem_idx").collect()
    assert (s[1].trav_ns, s[1].route_trav_ns, s[5].trav_ns) == (5, 5, 9)
    v = planops.resolved_vehicles(e, spark.createDataFrame([("own",)], "vehicle string"), ["car"]).orderBy("elem_idx").collect()
    assert [(r.vehicle, r.vehicle_missing) for r in v] == [(None, False), ("p_car", True), (None, False), ("own", False), (None, False), (None, False), (None, False)]
    parts = spark.createDataFrame([("a", 3), ("b", 4)], "id string, partition_no int")
    assert [tuple(r) for r in planops.by_start_partition(table(spark, [act("h", link="b"), act("w", link="a")]), parts).collect()] == [("p", 4)]
    with_map = e.withColumn("attributes", F.when(F.col("elem_idx") == 4, F.create_map(F.lit("preplanningHorizon"), F.lit("600"))))
    assert planops.adaptive_persons(with_map).first().adaptive and not planops.adaptive_persons(with_map.filter("elem_idx < 3")).first().adaptive


@pytest.mark.parametrize(
    ("change", "valid"),
    [({}, True), ({1: dict(distance=-1.0)}, False), ({1: dict(distance=None)}, False), ({1: dict(route_trav_ns=None)}, False), ({3: dict(links=["quay", "loop"])}, False), ({3: dict(links=["zz"])}, False), ({5: dict(start_link="rise")}, False), ({3: dict(routing_mode="bike")}, False), ({1: dict(mode="car", route_type="links", links=["quay"])}, False)],
)
def test_trip_validity(spark, change, valid):
    rows = [act("home"), leg("walk", route_type="generic", start_link="quay", end_link="quay", distance=1.0, route_trav_ns=1), act("car interaction"), leg("car", route_type="links", start_link="quay", end_link="loop", links=["quay", "rise", "loop"], distance=1000.0), act("car interaction"), leg("walk", route_type="generic", start_link="loop", end_link="loop", distance=1.0, route_trav_ns=1), act("work")]
    for i, c in change.items():
        rows[i] = dict(rows[i], **c)
    assert [r.valid for r in planops.trip_validity(table(spark, rows), links(spark), ["car"]).collect()] == [valid]


def test_transit_trips(spark):
    served = spark.createDataFrame([("L", "R", ["s1", "s2"])], "line string, route string, stops array<string>")
    trip = lambda a, z: table(spark, [act("home"), leg("pt", routing_mode="pt", route_type="default_pt", start_link="quay", end_link="rise", distance=5.0, trav_ns=7, line="L", route="R", access_facility=a, egress_facility=z), act("work")])
    ok = lambda a, z: planops.trip_validity(trip(a, z), links(spark), ["car"], transit=served).first().valid
    assert ok("s1", "s2") and not ok("s2", "s1") and not ok("s1", "s9")


def test_answers(spark):
    r = spark.createDataFrame([("ok", ["l1", "l2"], ["a1"]), ("one", ["l1"], []), ("bad", ["l1"], ["a1"]), ("none", [], [])], "request string, legs array<string>, activities array<string>")
    got = {(x.request, x.pos, x.kind, x.leg, x.activity) for x in prepare.answered(r).collect()}
    assert got == {("ok", 0, "leg", "l1", None), ("ok", 1, "act", None, "a1"), ("ok", 2, "leg", "l2", None), ("one", 0, "leg", "l1", None), ("bad", 0, "error", None, None)}
    m = spark.range(1).select(attributes.vehicle_of(F.create_map(F.lit("vehicles"), F.lit('{"car":"7"}')), "car").alias("v"), attributes.vehicle_of(F.lit(None).cast("map<string,string>"), "car").alias("n")).first()
    assert tuple(m) == ("7", None)


def test_other_sinks(spark, tmp_path):
    (tmp_path / "v.xml").write_text(VEHICLES)
    t, v = xml.vehicles(spark, f"{tmp_path}/v.xml")
    sinks.write_vehicles_xml(t, v, f"{tmp_path}/v2.xml")
    t2, v2 = xml.vehicles(spark, f"{tmp_path}/v2.xml")
    assert sorted(map(str, t2.collect())) == sorted(map(str, t.collect())) and v2.collect() == v.collect()
    fac = spark.createDataFrame([("f", 1.0, 2.0, "a"), ("g", None, 2.0, None)], "id string, x double, y double, link string")
    opening = spark.createDataFrame([("f", "work", "wkday", 7 * 3600 * 10**9, 18 * 3600 * 10**9), ("f", "work", "sat", 0, 26 * 3600 * 10**9)], "facility string, act_type string, open_day string, start_ns long, end_ns long")
    sinks.write_facilities_xml(fac, opening, f"{tmp_path}/f.xml")
    f2, _, o2 = xml.facilities(spark, f"{tmp_path}/f.xml")
    assert sorted(map(str, f2.drop("descr").collect())) == sorted(map(str, fac.collect())) and sorted(map(str, o2.collect())) == sorted(map(str, opening.collect()))
    (tmp_path / "twice.xml").write_text('<facilities><facility id="f" x="1" y="1"/><facility id="f" x="1" y="1"/></facilities>')
    with pytest.raises(ValueError):
        xml.facilities(spark, f"{tmp_path}/twice.xml")
    profile = spark.createDataFrame([("t", 5, bytearray(b"\x01"))], "target string, duration long, uuid binary")
    sinks.write_profile(profile, f"{tmp_path}/p.csv", "csv")
    sinks.write_profile(profile, f"{tmp_path}/p.parquet")
    assert spark.read.option("header", True).csv(f"{tmp_path}/p.csv").first().uuid == "01" and spark.read.parquet(f"{tmp_path}/p.parquet").first().duration == 5
    parts = network.partitions(nodes(spark), 2)
    sinks.write_neighbours(network.neighbour_counts(links(spark), parts, ["car"]), 2, f"{tmp_path}/n")
    assert {(r["size"], r.neighbors) for r in spark.read.option("header", True).csv(f"{tmp_path}/n").collect()} == {("2", "1")}
    both = sinks.merged_attributes(spark.createDataFrame([("a", {"k": "1"}), ("b", None)], "id string, attributes map<string,string>"), spark.createDataFrame([("a", {"k": "2", "z": "3"})], "id string, attributes map<string,string>"))
    assert {r.id: r.attributes for r in both.collect()} == {"a": {"k": "2", "z": "3"}, "b": {}}
    (tmp_path / "net.xml").write_text(NETWORK)
    n, l, _ = xml.network(spark, f"{tmp_path}/net.xml")  # noqa: E741
    assert {(r.kind, r.ord, r.id) for r in folders.id_table({"link": l, "node": n.limit(2)}).collect()} == {("link", 0, "quay"), ("link", 1, "rise"), ("link", 2, "loop"), ("link", 3, "spur"), ("link", 4, "back"), ("node", 0, "dock"), ("node", 1, "mill")}
    assert folders.fetched("local.xml") == "local.xml"


SCHEDULE = """<transitSchedule><transitStops><stopFacility id="1" x="1" y="2" linkRefId="a"/><stopFacility id="1" x="5" y="2" linkRefId="b"/><stopFacility id="2" x="1" y="2"/></transitStops>
<minimalTransferTimes><relation fromStop="1" toStop="2" transferTime="30.0"/></minimalTransferTimes>
<transitLine id="L"><transitRoute id="R"><transportMode>train</transportMode><routeProfile><stop refId="1" departureOffset="00:00:00"/><stop refId="2" arrivalOffset="00:03:20" awaitDeparture="true" allowBoarding="false"/></routeProfile><route><link refId="a"/><link refId="b"/></route><departures><departure id="01" departureTime="06:00:00" vehicleRefId="t"/></departures></transitRoute></transitLine></transitSchedule>"""


def test_transit_schedule(spark, tmp_path):
    (tmp_path / "t.xml").write_text(SCHEDULE)
    t = xml.transit(spark, f"{tmp_path}/t.xml")
    assert {(r.id, r.x, r.link) for r in t["stop_facilities"].collect()} == {("1", 5.0, "b"), ("2", 1.0, None)}
    assert [tuple(r) for r in t["routes"].collect()] == [("L", "R", "train", ["a", "b"])] and [tuple(r) for r in t["transfers"].collect()] == [("1", "2", 30.0)]
    assert [(r.pos, r.facility, r.arr_off_ns, r.dep_off_ns, r.allow_boarding) for r in transit.offsets(t["route_stops"]).orderBy("pos").collect()] == [(0, "1", 0, 0, True), (1, "2", 200 * 10**9, 200 * 10**9, False)]
    assert [tuple(r) for r in t["departures"].collect()] == [("L", "R", "01", 21600 * 10**9, "t")] and [tuple(r)[2:] for r in transit.end_links(t["route_stops"], t["stop_facilities"]).collect()] == [("b", None)]
