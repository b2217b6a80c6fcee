import random

from scenario import LOG, P, ROUTE, events, links
from veloframe.operators import events as ev
from veloframe.operators import experienced, traveltime
from veloframe.functions.times import NS
from pyspark.sql import functions as F


def test_views(spark):
    assert ev.of_type(events(spark), "entered link").columns == ["time_ns", "seq", "link", "vehicle"]
    stop = spark.createDataFrame([(1, 0, "VehicleArrivesAtFacility", "v", None)], "time_ns long, seq long, type string, vehicle string, delay double")
    assert ev.of_type(stop, "VehicleArrivesAtFacility").first().delay == 0.0 and ev.of_type(stop, "VehicleArrivesAtFacility").first().facility is None


def test_comparison(spark):
    a = events(spark)
    swap = LOG[:2][::-1] + LOG[2:]
    late = LOG[:3] + [LOG[9]] + LOG[3:9] + LOG[10:]
    other = LOG[:2] + [(21000, "travelled", dict(person=P, distance=11.0, mode="ferry"))] + LOG[3:]
    moved = LOG[:-1] + [(22448, *LOG[-1][1:])]
    assert ev.compare(a, events(spark, swap)) == "equal"
    assert ev.compare(a, events(spark, late)) == "order"
    assert ev.compare(a, events(spark, other)) == "missing"
    assert ev.compare(a, events(spark, LOG[:5] + LOG[6:])) == "count"
    assert ev.compare(a, events(spark, LOG[:-1])) == "count"
    assert ev.compare(a, events(spark, moved)) == "time"
    assert ev.difference(a, events(spark, LOG + LOG[:1])).collect()[0].n_second == 2
    assert ev.compare(a.limit(0), a.limit(0)) == "equal"


def test_merge_and_order(spark):
    rng = random.Random(1)
    logs = [sorted((rng.randrange(50), i) for i in range(40)) for _ in range(3)]
    dfs = [spark.createDataFrame([(t, i, f"{k}.{i}") for i, (t, _) in enumerate(log)], "time_ns long, seq long, name string") for k, log in enumerate(logs)]
    got = ev.merged(dfs).orderBy("seq").collect()
    want = sorted((t, k, i) for k, log in enumerate(logs) for i, (t, _) in enumerate(log))
    assert [r.name for r in got] == [f"{k}.{i}" for _, k, i in want] and [r.seq for r in got] == list(range(120))
    assert ev.merged([dfs[0].limit(0)]).count() == 0
    assert ev.out_of_order(dfs[0]).count() == 0
    assert ev.out_of_order(spark.createDataFrame([(5, 0), (3, 1), (4, 2)], "time_ns long, seq long")).first().seq == 1


def test_travel_times(spark):
    obs = traveltime.observations(events(spark)).collect()
    assert sorted(tuple(r) for r in obs) == [("car", "loop", 22284 * NS, 81 * NS), ("car", "rise", 22233 * NS, 51 * NS)]
    tt = {(r.link, r.bin): r.mean_ns / NS for r in traveltime.travel_times(events(spark), links(spark), 900 * NS, 86_399 * NS).collect()}
    assert len(tt) == 192 and [tt["rise", b] for b in (23, 24, 25)] == [50, 51, 50] and [tt["loop", b] for b in (23, 24, 25)] == [80, 81, 80]


def test_decay_is_the_loop(spark):
    rng = random.Random(2)
    rows = [(k, b, rng.choice([5.0, 40.0, 3000.0])) for k in range(20) for b in range(12)]
    got = {(r.link, r.bin): r.mean_ns for r in traveltime.decayed(spark.createDataFrame(rows, "link int, bin long, mean_ns double"), ["link"], 900).collect()}
    for k in range(20):
        v = [m for kk, _, m in rows if kk == k]
        for i in range(1, 12):
            v[i] = max(v[i], v[i - 1] - 900)
        assert [got[k, b] for b in range(12)] == v


def test_interpolation(spark):
    rows = traveltime.interpolated(spark.createDataFrame([("l", 0, 10.0), ("l", 1, 20.0)], "link string, bin long, v double"), ["link"], 100, "v")
    at = lambda t: rows.filter(F.col("bin") == t // 100).select(traveltime.at_time(F.lit(t), 100, F.col("v"), F.col("previous_value"), F.col("next_value"), F.col("bin")).alias("x")).first().x
    assert [at(t) for t in (0, 50, 75, 100, 125, 150, 199)] == [10, 10, 12.5, 15, 17.5, 20, 20]


def rows_of(df):
    return [(r.kind, r.act_type or r["mode"], r.start_ns, r.end_ns, r.dep_ns, r.trav_ns, r.route_type, r.distance, r.links, r.aborted) for r in df.orderBy("person", "elem_idx").collect()]


def test_experienced_plan(spark):
    s = lambda x: x * NS
    assert rows_of(experienced.experienced_plans(events(spark), links(spark))) == [
        ("act", "cabin", None, s(20400), None, None, None, None, None, False), ("leg", "ferry", None, None, s(20400), s(600), "generic", 5000.0, None, False), ("act", "bakery", s(21001), s(22201), None, None, None, None, None, False), ("leg", "walk", None, None, s(22201), s(30), "generic", 13.0, None, False),
        ("act", "car interaction", s(22232), s(22232), None, None, None, None, None, False), ("leg", "car", None, None, s(22232), s(153), "links", 1300.0, ROUTE, False), ("act", "car interaction", s(22386), s(22386), None, None, None, None, None, False), ("leg", "walk", None, None, s(22386), s(60), "generic", 26.0, None, False), ("act", "kiln", s(22447), None, None, None, None, None, None, False),
    ]


def test_stuck_plans(spark):
    stuck = lambda n: LOG[:n] + [(86400, "stuckAndAbort", dict(person=P))]
    plan = lambda n: rows_of(experienced.experienced_plans(events(spark, stuck(n)), links(spark)))
    on_road = plan(18)
    assert on_road[-1][0] == "leg" and on_road[-1][-1] and on_road[-1][8] == ROUTE[:3] and [r[-1] for r in on_road[:-1]] == [False] * 5
    between = plan(4)
    assert [r[-1] for r in between] == [False, True]
    doing = plan(5)
    assert doing[-1][1] == "bakery" and [r[-1] for r in doing] == [False, False, True]


def test_transit_ride(spark):
    d, v = "pt_L_R_1", "bus"
    log = [
        (0, "TransitDriverStarts", dict(driver=d, vehicle=v, transit_line="L", transit_route="R", departure="1")), (0, "departure", dict(person=d, link="a", leg_mode="car")), (0, "PersonEntersVehicle", dict(person=d, vehicle=v)), (1, "actend", dict(person=P, link="a", act_type="h")), (1, "departure", dict(person=P, link="a", leg_mode="pt", routing_mode="pt")),
        (2, "VehicleArrivesAtFacility", dict(vehicle=v, facility="s1", delay=0.0)), (3, "PersonEntersVehicle", dict(person=P, vehicle=v)), (4, "entered link", dict(link="b", vehicle=v)), (9, "VehicleArrivesAtFacility", dict(vehicle=v, facility="s2", delay=0.0)), (10, "PersonLeavesVehicle", dict(person=P, vehicle=v)), (10, "arrival", dict(person=P, link="b", leg_mode="pt")), (11, "actstart", dict(person=P, link="b", act_type="w")),
    ]
    e = experienced.experienced_plans(events(spark, log), links(spark))
    assert {r.person for r in e.collect()} == {P}
    r = e.filter("kind = 'leg'").first()
    assert (r.route_type, r.line, r.route, r.access_facility, r.egress_facility, r.boarding_ns, r.links, r.trav_ns) == ("default_pt", "L", "R", "s1", "s2", 3 * NS, None, 9 * NS)
