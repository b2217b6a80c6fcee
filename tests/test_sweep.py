"""Scenarios whose agents all drive one route are swept vehicle by vehicle: what the simulation gives tick by tick."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_many_scenarios import LINK, crowd

from veloframe import catalogue_runs
from veloframe.functions.times import NS
from veloframe.operators import mobsim

NAMES = LINK.replace(" string", "").replace(" double", "").split(", ")


def one_route(r):
    """A random route of some links, what happens on it, and when agents leave."""
    rows = [(f"l{h}", f"n{h}", f"n{h + 1}", r.choice([1.0, 75.0, 300.0, r.uniform(1, 500)]), r.choice([0.5, 5.0, 33.3]), r.choice([0.0, 1.0, 50.0, 360.0, 1800.0, 3600.0, 36_000.0, r.uniform(10, 5000)]), r.choice([0.3, 1.0, 5.0])) for h in range(r.randint(2, 5))]
    s = mobsim.Settings(start_s=r.choice([0, 50]), end_s=r.choice([300, 2000, 100_000]), ticks_per_second=r.choice([1, 1, 10]), sample=r.choice([1.0, 0.1]), stuck_s=r.choice([0, 10, 1000, 10**7]), kinematic=r.random() < 0.5, cell=r.choice([7.5, 75.0]))
    span = r.choice([1, 100, 2000]) * NS
    return pd.DataFrame(rows, columns=NAMES), s, [r.randint(0, span) for _ in range(r.choice([1, 5, 40]))]


def batches(ends, way):
    """The rows of two scenarios, in batches that don't end where a scenario does."""
    rows = [(k, f"p{i:03d}", *e) for k in "xy" for i, end in enumerate(ends) for e in ((0, "act", end, None, None), (1, "leg", None, "car", way), (2, "act", None, None, None))]
    kinds = {"scenario": pa.string(), "person": pa.string(), "elem_idx": pa.int32(), "kind": pa.string(), "end_ns": pa.int64(), "mode": pa.string(), "links": pa.list_(pa.string())}
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
    return [whole.slice(i, 7) for i in range(0, len(whole), 7)]


@pytest.mark.parametrize("seed", range(4))
def test_a_sweep_is_the_simulation(seed):
    r = random.Random(seed)
    for _ in range(40):
        net, s, ends = one_route(r)
        network, way = mobsim.Network(net, s), list(net.id)
        given, out = batches(ends, way), mobsim._Log("scenario", ["person", "link", "vehicle", "network_mode", "relative_position"], ordered=False)
        want = [(k, t, kind, *(f.get(c) for c in out.columns)) for k, plans, _ in mobsim._scenarios(iter(given), out) for t, kind, f in mobsim.Simulation(network, plans, {}, s, types=mobsim.SWEPT).run()]
        told = list(mobsim._swept(iter(given), out, network, s, mobsim.SWEPT))
        assert not [x for _, others in told for x in others]
        assert sorted(map(str, want)) == sorted(str(tuple(x.values())) for b, _ in told for y in b for x in y.to_pylist())


def test_only_routes_without_side_roads_are_swept():
    net = pd.DataFrame([("a", "p", "q", 10.0, 10.0, 3600.0, 1.0), ("b", "q", "r", 10.0, 10.0, 3600.0, 1.0), ("c", "r", "p", 10.0, 10.0, 3600.0, 1.0), ("d", "q", "q", 10.0, 10.0, 3600.0, 1.0)], columns=NAMES)
    known = lambda *way: mobsim.corridor(mobsim.Network(net, mobsim.Settings()), way) is not None
    assert known("a", "b") and known("a", "b", "c") and not known("a") and not known("a", "c") and not known("a", "zz") and not known("a", "d", "b") and not known("a", "b", "c", "a")


def test_the_log_in_any_order_has_the_same_events(spark):
    """the order is left out where it isn't asked for; scenarios that can't be swept are simulated as before."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 36.0, 50.0), ("b", "q", "r", 1000.0, 10.0, 36000.0, 5000.0), ("c", "r", "s", 75.0, 0.5, 1.0, 1.0)], LINK)
    elements = crowd(spark, 6, 4)[1]
    short = (F.col("scenario") == "2") & (F.col("person") < "0010") & (F.col("kind") == "leg")
    elements = elements.withColumn("links", F.when(short, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("links"))).filter("not (scenario = '4' and elem_idx = 2 and person > '0010')")
    s, types = mobsim.Settings(end_s=500, kinematic=True, cell=75.0), ["left link", "vehicle leaves traffic"]
    some = mobsim.simulate(elements, links, settings=s, types=types, ordered=False)
    whole = mobsim.simulate(elements, links, settings=s, types=types).drop("seq")
    assert some.columns == whole.columns and sorted(map(str, some.collect())) == sorted(map(str, whole.collect())) and some.count() > 48


def test_the_waves_are_swept(spark, tmp_path):
    """the simulation goes from tick to tick, six ticks a vehicle."""
    rows = [(i, i % 3, f"2024-01-01 00:00:{i % 7:02d}") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue_runs.queue_waves(spark, str(tmp_path))
    assert "seq" not in next(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x)
    want = set()
    for u in range(3):
        y = None
        for k, (t, i) in enumerate(sorted((t % 7, t) for t in range(60) if t % 3 == u)):
            arr = t + 102 if not k else max(t + 102, arr + 1)
            y = arr if y is None else max(arr, y + 168)
            want.add((str(u), f"{i:012d}", y, y + 150))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("more", [{}, {"types": ["left link", "vehicle leaves traffic"], "ordered": False}])
def test_plans_that_are_made_in_the_tasks(spark, more):
    """a row a person is moved and sorted, not one an element; without a plan, or with an empty one, an agent has none."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 36.0, 50.0), ("b", "q", "r", 1000.0, 10.0, 36000.0, 5000.0), ("c", "r", "s", 75.0, 0.5, 1.0, 1.0)], LINK)
    rows = crowd(spark, 3, 5)[0]
    plan = catalogue_runs._plan(catalogue_runs._driving())
    some = F.when(F.col("person") == "0004", F.slice(plan, 1, 0)).when(F.col("person") != "0007", plan)
    want = mobsim.simulate(catalogue_runs._elements(rows, catalogue_runs._driving()).filter("person not in ('0004', '0007')"), links, **more)
    fleet = rows.select(F.concat("person", F.lit("_car")).alias("vehicle"), F.lit(1.0).alias("pce"), F.lit(50.0).alias("max_v"))
    for got in (mobsim.simulate(rows, links, plan=some, **more), mobsim.simulate(rows, links, fleet, plan=some, **more)):
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 26
    moved = mobsim.simulate(rows, links, plan=some, **more)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in moved
