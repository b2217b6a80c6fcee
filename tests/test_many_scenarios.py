"""Many small scenarios in one simulation."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veloframe import catalogue_runs
from veloframe.functions.times import NS
from veloframe.operators import experienced, mobsim

LINK = "id string, from_node string, to_node string, length_m double, freespeed double, capacity double, permlanes double"


def crowd(spark, scenarios, agents):
    """Agents a second apart, every one with a name of its own."""
    rows = spark.range(scenarios * agents).select((F.col("id") % scenarios).cast("string").alias("scenario"), F.lpad(F.col("id").cast("string"), 4, "0").alias("person"), F.expr(f"id div {scenarios}").alias("t"), "id")
    return rows, catalogue_runs._elements(rows, catalogue_runs._driving())


def fleet_of(spark, passing, monkeypatch):
    """Vehicles of 8 scenarios, more than one task takes; every third is slow."""
    monkeypatch.setattr(mobsim, "MOST_ELEMENTS", 9)
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 36000.0, 50.0), ("b", "q", "r", 1000.0, 10.0, 36000.0, 5000.0), ("c", "r", "s", 10.0, 10.0, 36000.0, 5000.0)], LINK)
    rows, elements = crowd(spark, 8, 3)
    fleet = rows.select(F.concat("person", F.lit("_car")).alias("vehicle"), F.lit(1.0).alias("pce"), F.when(F.col("id") < 8, 2.5).otherwise(50.0).alias("max_v"))
    log = mobsim.simulate(elements, links, fleet, mobsim.Settings(passing=passing)).filter("type = 'left link' and link = 'b'")
    return sorted((r.scenario, r.vehicle, r.time_ns // NS) for r in log.collect())


def test_a_fleet_larger_than_a_task_takes_with_passing(spark, monkeypatch):
    assert fleet_of(spark, True, monkeypatch) == sorted((str(i % 8), f"{i:04d}_car", 402 if i < 8 else i // 8 + 102) for i in range(24))


def test_a_fleet_larger_than_a_task_takes_without_passing(spark, monkeypatch):
    assert fleet_of(spark, False, monkeypatch) == sorted((str(i % 8), f"{i:04d}_car", 402) for i in range(24))


def test_who_arrives_in_the_last_tick_is_not_stuck(spark):
    one = {c: None for c in mobsim._NEED} | {"person": "x", "link": "a"}
    plan = [one | {"elem_idx": 0, "kind": "act", "end_ns": 10 * NS}, one | {"elem_idx": 1, "kind": "leg", "mode": "walk", "trav_ns": 5 * NS}, one | {"elem_idx": 2, "kind": "act"}]
    none = pd.DataFrame(columns=["id", "from_node", "to_node", "length_m", "capacity", "freespeed", "permlanes"])
    kinds = lambda end: [e[1] for e in mobsim.Simulation(none, plan, {}, mobsim.Settings(end_s=end)).run()]
    assert kinds(14)[-1] == "stuckAndAbort" and kinds(15)[-1] == "arrival" and kinds(16)[-1] == "actstart"


def test_waiting_takes_no_ticks(spark, monkeypatch):
    """Where one vehicle goes in 1,000 s there is nothing to do in between."""
    net = pd.DataFrame([("a", "p", "q", 10.0, 3.6, 10.0, 50.0), ("c", "q", "r", 10.0, 3.6, 10.0, 50.0)], columns=["id", "from_node", "to_node", "length_m", "capacity", "freespeed", "permlanes"])
    one = {c: None for c in mobsim._NEED} | {"link": "a"}
    plans = [e | {"person": f"p{i}"} for i in range(5) for e in (one | {"elem_idx": 0, "kind": "act", "end_ns": 0}, one | {"elem_idx": 1, "kind": "leg", "mode": "car", "links": ["a", "c"]}, one | {"elem_idx": 2, "kind": "act"})]
    ticks = []
    monkeypatch.setattr(mobsim.Simulation, "step", lambda self, t, f=mobsim.Simulation.step: ticks.append(t) or f(self, t))
    log = mobsim.Simulation(net, plans, {}, mobsim.Settings()).run()
    assert [t // NS for t, k, _ in log if k == "vehicle enters traffic"] == [0, 1000, 2000, 3000, 4000] and len(ticks) < 40


def test_plans_of_a_simulation_run_it_once(spark):
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 36000.0, 50.0), ("b", "q", "r", 1000.0, 10.0, 36000.0, 5000.0), ("c", "r", "s", 10.0, 10.0, 36000.0, 5000.0)], LINK)
    plans = experienced.experienced_plans(mobsim.simulate(crowd(spark, 2, 2)[1], links), links)
    text = plans._jdf.queryExecution().toString()
    assert "InArrow" not in text and "InPandas" not in text and plans.count() == 12


def test_a_fleet_that_is_not_small_is_not_broadcast(spark, monkeypatch):
    """by its estimated size Spark broadcast 6,000,000 vehicles, for which a driver has no memory."""
    rows, elements = crowd(spark, 2, 2)
    fleet = rows.select(F.concat("person", F.lit("_car")).alias("vehicle"), F.lit(1.0).alias("pce"), F.lit(50.0).alias("max_v"))
    monkeypatch.setattr(mobsim, "BROADCAST_ROWS", 3)
    plan = mobsim.simulate(elements, spark.createDataFrame([], LINK), fleet)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_events_of_some_types_keep_their_places(spark):
    """only what is asked for leaves the tasks, as the filtered log."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 36000.0, 50.0), ("b", "q", "r", 1000.0, 10.0, 36000.0, 5000.0), ("c", "r", "s", 10.0, 10.0, 36000.0, 5000.0)], LINK)
    elements = crowd(spark, 3, 5)[1]
    some = mobsim.simulate(elements, links, types=["left link", "arrival"])
    assert some.columns == ["scenario", "time_ns", "seq", "type", "person", "link", "vehicle", "leg_mode"]
    whole = mobsim.simulate(elements, links).filter("type in ('left link', 'arrival')").select(*some.columns)
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.collect())) and some.count() == 45


@pytest.mark.parametrize("query", ["queue_flow", "queue_storage", "queue_waves", "adaptive_routes"])
def test_a_query_takes_only_its_events_out_of_the_tasks(spark, tmp_path, query):
    """of two agents each; the log has many more columns, and a number of tasks that doesn't depend on its bytes."""
    rows = [(i, i % 3, f"2024-01-01 00:00:{i:02d}") for i in range(6)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue_runs.QUERIES[query](spark, str(tmp_path))
    assert "transit_line" not in next(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x) and got.count() == 6


def test_plans_are_numbered_from_parts_that_are_written_once(spark):
    """their log was read and folded again for every use of its legs; a log without some fields has them as null."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 3600.0, 1.0), ("c", "q", "r", 10.0, 10.0, 3600.0, 1.0)], LINK)
    walk = crowd(spark, 2, 2)[0]
    leg = {"mode": F.lit("walk"), "routing_mode": F.lit("walk"), "start_link": F.lit("a"), "end_link": F.lit("c"), "trav_ns": F.lit(600 * NS)}
    log = lambda **more: mobsim.simulate(catalogue_runs._elements(walk, leg), links, settings=mobsim.Settings(end_s=600), **more)
    plans = experienced.experienced_plans(log(types=["actend", "departure", "travelled", "arrival", "actstart", "stuckAndAbort"]), links)
    assert plans.inputFiles() and all("/parts-" in f for f in plans.inputFiles())
    whole = experienced.experienced_plans(log(), links)
    assert plans.columns == whole.columns and sorted(map(str, plans.collect())) == sorted(map(str, whole.collect()))
    assert {(r.person, r.trav_ns, r.aborted) for r in plans.filter("kind = 'leg'").collect()} == {("0000", 600 * NS, False), ("0001", 600 * NS, False), ("0002", None, True), ("0003", None, True)}
