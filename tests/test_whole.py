from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from scenario import LOG, NETWORK, P, POPULATION, VEHICLES, events
from veloframe.operators import events as ev
from veloframe.operators import traveltime
from veloframe.plans import controller
from veloframe.sources import config, folders, sinks, xml
from veloframe.streaming import replay

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
LLM = {k for p in entry.PARTS if p.__name__.endswith("llm.queries") for k in p.QUERIES}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - LLM))
def test_query_against_sql(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))]) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert rows == sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at]) for r in cur.fetchall())


def scenario(spark, tmp_path):
    for name, text in (("network", NETWORK), ("population", POPULATION), ("vehicles", VEHICLES)):
        (tmp_path / f"{name}.xml").write_text(text)
    n, l, _ = xml.network(spark, f"{tmp_path}/network.xml")  # noqa: E741
    p = xml.population(spark, f"{tmp_path}/population.xml").filter(F.col("person") == P)
    return controller.Scenario(n, l, p, xml.persons(p), xml.vehicles(spark, f"{tmp_path}/vehicles.xml")[1], spark.createDataFrame([("person", "ReRoute", 1.0)], "subpopulation string, strategy string, weight double"))


def test_iterations(spark, tmp_path):
    c = config.Config()
    c.controller.last_iteration = 1
    c.qsim.main_modes, c.output.output_dir, c.output.write_events, c.controller.write_events_interval, c.controller.write_plans_interval = ["car"], str(tmp_path / "out"), "File", 1, 5
    seen = []
    bus = controller.Bus()
    bus.on("iteration_ends", lambda e: seen.append(("low", e["iteration"])))
    bus.on("iteration_ends", lambda e: seen.append(("high", e["iteration"])), priority=5)
    st = controller.run(scenario(spark, tmp_path), c, controller.travel_time_scorer, bus)
    assert seen == [("high", 0), ("low", 0), ("high", 1), ("low", 1)]
    assert ev.difference(spark.read.parquet(f"{c.output.output_dir}/events/iteration=0"), events(spark), ["person", "link", "vehicle", "act_type", "leg_mode"]).count() == 0
    got = {r.plan_idx: (r.score, r.selected) for r in st.plans.collect()}
    assert got[0] == (-845.0, False) and got[2][1] and got[2][0] < 0 and len(got) == 3
    assert st.events.filter("type = 'arrival'").count() == 4 and st.experienced.count() == 9
    assert sorted(p.name for p in Path(c.output.output_dir).iterdir()) == ["0.plans.parquet", "1.plans.parquet", "events", "output_events.parquet"]
    with pytest.raises(FileExistsError):
        sinks.prepare_folder(c.output.output_dir, config.Overwrite.FAIL)
    sinks.prepare_folder(c.output.output_dir, config.Overwrite.DELETE)
    assert not list(Path(c.output.output_dir).iterdir())


def test_reroute_avoids_what_was_congested(spark, tmp_path):
    nodes = spark.createDataFrame([("west", 0.0, 0.0), ("ford", 0.0, 200.0), ("pass", 900.0, 500.0), ("east", 900.0, 800.0)], "id string, x double, y double")
    net = [("in", "west", "ford", 200.0, 3600.0), ("low", "ford", "pass", 1000.0, 12.0), ("high", "ford", "pass", 1150.0, 3600.0), ("out", "pass", "east", 300.0, 3600.0)]  # high is longer, low lets a car pass every 300 s
    links = spark.createDataFrame([(i, f, t, n, 10.0, k, 1.0, ["car"]) for i, f, t, n, k in net], "id string, from_node string, to_node string, length_m double, freespeed double, capacity double, permlanes double, modes array<string>")
    act = '<activity type="{}" link="{}" x="{}" y="{}" {}/>'
    persons = "".join(f'<person id="{i}"><plan selected="yes">{act.format("home", "in", 0, 50, f"""end_time="08:00:0{i}" """)}<leg mode="car"/>{act.format("work", "out", 900, 750, "")}</plan></person>' for i in range(5))
    (tmp_path / "p.xml").write_text(f"<population>{persons}</population>")
    p = xml.population(spark, f"{tmp_path}/p.xml")
    c = config.Config()
    c.controller.last_iteration, c.qsim.main_modes = 1, ["car"]
    s = controller.Scenario(nodes, links, p, xml.persons(p), None, spark.createDataFrame([("person", "ReRoute", 1.0)], "subpopulation string, strategy string, weight double"), {"car": 5.0})
    driven = []
    bus = controller.Bus()
    bus.on("simulated", lambda e: driven.append({r.link: r["count"] for r in e["events"].filter("type = 'entered link'").groupBy("link").count().collect()}))
    st = controller.run(s, c, controller.travel_time_scorer, bus, write=False)
    assert driven == [{"low": 5, "out": 5}, {"high": 5, "out": 5}]
    times = {(r.plan_idx, r.route_trav_ns) for r in st.elements.filter("mode = 'car'").collect()}
    assert (0, 260_000_000_000) in times  # 1,300 m at the vehicle's 5 m/s


def test_transit_facilities_and_horizons_in_a_run(spark, tmp_path):
    """A rider waits for the bus, an agent with a horizon leaves the planned way, activities get their links from facilities."""
    nodes = spark.createDataFrame([("west", 0.0, 0.0), ("ford", 0.0, 200.0), ("pass", 900.0, 500.0), ("east", 900.0, 800.0)], "id string, x double, y double")
    net = [("in", "west", "ford", 200.0), ("low", "ford", "pass", 1000.0), ("high", "ford", "pass", 4000.0), ("out", "pass", "east", 300.0)]
    links = spark.createDataFrame([(i, f, t, n, 10.0, 3600.0, 1.0, ["car"]) for i, f, t, n in net], "id string, from_node string, to_node string, length_m double, freespeed double, capacity double, permlanes double, modes array<string>")
    walk = lambda l: f'<leg mode="walk"><attributes><attribute name="routingMode" class="java.lang.String">car</attribute></attributes><route type="generic" start_link="{l}" end_link="{l}" trav_time="00:00:10" distance="9"/></leg>'  # noqa: E731, E741
    stop = lambda l: f'<activity type="car interaction" link="{l}" x="0" y="0" max_dur="00:00:00"/>'  # noqa: E731, E741
    horizon = '<attributes><attribute name="preplanningHorizon" class="java.lang.Integer">600</attribute></attributes>'
    drive = '<leg mode="car"><attributes><attribute name="routingMode" class="java.lang.String">car</attribute></attributes><route type="links" start_link="in" end_link="out" trav_time="00:10:00" distance="4300">in high out</route></leg>'
    car = lambda n, more: f'<person id="{n}"><plan selected="yes"><activity type="home" facility="h" end_time="08:00:00">{more}</activity>{walk("in")}{stop("in")}{drive}{stop("out")}{walk("out")}<activity type="work" facility="w"/></plan></person>'
    route = '{"transitLineId":"L","transitRouteId":"R","accessFacilityId":"s1","egressFacilityId":"s2","boardingTime":"undefined"}'
    rider = f'<person id="rider"><plan selected="yes"><activity type="home" facility="h" end_time="08:00:00"/><leg mode="pt"><attributes><attribute name="routingMode" class="java.lang.String">pt</attribute></attributes><route type="default_pt" start_link="in" end_link="out" trav_time="00:20:00" distance="1500">{route}</route></leg><activity type="work" facility="w"/></plan></person>'
    (tmp_path / "p.xml").write_text(f"<population>{car('planned', '')}{car('looking', horizon)}{rider}</population>")
    p = xml.population(spark, f"{tmp_path}/p.xml")
    fac = spark.createDataFrame([("h", 0.0, 50.0, "in"), ("w", 900.0, 700.0, "out")], "id string, x double, y double, link string")
    df, ns = spark.createDataFrame, 10**9
    transit = {"departures": df([("L", "R", "d1", 28_860 * ns, "bus")], "line string, route string, id string, dep_ns long, vehicle string"), "routes": df([("L", "R", "bus", ["in", "out"])], "line string, route string, mode string, links array<string>"), "route_stops": df([("L", "R", 0, "s1", None, 0), ("L", "R", 1, "s2", 300 * ns, None)], "line string, route string, pos int, facility string, arr_ns long, dep_ns long"), "stop_facilities": df([("s1", "in"), ("s2", "out")], "id string, link string")}
    c = config.Config()
    c.controller.last_iteration, c.qsim.main_modes, c.transit.simulation = 0, ["car"], config.TransitSimulation.SCHEDULE_BASED
    c.output.output_dir, c.scoring.write_experienced_plans = str(tmp_path / "out"), True
    s = controller.Scenario(nodes, links, p, xml.persons(p), facilities=fac, transit=transit)
    st = controller.run(s, c, controller.travel_time_scorer)
    went = {r.vehicle: r.link for r in st.events.filter("type = 'entered link' and link in ('low', 'high')").collect()}
    assert went == {"planned_car": "high", "looking_car": "low"}
    ride = st.experienced.filter("person = 'rider' and kind = 'leg'").first()
    assert (ride.dep_ns, ride.boarding_ns, ride.trav_ns, ride.route_type) == (28_800 * ns, 28_860 * ns, 360 * ns, "default_pt")
    assert {r.score for r in spark.read.parquet(f"{c.output.output_dir}/output_experienced_plans.parquet").filter("person = 'rider'").collect()} == {-360.0}
    with pytest.raises(ValueError, match="unknown facility: 6"):
        controller.initial(controller.Scenario(nodes, links, p, xml.persons(p), facilities=fac.filter("false")))


def test_xml_round_trips(spark, tmp_path):
    for codec, name in ((None, "e.xml"), ("gzip", "e.xml.gz"), ("zstd", "e.xml.zst"), (None, "parts.xml"), ("gzip", "packed.xml.gz")):
        sinks.write_events_xml(events(spark), f"{tmp_path}/{name}", codec, single_file=name.startswith("e."))
        assert ev.compare(folders.read_events(spark, f"{tmp_path}/{name}").drop("file"), events(spark)) == "equal"
    s = scenario(spark, tmp_path)
    sinks.write_population_xml(s.elements, f"{tmp_path}/again.xml", single_file=True)
    cols = [c for c in s.elements.columns if c not in ("seq", "plan_attributes", "attributes", "person_attributes", "trav_ns")]
    again = xml.population(spark, f"{tmp_path}/again.xml")
    assert sorted(map(str, again.select(cols).collect())) == sorted(map(str, s.elements.select(cols).collect()))
    sinks.write_network_xml(s.nodes, s.links, f"{tmp_path}/net2.xml", 7.0, single_file=True)
    n, l, cell = xml.network(spark, f"{tmp_path}/net2.xml")  # noqa: E741
    assert cell == 7.0 and sorted(map(str, l.drop("seq", "attributes", "partition_no").collect())) == sorted(map(str, s.links.drop("seq", "attributes", "partition_no").collect())) and n.count() == 5


def test_event_folders(spark, tmp_path):
    for i, rows in enumerate((LOG[::2], LOG[1::2])):
        sinks.write_events_xml(events(spark, rows), f"{tmp_path}/events.{i}.xml", single_file=True)
    log = folders.read_folder(spark, str(tmp_path))
    assert log.count() == len(LOG) and ev.out_of_order(log).count() == 0 and ev.difference(log, events(spark), ["person", "link", "act_type"]).count() == 0
    (tmp_path / "events.3.xml").write_text("<events/>")
    with pytest.raises(ValueError):
        folders.event_files(str(tmp_path))
    with pytest.raises(ValueError):
        folders.read_events(spark, "log.csv")
    assert (sinks.output_name("plans.xml", "run", None), sinks.output_name("plans.xml", None, 3), sinks.due(5, 7, 5), sinks.due(6, 7, 5), sinks.due(7, 7, 0)) == ("run.output_plans.xml", "3.plans.xml", True, False, True)


def test_stream_is_batch(spark, tmp_path):
    log = events(spark)
    for i, (a, z) in enumerate(((0, 16), (16, 17), (17, 99))):  # a vehicle's state lasts over batches
        log.filter((F.col("seq") >= a) & (F.col("seq") < z)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    import os
    import time

    for i, f in enumerate(sorted(Path(f"{tmp_path}/log").glob("part-*"), key=lambda f: f.stat().st_mtime_ns)):
        os.utime(f, (time.time() - 1000 + i * 10,) * 2)
    obs = replay.stream_observations(replay.replay(spark, f"{tmp_path}/log"))
    q = obs.writeStream.format("memory").queryName("obs").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("obs").drop("event_time").collect()) == sorted(tuple(r) for r in traveltime.observations(log).collect())
    batch = replay.windowed_means(traveltime.observations(log)).collect()
    assert sorted((r.link, r.mean_ns, r.n) for r in batch) == [("loop", 81e9, 1), ("rise", 51e9, 1)]
    assert replay.sessions(replay.with_event_time(log), "person").count() == 2


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from veloframe import cli

    monkeypatch.setattr(cli, "session", lambda *_: spark)
    sinks.write_events_xml(events(spark), f"{tmp_path}/a.xml", single_file=True)
    sinks.write_events_xml(events(spark, LOG[:-1]), f"{tmp_path}/b.xml", single_file=True)
    assert cli.main(["compare-events", f"{tmp_path}/a.xml", f"{tmp_path}/a.xml"]) == 0 and cli.main(["compare-events", f"{tmp_path}/a.xml", f"{tmp_path}/b.xml"]) == 1
    scenario(spark, tmp_path)
    assert cli.main(["filter-population", f"{tmp_path}/population.xml", f"{tmp_path}/one.xml", "-n", "1"]) == 0
    assert {r.person for r in xml.population(spark, f"{tmp_path}/one.xml").collect()} == {P}
    assert cli.main(["convert", f"{tmp_path}/network.xml", f"{tmp_path}/population.xml", f"{tmp_path}/bin"]) == 0
    assert {(r.id, r.weight) for r in spark.read.parquet(f"{tmp_path}/bin/nodes.parquet").collect()} == {(x, 1) for x in ("dock", "mill", "gate", "fork", "hill")}
    (tmp_path / "c.yml").write_text(f"modules:\n  network: {{path: network.xml}}\n  population: {{path: population.xml}}\n  vehicles: {{path: vehicles.xml}}\n  qsim: {{main_modes: [car]}}\n  controller: {{last_iteration: 0}}\n  output: {{output_dir: {tmp_path}/run}}\n")
    assert cli.main(["run", "--config", f"{tmp_path}/c.yml"]) == 0
    assert spark.read.parquet(f"{tmp_path}/run/output_events.parquet").count() == len(LOG)
