"""Queries of the simulation kernel, streams, sources and sinks over the test tables, with the SQL that gives the same rows.

In the simulation queries every user is a scenario and every event an agent that departs at the event's second of the day. The SQL has the
closed form of each queue: with one vehicle every g seconds, the i-th of a queue goes at the greatest of t_j + (i - j) g."""

from __future__ import annotations

import shutil
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veloframe.catalogue import _LOG, _OBS, log, table
from veloframe.functions import times
from veloframe.functions.times import NS
from veloframe.operators import events as ev
from veloframe.operators import experienced, mobsim, network, routing
from veloframe.sources import folders, sinks, xml
from veloframe.storage import materialize, shared_dir
from veloframe.streaming import replay

_LINK = "id string, from_node string, to_node string, length_m double, freespeed double, capacity double, permlanes double"
_END = 400_000
_ELEMENT = "kind string, act_type string, link string, end_ns bigint, mode string, routing_mode string, route_type string, start_link string, end_link string, links array<string>, vehicle string, line string, route string, access_facility string, egress_facility string, trav_ns bigint, horizon_ns bigint"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the intermediate tables, as a local path where it is one."""
    materialize(spark.range(1), "folder")  # the folder of the application, which goes with it
    base = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    return base.removeprefix("file://")


def _plan(leg: dict, horizon=None) -> Column:
    """Home, one leg and work of a row of ``scenario, person, t``; leg: the columns of the leg."""
    kinds = dict(c.rsplit(" ", 1) for c in _ELEMENT.split(", "))
    element = lambda i, **v: F.struct(F.lit(i).alias("elem_idx"), *(v.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
    home = element(0, kind=F.lit("act"), act_type=F.lit("home"), link=F.lit("a"), end_ns=F.col("t") * NS, **({"horizon_ns": horizon} if horizon is not None else {}))
    ride = element(1, kind=F.lit("leg"), **leg)
    work = element(2, kind=F.lit("act"), act_type=F.lit("work"), link=F.lit("c"))
    return F.array(home, ride, work)


def _elements(rows: DataFrame, leg: dict, horizon=None) -> DataFrame:
    """The plans of all rows, an element a row."""
    return rows.select("scenario", "person", F.explode(_plan(leg, horizon)).alias("e")).select("scenario", "person", "e.*")


def _agents(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2000-01-01 00:00:00', ts) div 1000000 % 86400")
    return e.select(F.col("user_id").cast("string").alias("scenario"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("person"), t.alias("t"), "event_id")


_AG = "ag as (select cast(user_id as varchar) as scenario, lpad(cast(event_id as varchar), 12, '0') as person, (date_diff('microsecond', timestamp '2000-01-01', ts) // 1000000) % 86400 as t, event_id, row_number() over (partition by user_id order by (date_diff('microsecond', timestamp '2000-01-01', ts) // 1000000) % 86400, event_id) as i from events)"


def _driving(links=("a", "b", "c")) -> dict:
    one = F.array(*map(F.lit, links))
    return {"mode": F.lit("car"), "routing_mode": F.lit("car"), "route_type": F.lit("links"), "start_link": F.lit(links[0]), "end_link": F.lit(links[-1]), "links": one}


def _when(log_: DataFrame, **cases: tuple[str, str | None]) -> DataFrame:
    """Seconds of the first event of each kind (type, link) per scenario and vehicle or person."""
    who = F.coalesce(*(c for c in ("person", "vehicle") if c in log_.columns))
    who = F.when(who.endswith("_car"), who.substr(F.lit(1), F.length(who) - 4)).otherwise(who)
    at = lambda k, l: F.min(F.when((F.col("type") == k) & (F.lit(True) if l is None else F.col("link") == l), F.expr(f"time_ns div {NS}")))  # noqa: E731, E741
    return log_.groupBy("scenario", who.alias("person")).agg(*(at(*c).alias(n) for n, c in cases.items()))


def queue_flow(spark, sf):
    """SIM-06, SIM-07, SIM-08, SIM-11, SIM-12, SIM-15, SIM-24, SEL-12, SEL-13, SEL-14, JON-01: a link that lets a vehicle depart every 64 s, one that takes 1,000 s and lets one pass every 128 s."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 3600 / 64, 1.0), ("b", "q", "r", 10_000.0, 10.0, 3600 / 128, 50.0), ("c", "r", "s", 1000.0, 10.0, 36_000.0, 50.0)], _LINK)
    got = mobsim.simulate(_elements(_agents(spark, sf), _driving()), links, settings=mobsim.Settings(end_s=_END), types=["PersonEntersVehicle", "vehicle enters traffic", "entered link", "left link", "vehicle leaves traffic"])
    return _when(got, boarded_s=("PersonEntersVehicle", None), departed_s=("vehicle enters traffic", None), entered_s=("entered link", "b"), left_s=("left link", "b"), arrived_s=("vehicle leaves traffic", None))


_QUEUE_FLOW = f"""with {_AG}, e as (select *, max(t - i * 64) over (partition by scenario order by i rows unbounded preceding) + i * 64 as e from ag),
x as (select *, max(e + 1001 - i * 128) over (partition by scenario order by i rows unbounded preceding) + i * 128 as x from e)
select scenario, person, t as boarded_s, cast(e as bigint) as departed_s, cast(e + 1 as bigint) as entered_s, cast(x + 1 as bigint) as left_s, cast(x + 101 as bigint) as arrived_s from x"""


def _storage(spark, sf, speed: float, settings: mobsim.Settings) -> DataFrame:
    """b is long and fast, c has room for one vehicle at a time."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 3600.0, 50.0), ("b", "q", "r", 10_000.0, 100.0, 3600.0, 5000.0), ("c", "r", "s", 75.0, speed, 1.0, 1.0)], _LINK)
    got = mobsim.simulate(_agents(spark, sf), links, settings=settings, types=["entered link", "vehicle leaves traffic"], ordered=False, plan=_plan(_driving()))
    return _when(got, entered_s=("entered link", "c"), arrived_s=("vehicle leaves traffic", None))


_SPACED = f"{_AG}, e as (select *, max(t - i) over (partition by scenario order by i rows unbounded preceding) + i + 101 as arr from ag)"


def queue_storage(spark, sf):
    """SIM-09, SIM-13: a vehicle enters the small link a tick after the one before has left it, 100 s later."""
    return _storage(spark, sf, 0.75, mobsim.Settings(end_s=_END * 100, stuck_s=10**7, cell=75.0))


def queue_waves(spark, sf):
    """SIM-10: with kinematic waves the gap behind a vehicle takes 18 s to travel back over the link."""
    return _storage(spark, sf, 0.5, mobsim.Settings(end_s=_END * 100, stuck_s=10**7, cell=75.0, kinematic=True))


def _stored(stay: int, apart: int) -> str:
    return f"with {_SPACED}, y as (select *, max(arr + 1 - i * {apart}) over (partition by scenario order by i rows unbounded preceding) + i * {apart} as y from e) select scenario, person, cast(y as bigint) as entered_s, cast(y + {stay} as bigint) as arrived_s from y"


def _passing(spark, sf, passing: bool) -> DataFrame:
    """Every third vehicle is slow: 400 s instead of 100 s over b."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 3600.0 * 64, 50.0), ("b", "q", "r", 1000.0, 10.0, 3600.0 * 64, 5000.0), ("c", "r", "s", 10.0, 10.0, 3600.0 * 64, 5000.0)], _LINK)
    agents = _agents(spark, sf)
    fleet = agents.select(F.concat("person", F.lit("_car")).alias("vehicle"), F.lit(1.0).alias("pce"), F.when(F.col("event_id") % 3 == 0, 2.5).otherwise(50.0).alias("max_v"))
    got = mobsim.simulate(_elements(agents, _driving()), links, fleet, mobsim.Settings(end_s=_END, passing=passing), types=["entered link", "left link"])
    return _when(got, entered_s=("entered link", "b"), left_s=("left link", "b"))


def queue_fifo(spark, sf):
    """SIM-07, SIM-11: nobody overtakes a slow vehicle."""
    return _passing(spark, sf, False)


def queue_passing(spark, sf):
    """SIM-11: everybody does."""
    return _passing(spark, sf, True)


_OUT = f"with {_AG}, o as (select *, t + 1 + case when event_id % 3 = 0 then 400 else 100 end as x from ag)"


def stuck_at_end(spark, sf):
    """SIM-14, SIM-17: whoever is still on the way at the end of the day is stuck there."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 3600.0 * 64, 50.0), ("b", "q", "r", 36_000.0, 10.0, 3600.0 * 64, 5000.0), ("c", "r", "s", 10.0, 10.0, 3600.0 * 64, 5000.0)], _LINK)
    got = mobsim.simulate(_elements(_agents(spark, sf), _driving()), links, settings=mobsim.Settings(end_s=86_400))
    return got.filter("type = 'stuckAndAbort'").select("scenario", "person", "link", F.expr(f"time_ns div {NS}").alias("at_s"))


def _tables(spark) -> dict[str, DataFrame]:
    """A line of two stops every half hour."""
    df = spark.createDataFrame
    return {
        "departures": df([("L", "R", f"d{i:02d}", i * 1800 * NS, f"bus{i}") for i in range(48)], "line string, route string, id string, dep_ns long, vehicle string"),
        "routes": df([("L", "R", "bus", ["a", "c"])], "line string, route string, mode string, links array<string>"),
        "route_stops": df([("L", "R", 0, "s1", 0, 120 * NS), ("L", "R", 1, "s2", 1200 * NS, None)], "line string, route string, pos int, facility string, arr_ns long, dep_ns long"),
        "stop_facilities": df([("s1", "a"), ("s2", "c")], "id string, link string"),
    }


def transit_rides(spark, sf):
    """SIM-18, SIM-19, SIM-20, JON-13, JON-14, STR-06: every agent waits for the next bus, which starts at its departure two minutes past, and rides it up to 20 past; read from the rebuilt plans."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 3600.0, 1.0), ("c", "q", "r", 10.0, 10.0, 3600.0, 1.0)], _LINK)
    leg = {"mode": F.lit("pt"), "routing_mode": F.lit("pt"), "route_type": F.lit("default_pt"), "start_link": F.lit("a"), "end_link": F.lit("c"), "line": F.lit("L"), "route": F.lit("R"), "access_facility": F.lit("s1"), "egress_facility": F.lit("s2")}
    got = mobsim.simulate(_elements(_agents(spark, sf), leg), links, settings=mobsim.Settings(end_s=100_000), transit_tables=_tables(spark))
    own = {c: F.when(F.col(c).isNotNull(), F.concat_ws("/", "scenario", c)) for c in ("person", "vehicle", "driver")}  # every scenario has buses of these names
    rides = experienced.experienced_plans(got.withColumns(own).drop("scenario"), links).filter("kind = 'leg'")
    return rides.select("person", "line", "access_facility", "egress_facility", F.expr(f"dep_ns div {NS}").alias("waits_s"), F.expr(f"boarding_ns div {NS}").alias("boards_s"), F.expr(f"trav_ns div {NS}").alias("trav_s"), "aborted")


_TRANSIT = f"""with {_AG}, b as (select *, (t + 1800 - 121) // 1800 * 1800 as bus from ag)
select scenario || '/' || person as person, 'L' as line, 's1' as access_facility, 's2' as egress_facility, t as waits_s, bus + 120 as boards_s, bus + 1200 - t as trav_s, false as aborted from b where bus < 86400
union all select scenario || '/' || person, null, null, null, t, null, null, true from b where bus >= 86400"""


def adaptive_routes(spark, sf):
    """SIM-22, EXT-06: agents with a horizon look for a route before they leave and take the short way; the others drive as planned."""
    rows = [("a", "p", "q", 10.0, 10.0, 36_000.0, 50.0), ("b", "q", "r", 2000.0, 10.0, 36_000.0, 500.0), ("d", "q", "r", 1000.0, 10.0, 36_000.0, 500.0), ("c", "r", "s", 10.0, 10.0, 36_000.0, 500.0)]
    links = spark.createDataFrame(rows, _LINK).withColumn("modes", F.array(F.lit("car")))
    nodes = spark.createDataFrame([(n, 0.0, 0.0) for n in "pqrs"], "id string, x double, y double")
    agents = _agents(spark, sf)
    horizon = F.when(F.col("person").cast("long") % 2 == 1, F.lit(600 * NS))
    got = mobsim.simulate(_elements(agents, _driving(), horizon), links, settings=mobsim.Settings(end_s=_END), graph=routing.build_graph(nodes, links, "car"), types=["entered link"])
    return got.filter("type = 'entered link' and link in ('b', 'd')").select("scenario", F.regexp_replace("vehicle", "_car$", "").alias("person"), "link")


def experienced_teleports(spark, sf):
    """STR-06, STR-07, SNK-10: the plans rebuilt from the log of teleported agents, with the score of the plan they come from."""
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 3600.0, 1.0), ("c", "q", "r", 10.0, 10.0, 3600.0, 1.0)], _LINK)
    leg = {"mode": F.lit("walk"), "routing_mode": F.lit("walk"), "route_type": F.lit("generic"), "start_link": F.lit("a"), "end_link": F.lit("c"), "trav_ns": F.lit(600 * NS)}
    agents = _agents(spark, sf)
    got = mobsim.simulate(_elements(agents, leg), links, settings=mobsim.Settings(end_s=86_400), types=["actend", "departure", "travelled", "arrival", "actstart", "stuckAndAbort"]).drop("scenario")  # no vehicles
    plans = sinks.experienced_output(experienced.experienced_plans(got, links), agents.select("person", F.col("t").cast("double").alias("score"), F.lit(None).cast("map<string,string>").alias("person_attributes")))
    s = lambda c: F.expr(f"{c} div {NS}")
    return plans.select("person", "elem_idx", F.coalesce("act_type", "mode").alias("what"), s("start_ns").alias("start_s"), s("end_ns").alias("end_s"), s("dep_ns").alias("dep_s"), s("trav_ns").alias("trav_s"), "score", "aborted")


_EXPERIENCED = f"""with {_AG}, s as (select *, cast(t as double) as score, t + 600 > 86400 as ab from ag)
select person, 0 as elem_idx, 'home' as what, null as start_s, t as end_s, null as dep_s, null as trav_s, score, false as aborted from s
union all select person, 1, 'walk', null, null, t, case when ab then null else 600 end, score, ab from s union all select person, 2, 'work', t + 601, null, null, null, score, false from s where t + 601 <= 86400"""


def stream_observations(spark, sf):
    """STR-01, STR-02, STR-03, STR-05: the log replayed as a stream of files; vehicles keep their state from batch to batch."""
    folder = _folder(spark, "stream")
    rows = ev.merged([log(spark, sf)]).withColumns({c: F.lit(None).cast(ev.KINDS.get(c, "string")) for c in ev.COLUMNS if c not in ("link", "vehicle", "network_mode")})
    rows = rows.select("time_ns", "seq", "type", *ev.COLUMNS)
    rows.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{folder}/log")
    stream = replay.stream_observations(replay.replay(spark, f"{folder}/log", 100)).drop("event_time")
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_STREAM = _OBS.replace("last_value(case when event_type = 'signup' then m end ignore nulls) over (partition by vehicle order by us rows unbounded preceding) as mode", "nullif(last_value(case event_type when 'signup' then m when 'purchase' then '' end ignore nulls) over (partition by vehicle order by us rows unbounded preceding), '') as mode") + " select * from obs"


def stream_windows(spark, sf):
    """STR-04, STR-13, PRJ-02, EXT-01: means of windows of a stream, and handlers by type and for everything."""
    folder = _folder(spark, "windows")
    rows = ev.merged([log(spark, sf)]).withColumns({c: F.lit(None).cast(ev.KINDS.get(c, "string")) for c in ev.COLUMNS if c not in ("link", "vehicle", "network_mode")})
    rows.select("time_ns", "seq", "type", *ev.COLUMNS).repartitionByRange(3, "seq").write.parquet(f"{folder}/log")
    keep = lambda name: lambda batch, number: batch.groupBy("type").count().withColumn("handler", F.lit(name)).write.mode("append").parquet(f"{folder}/out")
    q = replay.subscribe(replay.replay(spark, f"{folder}/log", 2), {"*": keep("all"), "entered link": keep("entered")}, f"{folder}/state")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{folder}/out").groupBy("handler", "type").agg(F.sum("count").alias("n"))


def window_means(spark, sf):
    """STR-04, STR-13: mean travel times by windows of two hours that slide by one, of the streaming operator in batch."""
    from veloframe.operators import traveltime

    per = replay.windowed_means(traveltime.observations(log(spark, sf)), "2 hours", "1 hour")
    return per.select("mode", "link", F.expr("unix_seconds(window.start)").alias("start_s"), F.round("mean_ns", 1).alias("mean_ns"), "n")


_WINDOWS = f"{_OBS} select mode, link, (enter_ns // 3600000000000 - k) * 3600 + 946684800 as start_s, round(avg(travel_ns), 1) as mean_ns, count(*) as n from obs, (values (0), (1)) v(k) group by all"


# sources and sinks: what is written comes back


def network_xml(spark, sf):
    """SRC-01, SRC-02, SRC-04, SNK-01, SNK-06, FUN-24, FUN-25: the network as a compressed XML file with an attribute put over each link, scanned again."""
    path = _folder(spark, "network") + ".xml.gz"
    n = table(spark, sf, "nodes").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("seq").alias("seq"))
    l = table(spark, sf, "links").groupBy("id").agg(*(F.min(c).alias(c) for c in ("from_node", "to_node", "length_m", "freespeed", "permlanes", "seq")), F.min(F.coalesce("capacity", F.lit(-1.0))).alias("capacity"), F.max(F.array_join("modes", ",")).alias("m"))  # noqa: E741
    l = l.withColumn("modes", F.split("m", ",")).withColumn("attributes", F.lit(None).cast("map<string,string>"))  # noqa: E741
    l = sinks.merged_attributes(l, l.select("id", F.create_map(F.lit("lanes"), F.col("permlanes").cast("int").cast("string")).alias("attributes")))  # noqa: E741
    sinks.write_network_xml(n, l, path, 7.0, "gzip", single_file=True)
    nodes, links, cell = xml.network(spark, path)
    ends = links.join(nodes.select(F.col("id").alias("to_node"), "x", "y"), "to_node")
    return ends.select("id", "from_node", "to_node", "length_m", "capacity", "freespeed", "x", "y", F.array_join("modes", ",").alias("modes"), F.col("attributes")["lanes"].alias("lanes"), F.lit(cell).alias("cell"))


_NETWORK_XML = """with n as (select id, min(x) as x, min(y) as y from nodes group by id), l as (select id, min(from_node) as f, min(to_node) as t, min(length_m) as len, min(freespeed) as sp, min(coalesce(capacity, -1.0)) as cap, min(permlanes) as lanes, max(array_to_string(modes, ',')) as modes from links group by id)
select l.id, f as from_node, t as to_node, len as length_m, cap as capacity, sp as freespeed, x, y, modes, cast(cast(trunc(lanes) as int) as varchar) as lanes, 7.0::double as cell from l join n on n.id = t"""


def facilities_xml(spark, sf):
    """SRC-08, SNK-07: facilities and their opening times as XML, scanned again."""
    path = _folder(spark, "facilities") + ".xml"
    f = table(spark, sf, "facilities").select("id", "x", "y", F.lit(None).cast("string").alias("link")).distinct()
    sinks.write_facilities_xml(f, table(spark, sf, "opening_times").filter("start_ns >= 0 and end_ns >= 0 and act_type is not null"), path, single_file=True)
    _, _, opening = xml.facilities(spark, path)
    return opening.groupBy("facility", "act_type", F.lower("open_day").alias("open_day"), "start_ns", "end_ns").agg(F.count(F.lit(1)).alias("n"))


_FACILITIES_XML = "select facility, act_type, lower(coalesce(open_day, 'wk')) as open_day, start_ns, end_ns, count(*) as n from opening_times where start_ns >= 0 and end_ns >= 0 and act_type is not null and facility in (select id from facilities) group by all"


def transit_xml(spark, sf):
    """SRC-07, SNK-07: orders as lines whose suppliers are stops, written as a schedule and scanned again."""
    path = _folder(spark, "transit") + ".xml"
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))  # noqa: E741
    text = lambda c: F.col(c).cast("string")
    stops = l.select(text("l_orderkey").alias("line"), F.lit("r").alias("route"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("stop & "), text("s")).alias("facility"), F.when(F.col("s") % 3 != 0, F.col("l_linenumber").cast("long") * (60 * NS)).cast("long").alias("arr_ns"), (F.col("l_linenumber").cast("long") * (60 * NS) + 30 * NS).cast("long").alias("dep_ns"))
    orders = table(spark, sf, "orders").select(text("o_orderkey").alias("line"), F.lit("r").alias("route"))
    tables = {
        "stop_facilities": stops.select(F.col("facility").alias("id"), F.lit(None).cast("string").alias("link")).distinct(),
        "routes": orders.select("line", "route", F.lit("bus").alias("mode"), F.array(F.lit("a"), F.lit("b")).alias("links")),
        "route_stops": stops,
        "departures": orders.select("line", "route", F.lit("d").alias("id"), (F.col("line").cast("long") % 90_000 * NS).alias("dep_ns"), F.lit("v").alias("vehicle")),
    }
    sinks.write_transit_xml(tables, path, single_file=True)
    t = xml.transit(spark, path)
    s = t["route_stops"].join(t["departures"].select("line", F.col("dep_ns").alias("at_ns")), "line", "left")
    return s.select("line", F.row_number().over(Window.partitionBy("line").orderBy("pos")).alias("i"), "facility", "arr_ns", "dep_ns", "at_ns")


_TRANSIT_XML = """with l as (select l_orderkey as o, l_linenumber as n, min(l_suppkey) as s from lineitem group by all)
select cast(o as varchar) as line, row_number() over (partition by o order by n) as i, 'stop & ' || s as facility, case when s % 3 <> 0 then n * 60000000000 end as arr_ns, n * 60000000000 + 30000000000 as dep_ns, case when o_orderkey is not null then o % 90000 * 1000000000 end as at_ns from l join orders on o_orderkey = o"""


def vehicles_xml(spark, sf):
    """SRC-06, SNK-07, JON-01: vehicle types of market segments and vehicles of customers, written, scanned and looked up again."""
    path = _folder(spark, "vehicles") + ".xml"
    c = table(spark, sf, "customer")
    types = c.groupBy(F.col("c_mktsegment").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("length"), F.lit(2.0).alias("width"), F.max("c_nationkey").cast("double").alias("max_v"), F.lit(1.5).alias("pce"), F.lit("car").alias("net_mode"), F.lit(1.0).alias("fef"))
    sinks.write_vehicles_xml(types, c.select(F.col("c_custkey").cast("string").alias("vehicle"), F.col("c_mktsegment").alias("type")), path, single_file=True)
    return xml.vehicles(spark, path)[1]


_VEHICLES_XML = "select cast(c_custkey as varchar) as vehicle, c_mktsegment as type, m as max_v, 1.5::double as pce from customer join (select c_mktsegment as s, cast(max(c_nationkey) as double) as m from customer group by 1) on s = c_mktsegment"


def population_xml(spark, sf):
    """SRC-05, SNK-05, PRJ-05, FUN-22, FUN-23: orders as plans of one activity per line, written as XML and scanned again."""
    path = _folder(spark, "population") + ".xml"
    l = table(spark, sf, "lineitem")  # noqa: E741
    e = l.select(F.col("l_orderkey").cast("string").alias("person"), F.lit(0).alias("plan_idx"), (F.col("l_linenumber") - 1).cast("int").alias("elem_idx"), F.lit("act").alias("kind"), F.concat(F.lit("part <"), "l_partkey", F.lit("> & co")).alias("act_type"), F.col("l_suppkey").cast("string").alias("link"), (F.col("l_quantity").cast("long") * NS).alias("end_ns"), F.lit(True).alias("selected"), F.lit(1.5).alias("score"))
    sinks.write_population_xml(e, path, single_file=True)
    return xml.population(spark, path).select("person", "elem_idx", "act_type", "link", "end_ns", "selected", "score")


_POPULATION_XML = """select cast(l_orderkey as varchar) as person, cast(row_number() over (partition by l_orderkey order by l_linenumber, 'part &lt;' || l_partkey || '&gt; &amp; co" link="' || l_suppkey || '"' || l_quantity) - 1 as integer) as elem_idx, 'part <' || l_partkey || '> & co' as act_type, cast(l_suppkey as varchar) as link, cast(l_quantity as bigint) * 1000000000 as end_ns, true as selected, 1.5::double as score from lineitem"""


def events_xml(spark, sf):
    """SRC-09, SRC-10, SRC-22, SRC-23, SRC-24, SNK-02, SNK-04, SNK-08: the log in three event files of one folder, plain and by rank, merged in order of time."""
    folder = _folder(spark, "events")
    l = log(spark, sf).filter("type <> 'generic'").select("time_ns", "seq", "type", "link", "vehicle", "network_mode")  # noqa: E741
    l = l.withColumns({c: F.lit(None).cast(ev.KINDS.get(c, "string")) for c in ev.COLUMNS if c not in ("link", "vehicle", "network_mode")})  # noqa: E741
    shutil.os.makedirs(folder)
    for i in range(3):
        sinks.write_events_xml(l.filter(F.col("seq") % 3 == i), f"{folder}/events.{i}.xml", single_file=True)
    return folders.read_folder(spark, folder).select("seq", "time_ns", "type", "link", "vehicle")


_EVENTS_XML = f"with {_LOG} select row_number() over (order by us) - 1 as seq, us * 1000 as time_ns, type, link, vehicle from log where type <> 'generic'"


def scenario_tables(spark, sf):
    """SRC-11, SRC-13, SRC-14, SRC-15, SRC-16, SRC-17, SRC-18, SRC-19, SRC-25, SNK-03, PRJ-11: a scenario in the binary format, read with a predicate, and its table of ids."""
    folder = _folder(spark, "scenario")
    folders.write_scenario({"nodes": table(spark, sf, "nodes"), "links": table(spark, sf, "links")}, folder)
    t = folders.read_scenario(spark, folder, ["nodes", "links"])
    return folders.id_table({"node": folders.filtered(t["nodes"], "x > 0"), "link": folders.filtered(t["links"], "length_m > 100")})


_IDS = "select 'node' as kind, row_number() over (order by s, id) - 1 as ord, id from (select id, min(seq) as s from nodes where x > 0 group by id) union all select 'link', row_number() over (order by s, id) - 1, id from (select id, min(seq) as s from links where length_m > 100 group by id)"


def profile_files(spark, sf):
    """SNK-12, SNK-13, SNK-14: routing spans as CSV and as Parquet, read again."""
    folder = _folder(spark, "profile")
    r = table(spark, sf, "routing_spans").withColumn("ts", F.expr("unix_micros(cast(ts as timestamp))"))
    sinks.write_profile(r, f"{folder}/csv", "csv")
    sinks.write_profile(r, f"{folder}/parquet")
    count = lambda df, kind: df.groupBy("func_target", "func_name").agg(F.count("duration_ns").alias("n"), F.min("duration_ns").cast("long").alias("least"), F.max("duration_ns").cast("long").alias("most"), F.count_distinct("request_uuid").alias("requests")).withColumn("kind", F.lit(kind))
    csv = spark.read.option("header", True).csv(f"{folder}/csv").withColumn("duration_ns", F.col("duration_ns").cast("long"))
    return count(csv, "csv").unionByName(count(spark.read.parquet(f"{folder}/parquet"), "parquet"))


_PROFILE = "with p as (select func_target, func_name, count(duration_ns) as n, min(duration_ns) as least, max(duration_ns) as most, count(distinct request_uuid) as requests from routing_spans group by all) select *, 'csv' as kind from p union all select *, 'parquet' from p"


def neighbour_files(spark, sf):
    """SNK-16, RTE-20, RTE-18: neighbours of 2 and 4 parts by coordinate bisection, in one folder of CSV files."""
    folder = _folder(spark, "neighbours")
    n, l = table(spark, sf, "nodes").select("id", "x", "y").distinct(), table(spark, sf, "links")  # noqa: E741
    parts = {k: network.partitions(n, k) for k in (2, 4)}
    for k, p in parts.items():
        sinks.write_neighbours(network.neighbour_counts(l, p, ["car"]), k, folder)
    got = spark.read.option("header", True).csv(folder)
    size = reduce(DataFrame.unionAll, [p.groupBy("partition_no").count().select(F.lit(k).alias("k"), "partition_no", "count") for k, p in parts.items()])
    total = n.count()
    even = size.groupBy("k").agg((F.max("count") - F.min("count") <= F.lit(total) * 0.05).alias("even"))
    return got.groupBy(F.col("size").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("parts"), (F.max(F.col("neighbors").cast("int")) < F.col("k")).alias("bounded")).join(even, "k")


def output_names(spark, sf):
    """SNK-08, SNK-04, PRJ-12: the file of each iteration of a run that writes every third one and the last, and the file of the whole run."""
    it = sorted(r[0] for r in table(spark, sf, "act_starts").select("iteration").distinct().collect())  # one row an iteration
    rows = [(i, sinks.output_name("events.xml", "run", i), sinks.due(i, it[-1], 3)) for i in it] + [(-1, sinks.output_name("events.xml"), True)]
    return spark.createDataFrame(rows, "iteration int, name string, due boolean")


def order_of_times(spark, sf):
    """FUN-05, PRJ-12: times between consecutive events of a user, never negative, whichever is taken from the other."""
    l = log(spark, sf)  # noqa: E741
    before = F.lag("time_ns").over(Window.partitionBy("vehicle").orderBy("seq"))
    return l.withColumn("b", before).select("event_id", times.minus(F.col("time_ns"), F.col("b")).alias("after"), times.minus(F.col("b"), F.col("time_ns")).alias("back"))


SQL = {
    "queue_flow": _QUEUE_FLOW, "queue_storage": _stored(100, 101), "queue_waves": _stored(150, 168),
    "queue_fifo": f"{_OUT} select scenario, person, t + 1 as entered_s, cast(max(x) over (partition by scenario order by i rows unbounded preceding) + 1 as bigint) as left_s from o",
    "queue_passing": f"{_OUT} select scenario, person, t + 1 as entered_s, x + 1 as left_s from o",
    "stuck_at_end": f"with {_AG} select scenario, person, case when t < 86400 then case when t + 1 > 86400 then 'a' else case when t + 1 + 3601 > 86400 then 'b' else 'c' end end end as link, 86400::bigint as at_s from ag where t + 3603 > 86400",
    "transit_rides": _TRANSIT,
    "adaptive_routes": f"with {_AG} select scenario, person, case when event_id % 2 = 1 then 'd' else 'b' end as link from ag",
    "experienced_teleports": _EXPERIENCED,
    "stream_observations": _STREAM,
    "stream_windows": f"with {_LOG} select 'all' as handler, type, cast(count(*) as bigint) as n from log group by type union all select 'entered', type, count(*) from log where type = 'entered link' group by type",
    "window_means": _WINDOWS,
    "network_xml": _NETWORK_XML, "facilities_xml": _FACILITIES_XML, "transit_xml": _TRANSIT_XML, "vehicles_xml": _VEHICLES_XML, "population_xml": _POPULATION_XML, "events_xml": _EVENTS_XML, "scenario_tables": _IDS, "profile_files": _PROFILE,
    "neighbour_files": "select * from (values (2, 2, true, true), (4, 4, true, true)) v(k, parts, bounded, even)",
    "output_names": "select iteration, 'run.' || iteration || '.events.xml' as name, iteration % 3 = 0 or iteration = m as due from (select distinct iteration from act_starts), (select max(iteration) as m from act_starts) union all select -1, 'output_events.xml', true",
    "order_of_times": f"with {_LOG}, v as (select *, lag(us) over (partition by vehicle order by us) as b from log) select event_id, case when b is not null then (us - b) * 1000 end as after, case when b is not null then 0 end as back from v",
}
QUERIES = {f.__name__: f for f in (queue_flow, queue_storage, queue_waves, queue_fifo, queue_passing, stuck_at_end, transit_rides, adaptive_routes, experienced_teleports, stream_observations, stream_windows, window_means, network_xml, facilities_xml, transit_xml, vehicles_xml, population_xml, events_xml, scenario_tables, profile_files, neighbour_files, output_names, order_of_times)}
