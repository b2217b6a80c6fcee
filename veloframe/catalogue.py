"""Queries that run the engine's operators over the test tables, with the SQL that gives the same rows.

The events table is read as a vehicle log: users drive, sign-ups enter traffic, views enter links, clicks leave them, purchases leave traffic.
Orders are plans of customers, scored by their price. The road network and the persons are the tables of that name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veloframe.functions import attributes, geometry, times
from veloframe.operators import events as ev
from veloframe.operators import experienced, mobsim, network, planops, routing, scoring, selection, transit, traveltime
from veloframe.streaming import replay

DAY_US, BIN_NS = 86_400_000_000, 3_600_000_000_000
LAST_NS = times.DAY_NS - 1
START_NS = 757_382_400 * times.NS  # the first of January 2024, when the log begins


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a vehicle log; times are ns since the first of January 2000 and ``seq`` is the time in microseconds."""
    e = table(spark, sf, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2000-01-01 00:00:00', ts)")
    kind = F.col("event_type")
    name = F.when(kind == "signup", "vehicle enters traffic").when(kind == "view", "entered link").when(kind == "click", "left link").when(kind == "purchase", "vehicle leaves traffic").otherwise("generic")
    return e.select((us * 1000).alias("time_ns"), us.alias("seq"), name.alias("type"), F.col("user_id").cast("string").alias("vehicle"), F.concat(F.lit("l"), (F.col("event_id") % 5).cast("string")).alias("link"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("network_mode"), "event_id", "value", "user_id", "event_type", "props")


_LOG = """log as (select event_id, user_id, event_type, value, props, date_diff('microsecond', timestamp '2000-01-01', ts) as us, cast(user_id as varchar) as vehicle, 'l' || (event_id % 5) as link, 'm' || (event_id % 3) as m,
 case event_type when 'signup' then 'vehicle enters traffic' when 'view' then 'entered link' when 'click' then 'left link' when 'purchase' then 'vehicle leaves traffic' else 'generic' end as type from events)"""
_OBS = f"""with {_LOG}, v as (select *, last_value(case when event_type = 'signup' then m end ignore nulls) over (partition by vehicle order by us rows unbounded preceding) as mode,
 lag(type) over w as bt, lag(us) over w as bu, lag(link) over w as bl from log where event_type in ('signup', 'view', 'click', 'purchase') window w as (partition by vehicle order by us)),
obs as (select mode, bl as link, bu * 1000 as enter_ns, (us - bu) * 1000 as travel_ns from v where type = 'left link' and bt = 'entered link')"""
_HOUR = "least((enter_ns % 86400000000000) // 3600000000000, 23)"


def event_type_view(spark, sf):
    """PRJ-01."""
    return ev.of_type(log(spark, sf), "entered link").select("seq", "link", "vehicle")


def pair_enter_leave(spark, sf):
    """JON-12, STR-05."""
    return traveltime.observations(log(spark, sf))


def asof_mode(spark, sf):
    """JON-11."""
    return traveltime.asof_mode(log(spark, sf)).select("event_id", "mode")


def _bins(spark, sf):
    return traveltime.binned(traveltime.observations(log(spark, sf)).withColumn("enter_ns", F.col("enter_ns") % times.DAY_NS), BIN_NS, LAST_NS)


def tt_bins_mean(spark, sf):
    """STR-04, AGG-01, AGG-02, FUN-07."""
    return _bins(spark, sf).select("mode", "link", "bin", F.round("mean_ns", 1).alias("mean_ns"), "n")


def _dense(spark, sf):
    b = _bins(spark, sf).withColumn("mean_ns", F.floor("mean_ns"))
    return traveltime.dense(b, ["mode", "link"], times.bin_count(LAST_NS, BIN_NS), "mean_ns", F.lit(0).cast("long"))


def dense_bins(spark, sf):
    """FUN-07: every bin of every observed link."""
    return _dense(spark, sf).select("mode", "link", "bin", "mean_ns")


def tt_decay_fill(spark, sf):
    """WIN-01."""
    return traveltime.decayed(_dense(spark, sf), ["mode", "link"], BIN_NS).select("mode", "link", "bin", "mean_ns")


def tt_interpolate(spark, sf):
    """WIN-02: times at the entering of each observation."""
    d = traveltime.interpolated(traveltime.decayed(_dense(spark, sf), ["mode", "link"], BIN_NS), ["mode", "link"], BIN_NS)
    o = traveltime.observations(log(spark, sf)).withColumn("t", F.col("enter_ns") % times.DAY_NS).withColumn("bin", times.time_bin(F.col("t"), BIN_NS, LAST_NS).cast("long"))
    j = o.join(d, (o["mode"].eqNullSafe(d["mode"])) & (o["link"] == d["link"]) & (o["bin"] == d["bin"]))
    return j.select("enter_ns", o["link"], F.round(traveltime.at_time(F.col("t"), BIN_NS, F.col("mean_ns"), F.col("previous_value"), F.col("next_value"), d["bin"]), 0).cast("long").alias("travel_ns"))


def tt_lookup_default(spark, sf):
    """FUN-09, FUN-11: links of the network, of which some have been observed, at noon."""
    links = table(spark, sf, "links").groupBy("id").agg(F.first("length_m").alias("length_m"), F.first("freespeed").alias("freespeed"))
    bins = links.filter("length_m > 5000").select(F.lit("car").alias("mode"), F.col("id").alias("link"), F.lit(12).cast("long").alias("bin"), F.lit(500e9).alias("mean_ns"))
    got = traveltime.link_times(links, bins, "car", links.select(F.col("id").alias("link"), F.lit(12 * BIN_NS).alias("time_ns")), BIN_NS, LAST_NS, 20.0)
    return got.select("link", F.round("travel_ns", 0).alias("travel_ns"))


def interval_occupancy(spark, sf):
    """JON-09: views within the user's time between a sign-up and the next sign-up or purchase."""
    l = log(spark, sf).withColumn("person", F.concat(F.lit("p"), "vehicle"))  # noqa: E741
    rides = l.filter("event_type in ('signup', 'purchase')").withColumn("type", F.when(F.col("event_type") == "signup", "PersonEntersVehicle").otherwise("PersonLeavesVehicle"))
    occ = experienced.occupancy(rides).filter("leave_seq is not null")
    return experienced.occupied(occ, l.filter("event_type = 'view'")).select("person", "event_id")


def asof_stop(spark, sf):
    """JON-10: where each transit vehicle is at its views; sign-ups are driver starts and clicks arrivals."""
    l = log(spark, sf)  # noqa: E741
    kind = F.when(F.col("event_type") == "signup", "TransitDriverStarts").when(F.col("event_type") == "click", "VehicleArrivesAtFacility").otherwise("generic")
    e = l.withColumn("type", kind).withColumns({"transit_line": F.col("network_mode"), "transit_route": F.col("network_mode"), "facility": F.col("link"), "driver": F.col("vehicle")})
    return experienced.last_stop(e).filter("event_type = 'view'").select("event_id", F.col("at_line").alias("line"), F.col("at_stop_now").alias("stop"))


def _elements(spark, sf):
    """Sign-ups are main activities, errors interactions, the rest legs, of one plan per user."""
    w = Window.partitionBy("user_id").orderBy("seq")
    e = log(spark, sf).withColumn("elem_idx", F.row_number().over(w) - 1)
    act = F.col("event_type").isin("signup", "error")
    return e.select(F.col("vehicle").alias("person"), F.lit(0).alias("plan_idx"), "elem_idx", F.when(act, "act").otherwise("leg").alias("kind"), F.when(F.col("event_type") == "signup", "home").when(F.col("event_type") == "error", "car interaction").alias("act_type"), F.when(~act, F.col("event_type")).alias("mode"), F.when(~act & (F.col("event_id") % 2 == 0), F.col("event_type")).alias("routing_mode"), F.col("time_ns").alias("end_ns"), "event_id")


def trip_segments(spark, sf):
    """WIN-04, PLN-01."""
    return planops.trip_spans(_elements(spark, sf)).select("person", F.col("trip").cast("long").alias("trip"), "origin_idx", "destination_idx")


def trip_main_mode(spark, sf):
    """AGG-13."""
    return planops.main_modes(_elements(spark, sf)).select("person", F.col("trip").cast("long").alias("trip"), "main_mode")


def next_trips(spark, sf):
    """PLN-02: the first trip from the tenth element on."""
    return planops.next_trip(planops.trip_spans(_elements(spark, sf)), F.lit(10)).select("person", "origin_idx", "destination_idx")


def clock_elements(spark, sf):
    """Every fourth element has a fixed end, interactions last a minute, legs ten minutes, but for every seventh."""
    el = _elements(spark, sf)
    fixed = F.col("event_id") % 4 == 0
    return el.withColumns({"end_ns": F.when(fixed & (F.col("kind") == "act"), F.col("end_ns")), "max_dur_ns": F.when((F.col("kind") == "act") & (F.col("act_type") != "home"), F.lit(60 * times.NS).cast("long")), "trav_ns": F.when(F.col("event_id") % 7 != 0, F.lit(600 * times.NS).cast("long")), "route_trav_ns": F.lit(None).cast("long")})


def plan_clock(spark, sf):
    """WIN-05."""
    return planops.plan_times(clock_elements(spark, sf)).select("person", "elem_idx", "at_ns")


def overnight_wrap(spark, sf):
    """WIN-09, SCO-03: scored intervals of users whose sign-ups are activities."""
    el = _elements(spark, sf).filter("kind = 'act'").withColumns({"start_ns": F.col("end_ns") % times.DAY_NS, "end_ns": F.col("end_ns") % times.DAY_NS + 60 * times.NS, "aborted": F.lit(False)})
    return scoring.intervals(el).select("person", "elem_idx", F.round("arrival_s", 6).alias("arrival_s"), F.round("departure_s", 6).alias("departure_s"))


def activity_utility(spark, sf):
    """FUN-18, SCO-04: orders as activities of their price in seconds, open from 50,000 to 200,000."""
    o = table(spark, sf, "orders")
    d, w = scoring.opened(F.lit(0.0), F.col("o_totalprice"), F.lit(50_000.0), F.lit(200_000.0))
    return o.select("o_orderkey", F.round(scoring.activity_utility(d, F.lit(28_800.0), F.lit(6 / 3600)), 6).alias("utility"), F.round(w, 6).alias("waiting_s"))


def order_check(spark, sf):
    """WIN-11: events of a user that stand right after a later one, in a shuffled order."""
    e = log(spark, sf).withColumn("seq", F.col("event_id") * 7919 % 1_000_003)
    return ev.out_of_order(e, "vehicle").select("event_id", "time_ns", "previous_ns")


def plans(spark, sf):
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("plan_idx"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("score"), (F.row_number().over(w.orderBy(F.col("o_orderkey").desc())) == 1).alias("selected"), F.col("o_orderdate"))


_PLANS = "p as (select o_custkey as person, o_orderkey as plan_idx, case when o_orderkey % 17 <> 0 then o_totalprice end as score, row_number() over (partition by o_custkey order by o_orderkey desc) = 1 as selected from orders)"
U = lambda key: (F.col(key).cast("long") * F.lit(2654435761) % F.lit(1 << 32)) / F.lit(float(1 << 32))
_U = "((person * 2654435761) % 4294967296) / 4294967296.0::double"


def keep_last(spark, sf):
    """SEL-01, PRJ-04."""
    return selection.keep_selected(plans(spark, sf))


def best_plan(spark, sf):
    """SEL-02."""
    return selection.best(plans(spark, sf))


def worst_plan(spark, sf):
    """SEL-04."""
    return selection.worst(plans(spark, sf))


def random_plan(spark, sf):
    """SEL-03."""
    return selection.at_random(plans(spark, sf), U("person"))


def plan_memory(spark, sf):
    """SEL-06."""
    return selection.bounded(plans(spark, sf), 5).select("person", "plan_idx")


def softmax_probs(spark, sf):
    """SEL-05."""
    return selection.logit(plans(spark, sf), 1e-5).select("person", "plan_idx", F.round("probability", 9).alias("probability"))


def softmax_pick(spark, sf):
    """SEL-05."""
    return selection.by_logit(plans(spark, sf), U("person"), 1e-5)


def strategy_pick(spark, sf):
    """SEL-07, SEL-08."""
    w = spark.createDataFrame([("BUILDING", "BestScore", 1.0), ("BUILDING", "ReRoute", 3.0), ("BUILDING", "SelectExpBeta", 0.0), ("MACHINERY", "KeepLastSelected", 2.0), ("MACHINERY", "SelectRandom", 5.0), ("FURNITURE", "ReRoute", 1.0)], "subpopulation string, strategy string, weight double")
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("subpopulation"))
    return selection.strategies(p, w, U("person"))


def copied_plans(spark, sf):
    """SEL-09, SEL-10: customers of every third number get a copy of their selected plan."""
    p = plans(spark, sf).drop("o_orderdate")
    return selection.copy_selected(p, p.filter("person % 3 = 0").select("person")).select("person", "plan_idx", "score", "selected")


def event_multiset_diff(spark, sf):
    """SET-02: a copy in which every tenth event is another one, every 23rd missing and every 31st twice."""
    a = log(spark, sf).select("time_ns", "seq", "type", "link", "vehicle")
    b = log(spark, sf).filter("event_id % 23 <> 0").withColumn("link", F.when(F.col("event_id") % 10 == 0, "other").otherwise(F.col("link")))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 31 == 0, 2).otherwise(1)))).select("time_ns", "seq", "type", "link", "vehicle")
    d = ev.difference(a, b, ["link", "vehicle"])
    return d.select("time_ns", F.get_json_object("event", "$.link").alias("link"), F.get_json_object("event", "$.vehicle").alias("vehicle"), "n_first", "n_second")


def merge_sorted(spark, sf):
    """SET-01, SRC-22: per-type logs merged by time."""
    l = log(spark, sf)  # noqa: E741
    return ev.merged([l.filter(F.col("event_type") == t).select("time_ns", "seq", "event_id") for t in ("view", "click", "purchase", "signup", "error")]).select("event_id", "seq")


def _points(spark, sf):
    f = table(spark, sf, "facilities").filter("x is not null and y is not null and not (x = 0 and y = 0)")
    return f.select("id", "x", "y", "link").distinct()


def nearest_node(spark, sf):
    """JON-08."""
    return network.nearest_node(_points(spark, sf), table(spark, sf, "nodes")).select("id", "node", F.round("distance", 6).alias("distance"))


def nearest_by_mode(spark, sf):
    """JON-05, JON-06, FUN-15, FUN-16."""
    return network.nearest_link(_points(spark, sf), table(spark, sf, "links"), table(spark, sf, "nodes"), "bike").select("id", "link", F.round("distance", 6).alias("distance"))


def modal_fallback(spark, sf):
    """JON-07."""
    return network.modal_link(_points(spark, sf), table(spark, sf, "links"), table(spark, sf, "nodes"), "bike")


def set_or_default(spark, sf):
    """JON-03, JON-04: parameters of the market segment or of the default."""
    sets = spark.createDataFrame([("BUILDING", 8.0), ("AUTOMOBILE", 4.0), (None, 6.0)], "subpopulation string, performing double")
    p = scoring.set_or_default(table(spark, sf, "customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("subpopulation")), sets)
    return p.join(F.broadcast(sets.withColumnRenamed("subpopulation", "_n")), F.col("_set").eqNullSafe(F.col("_n"))).select("person", "performing")


def semi_partition(spark, sf):
    """JON-15, PLN-18, SRC-25: facilities by the partition of their link's end."""
    parts = table(spark, sf, "nodes").select(F.col("id").alias("node"), "partition_no").distinct()
    l = network.link_partitions(table(spark, sf, "links").select("id", "from_node", "to_node").distinct(), parts)  # noqa: E741
    return _points(spark, sf).join(l.select(F.col("id").alias("link"), "partition_no"), "link").groupBy("partition_no").agg(F.count(F.lit(1)).alias("n"))


def route_counts(spark, sf):
    """AGG-03: suppliers as links, orders as routes."""
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("links"))
    return network.traversals(r)


def mode_links(spark, sf):
    """PRJ-08, PRJ-09, AGG-10, FUN-25: links per mode and links without any."""
    l = table(spark, sf, "links")  # noqa: E741
    per = l.select("id", F.explode("modes").alias("mode")).groupBy("mode").agg(F.count_distinct("id").alias("n"))
    return per.unionByName(network.without_modes(l).agg(F.count_distinct("id").alias("n")).withColumn("mode", F.lit("none")))


def undirected_edges(spark, sf):
    """AGG-08."""
    return network.undirected_edges(table(spark, sf, "links").select("id", "from_node", "to_node", "permlanes").distinct(), F.col("permlanes") / 2)


def vertex_weights(spark, sf):
    """AGG-07."""
    l = table(spark, sf, "links").select("id", "from_node", "to_node", "capacity").distinct()  # noqa: E741
    return network.vertex_weights(table(spark, sf, "nodes"), l).withColumn("in_capacity", F.round("in_capacity", 6))


def neighbour_counts(spark, sf):
    """AGG-11, SNK-16."""
    parts = table(spark, sf, "nodes").select(F.col("id").alias("node"), "partition_no").distinct()
    return network.neighbour_counts(table(spark, sf, "links"), parts, ["car"])


def route_lengths(spark, sf):
    """AGG-05, PLN-08: routes of the links that leave a node, in order, from the middle of the first to the middle of the last."""
    l = table(spark, sf, "links").groupBy("id").agg(F.max("length_m").alias("length_m"), F.first("from_node").alias("from_node"))  # noqa: E741
    routes = l.groupBy(F.col("from_node").alias("route_id")).agg(F.array_sort(F.collect_list("id")).alias("links"))
    return network.route_distance(routes, l, "route_id", F.lit(0.5), F.lit(0.5)).withColumn("distance", F.round("distance", 4))


def route_validity(spark, sf):
    """WIN-12, PLN-11: pairs of links by number, of which few meet."""
    l = table(spark, sf, "links").select("id", "from_node", "to_node", "modes").distinct()  # noqa: E741
    a, b = l.select(F.col("id").alias("a"), F.col("to_node").alias("n")), l.select(F.col("id").alias("b"), F.col("from_node").alias("n"))
    met = a.join(b, "n").select(F.concat_ws(">", "a", "b").alias("route_id"), F.array("a", "b").alias("links"))
    bad = l.select(F.concat_ws(">", "id", F.lit("x")).alias("route_id"), F.array("id", F.lit("x")).alias("links"))
    return network.connected(met.union(bad), l, "route_id", "car").groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def _network(spark, sf):
    """One row per link."""
    l = table(spark, sf, "links").select("id", "from_node", "to_node", "length_m", "freespeed", "modes")  # noqa: E741
    return l.groupBy("id").agg(*(F.min(c).alias(c) for c in ("from_node", "to_node", "length_m", "freespeed")), F.first("modes").alias("modes"))


_LINKS = "l as (select id, min(from_node) as f, min(to_node) as t, min(length_m) as len, min(freespeed) as sp from links group by id)"


def kcore_dead_ends(spark, sf):
    """RTE-07."""
    return network.dead_ends(table(spark, sf, "nodes"), _network(spark, sf))


def node_components(spark, sf):
    """RTE-07: labels of connected parts."""
    return network.components(table(spark, sf, "nodes"), _network(spark, sf))


def hop_distance(spark, sf):
    """SEL-16: undirected hops from the smallest node that has a link."""
    l = _network(spark, sf)  # noqa: E741
    first = l.agg(F.min("from_node").alias("node"))
    return network.hop_distances(table(spark, sf, "nodes"), l, first)


def shortest_path(spark, sf):
    """RTE-03, RTE-06, FUN-10, FUN-12: free-speed times from one node by rounds of relaxation."""
    l = _network(spark, sf)  # noqa: E741
    e = l.select("from_node", "to_node", geometry.routing_time(F.col("length_m"), F.col("freespeed")).alias("cost"))
    return network.relaxed_costs(e, l.agg(F.min("from_node").alias("node"))).select("node", F.round("cost", 4).alias("cost"))


def shortest_path_kernel(spark, sf):
    """RTE-01, RTE-02, RTE-04, RTE-05, RTE-08, RTE-09, RTE-10: the same costs by A* with landmarks, to the beginning of every link."""
    l = _network(spark, sf)  # noqa: E741
    g = routing.build_graph(table(spark, sf, "nodes"), l)
    routing.prepare_landmarks(g, routing.choose_landmarks(g, network.landmark_count(len(g.nodes))), routing.free_cost(g))
    g.core = routing.dead_end_nodes(g)
    start = l.agg(F.min(F.struct("from_node", "to_node", "id")).alias("s")).first()["s"]
    requests = l.select(F.col("id").alias("request"), F.lit(start["id"]).alias("from_link"), F.col("id").alias("to_link"), F.lit(0.0).alias("dep_s")).filter(F.col("request") != start["id"])
    return routing.least_cost_paths(requests, g).select("request", F.round("cost", 4).alias("cost"))


def departure_sequence(spark, sf):
    """WIN-03: ships of an order by date, then line."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    d = l.select(F.col("l_orderkey").alias("line"), F.lit("r").alias("route"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("dep_ns"))
    return transit.sequences(d).select(F.col("line").alias("l_orderkey"), F.col("id").alias("l_linenumber"), F.col("sequence").cast("long").alias("sequence"))


def vehicle_copies(spark, sf):
    """PLN-15, AGG-12: parts of an order from one supplier as departures with one vehicle."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    d = l.select(F.col("l_orderkey").cast("string").alias("line"), F.col("l_partkey").cast("string").alias("route"), F.col("l_linenumber").cast("string").alias("id"), F.concat(F.lit("v"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).cast("string")).alias("vehicle"))
    return transit.own_vehicles(d).select("line", "id", "vehicle", "copied_from")


def transit_drivers(spark, sf):
    """PLN-17."""
    o = table(spark, sf, "orders")
    return transit.drivers(o.select(F.col("o_custkey").cast("string").alias("line"), F.col("o_orderpriority").alias("route"), F.col("o_orderkey").cast("string").alias("id"))).select("driver")


def vehicles_per_mode(spark, sf):
    """PLN-06: persons by modes, but for those that have a car."""
    p = table(spark, sf, "persons").select(F.col("id").alias("person")).distinct()
    have = p.filter("length(person) % 2 = 0").select(F.concat(F.col("person"), F.lit("_car")).alias("vehicle"))
    return planops.generated_vehicles(p, spark.createDataFrame([("car",), ("bike",)], "mode string"), have)


def delay_propagation(spark, sf):
    """WIN-14: delays along the lines of an order."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 40).alias("halt"))  # noqa: E741
    return transit.lindley(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "q"], F.col("q"), F.col("halt")).select("l_orderkey", "l_linenumber", "l_partkey", "delay")


def teleport_arrivals(spark, sf):
    """RTE-13, FUN-17, SIM-05: walks between the ends of the links."""
    e = network.with_ends(table(spark, sf, "links").select("id", "from_node", "to_node").distinct(), table(spark, sf, "nodes"))
    r = routing.teleported(e, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return r.select("id", F.round("distance_m", 6).alias("distance_m"), F.round(F.col("travel_ns") / 1e6, 0).cast("long").alias("travel_ms"))


def teleport_plans(spark, sf):
    """SIM-05: users' views and clicks as teleported legs of ten minutes after activities."""
    el = _elements(spark, sf).withColumns({"trav_ns": F.lit(600 * times.NS).cast("long"), "route_trav_ns": F.lit(None).cast("long"), "end_ns": F.when(F.col("kind") == "act", F.col("end_ns"))})
    return planops.teleport_schedule(el).select("person", "elem_idx", "dep_ns", "arr_ns")


def capacities(spark, sf):
    """FUN-27, FUN-28."""
    l = table(spark, sf, "links").filter("capacity is not null").select("id", "length_m", "permlanes", "freespeed", "capacity").distinct()  # noqa: E741
    c = [F.col(x) for x in ("length_m", "permlanes", "freespeed", "capacity")]
    return l.select("id", F.round(geometry.storage_capacity(*c, sample=0.1), 6).alias("queue"), F.round(geometry.storage_capacity(*c, sample=0.1, kinematic=True), 6).alias("waves"), F.round(geometry.flow_capacity(c[3], 0.1), 9).alias("flow"))


def time_parse(spark, sf):
    """FUN-01, FUN-02: the text of each activity start parsed again."""
    t = table(spark, sf, "act_starts").filter("time_ns is not null").select("seq", "logged_at", "time_ns")
    return t.select("seq", (times.parse_time(times.format_hms(F.col("time_ns"))) - F.col("time_ns")).alias("off_hms"), (times.parse_time(times.format_seconds(F.col("time_ns"))) - F.col("time_ns")).alias("off_s"))


def time_format(spark, sf):
    """FUN-03, FUN-04, FUN-06."""
    t = table(spark, sf, "act_starts").filter("time_ns is not null")
    return t.select("seq", "time_ns", times.format_hms(F.col("time_ns")).alias("clock"), times.to_tick(F.col("time_ns"), 10).alias("tick"), times.from_tick(times.to_tick(F.col("time_ns"), 3), 3).alias("tick_ns"))


def attr_default(spark, sf):
    """PRJ-17, FUN-21: persons' ages, 30 where there is none, and their attributes with one more."""
    p = table(spark, sf, "persons").groupBy("id").agg(F.max_by("attributes", F.struct("first_iter", F.to_json("attributes"))).alias("attributes"))
    more = attributes.merged(F.col("attributes"), F.create_map(F.lit("age"), F.lit("1"), F.lit("seen"), F.lit("yes")))
    return p.select("id", attributes.with_default(F.col("attributes"), "age", "int", 30).alias("age"), F.size(more).alias("n"), more["age"].alias("new_age"))


def start_summary(spark, sf):
    """PRJ-06, SEL-15: activity starts per iteration and hour, interactions apart."""
    a = table(spark, sf, "act_starts").filter("time_ns is not null")
    return a.groupBy("iteration", times.time_bin(F.col("time_ns"), BIN_NS, 30 * BIN_NS).alias("hour"), F.coalesce(attributes.is_interaction(F.col("act_type")), F.lit(False)).alias("interaction")).agg(F.count(F.lit(1)).alias("n"))


def simulated_teleports(spark, sf):
    """SIM-01..05, SIM-20, SIM-21: every user is a scenario; the kernel's departures and arrivals of plans with teleported legs."""
    el = _elements(spark, sf).withColumns({"route_trav_ns": F.lit(600 * times.NS).cast("long"), "end_ns": F.when(F.col("kind") == "act", F.expr(f"(end_ns - {START_NS}) div {times.NS} * {times.NS}")), "link": F.lit("l"), "scenario": F.col("person")})
    w = Window.partitionBy("person").orderBy("elem_idx")
    # a plan begins and ends with an activity and no activity follows another one
    first = F.min(F.when(F.col("kind") == "act", F.col("elem_idx"))).over(Window.partitionBy("person"))
    last = F.max(F.when(F.col("kind") == "act", F.col("elem_idx"))).over(Window.partitionBy("person"))
    el = el.withColumns({"f": first, "z": last}).filter("elem_idx between f and z").withColumn("nxt", F.lead("kind").over(w)).filter("not (kind = 'act' and coalesce(nxt, '') = 'act')")
    links = spark.createDataFrame([("l", "a", "b", 1.0, 1.0, 1.0, 1.0)], "id string, from_node string, to_node string, length_m double, freespeed double, capacity double, permlanes double")
    log_ = mobsim.simulate(el, links, settings=mobsim.Settings(end_s=400 * 86_400))
    return log_.filter("type in ('departure', 'arrival')").select("person", "time_ns", "type")


def leg_scores(spark, sf):
    """SCO-05, WIN-07, WIN-08, AGG-15: views and clicks as legs of ten minutes; a view is a transit leg."""
    el = _elements(spark, sf).withColumns({"trav_ns": F.lit(600 * times.NS).cast("long"), "distance": F.lit(1000.0), "dep_ns": F.col("end_ns"), "boarding_ns": F.lit(None).cast("long"), "route_type": F.lit("generic")})
    p = scoring.Parameters(spark.createDataFrame([(None, 6.0, 0.0, 1.0, -18.0, None, -1.0)], "subpopulation string, performing double, waiting double, money double, aborted double, waiting_pt double, line_switch double"), None, spark.createDataFrame([(None, "view", -6.0, 0.0, -0.001, -1.0, -2.0, -0.5), (None, "click", -3.0, -0.002, 0.0, 0.0, -4.0, 0.0), (None, "purchase", -1.0, 0.0, 0.0, 0.0, 0.0, -7.0)], "subpopulation string, mode string, travelling_h double, distance_m double, money_rate_m double, daily_money double, daily_utility double, constant double"))
    persons = el.select("person").distinct().withColumn("_set", F.lit(None).cast("string"))
    return scoring.leg_scores(el, persons, p, ["view"]).groupBy("person").agg(F.round(F.sum("score"), 6).alias("score"))


def first_persons(spark, sf):
    """PRJ-10: all events of the ten users who come first."""
    from veloframe.sources.folders import first_persons as first

    rows = log(spark, sf).withColumn("person", F.col("vehicle"))
    w = Window.partitionBy("person")
    return first(rows.withColumn("e_seq", F.col("seq")).withColumn("seq", F.min("seq").over(w)), 10).select("person", F.col("e_seq").alias("seq"))


def route_texts(spark, sf):
    """FUN-23: routes of order lines as text, and how many links the text has when it is read again."""
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string")).alias("links"))
    return r.select("l_orderkey", attributes.route_text(F.col("links")).alias("text"), F.size(attributes.route_links(attributes.route_text(F.col("links")))).alias("n"))


def node_weights(spark, sf):
    """AGG-03, AGG-04: how often links are started on, as weights of the nodes they end at."""
    counts = network.traversals(table(spark, sf, "act_starts").select(F.array("link").alias("links")))
    l = table(spark, sf, "links").select("id", "to_node").distinct()  # noqa: E741
    return network.node_weights(l, counts)


def session_windows(spark, sf):
    """STR-13: sessions of users with pauses of more than six hours between them."""
    e = replay.with_event_time(log(spark, sf))
    return replay.sessions(e, "user_id", "6 hours").select("user_id", F.expr("unix_micros(session.start)").alias("start_us"), "n")


_P = "partition by person order by elem"
_EL = f"""with {_LOG}, el as (select vehicle as person, row_number() over (partition by user_id order by us) - 1 as elem, case when event_type in ('signup', 'error') then 'act' else 'leg' end as kind,
 case event_type when 'signup' then 'home' when 'error' then 'car interaction' end as act_type, case when event_type not in ('signup', 'error') then event_type end as mode, case when event_type not in ('signup', 'error') and event_id % 2 = 0 then event_type end as rm, us * 1000 as end_ns, event_id from log),
tr as (select *, coalesce(act_type = 'home', false) as is_main, sum(case when act_type = 'home' then 1 else 0 end) over ({_P} rows unbounded preceding) as trip from el)"""
_SPANS = f"{_EL}, m as (select person, trip, elem, lead(elem) over ({_P}) as d from tr where is_main), sp as (select person, trip, elem as o, d from m where d > elem + 1)"
_DENSE = f"{_OBS}, b as (select mode, link, {_HOUR} as bin, cast(floor(avg(travel_ns)) as bigint) as v from obs group by all), k as (select distinct mode, link from b), dn as (select k.mode, k.link, g.bin, coalesce(b.v, 0) as v from k cross join (select unnest(range(24)) as bin) g left join b on b.mode is not distinct from k.mode and b.link = k.link and b.bin = g.bin)"
_DECAY = f"{_DENSE}, de as (select mode, link, bin, max(v + bin * 3600000000000) over (partition by mode, link order by bin rows unbounded preceding) - bin * 3600000000000 as v from dn)"
_NODE_PTS = "f as (select distinct id, x, y, link from facilities where x is not null and y is not null and not (x = 0 and y = 0)), n as (select distinct id, x, y from nodes)"
_NEAR_BIKE = f"""{_NODE_PTS}, l as (select distinct l.id, p.x as x0, p.y as y0, q.x as x1, q.y as y1 from links l join n p on p.id = l.from_node join n q on q.id = l.to_node where list_contains(l.modes, 'bike')),
t as (select f.id, l.id as link, f.x, f.y, x0, y0, x1 - x0 as dx, y1 - y0 as dy, case when (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 then least(1.0, greatest(0.0, ((f.x - x0) * (x1 - x0) + (f.y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) else 0.0 end as t from f, l),
d as (select id, link, sqrt((x - (x0 + t * dx)) * (x - (x0 + t * dx)) + (y - (y0 + t * dy)) * (y - (y0 + t * dy))) as d from t), nb as (select id, arg_min(link, {{'d': d, 'l': link}}) as link, min(d) as d from d group by id)"""
_E = f"with recursive {_LINKS}, e as (select distinct f, t from l where f <> t union select distinct t, f from l where f <> t)"
_COSTS = f"""with recursive {_LINKS}, e as (select f, t, min(case when len < 1e-9 then 0 else len / sp end) as c from l group by f, t), s as (select min(f) as s, max(f) as z from l),
r as (select s as src, s as node, 0.0::double as cost, 0 as d from s union all select z, z, 0.0, 0 from s union all select src, node, cost, d from (select r.src, e.t as node, min(r.cost + e.c) as cost, min(r.d) + 1 as d from r join e on e.f = r.node where r.d < 70 group by r.src, e.t)),
best as (select src, node, min(cost) as cost from r group by src, node)"""

SQL = {
    "event_type_view": f"with {_LOG} select us as seq, link, vehicle from log where event_type = 'view'",
    "pair_enter_leave": f"{_OBS} select * from obs",
    "asof_mode": f"{_OBS} select event_id, mode from v",
    "tt_bins_mean": f"{_OBS} select mode, link, {_HOUR} as bin, round(avg(travel_ns), 1) as mean_ns, count(*) as n from obs group by all",
    "dense_bins": f"{_DENSE} select mode, link, bin, v as mean_ns from dn",
    "tt_decay_fill": f"{_DECAY} select mode, link, bin, v as mean_ns from de",
    "tt_interpolate": f"""{_DECAY}, i as (select *, lead(v) over w as nv, lag(v) over w as pv from de window w as (partition by mode, link order by bin)),
j as (select o.enter_ns, o.link, i.v, i.nv, i.pv, (o.enter_ns % 86400000000000) / 3600000000000.0::double - i.bin - 0.5 as p from obs o join i on i.mode is not distinct from o.mode and i.link = o.link and i.bin = {_HOUR.replace("enter_ns", "o.enter_ns")})
select enter_ns, link, cast(round(case when p < 0 then case when pv is null then v else v + (v - pv) * p end else case when nv is null then v else v + (nv - v) * p end end, 0) as bigint) as travel_ns from j""",
    "tt_lookup_default": "with l as (select id, any_value(length_m) as len, any_value(freespeed) as sp from links group by id) select id as link, round(greatest(case when len > 5000 then 500e9 else len / sp * 1e9 end, len / 20.0 * 1e9), 0) as travel_ns from l",
    "interval_occupancy": f"with {_LOG}, r as (select vehicle, us as a, event_type, lead(event_type) over w as ne, lead(us) over w as z from log where event_type in ('signup', 'purchase') window w as (partition by vehicle order by us)) select 'p' || log.vehicle as person, event_id from log join r on r.vehicle = log.vehicle and r.event_type = 'signup' and r.ne = 'purchase' and log.us between r.a and r.z where log.event_type = 'view'",
    "asof_stop": f"with {_LOG}, v as (select *, last_value(case when event_type = 'signup' then m end ignore nulls) over w as line, last_value(case when event_type = 'click' then link end ignore nulls) over w as stop from log where vehicle in (select vehicle from log where event_type = 'signup') window w as (partition by vehicle order by us rows unbounded preceding)) select event_id, line, stop from v where event_type = 'view'",
    "trip_segments": f"{_SPANS} select person, cast(trip as bigint) as trip, o as origin_idx, d as destination_idx from sp",
    "trip_main_mode": f"{_EL} select person, cast(trip as bigint) as trip, case when count(distinct rm) = 1 then min(rm) when count(distinct rm) = 0 and count(*) = 1 then min(mode) end as main_mode from tr where kind = 'leg' group by person, trip",
    "next_trips": f"{_SPANS} select person, min(o) as origin_idx, arg_min(d, o) as destination_idx from sp where o >= 10 group by person",
    "plan_clock": f"""{_EL}, x as (select *, case when kind = 'act' and event_id % 4 = 0 then end_ns end as fixed, case when kind = 'act' then case when act_type <> 'home' then 60000000000 end when event_id % 7 <> 0 then 600000000000 end as step from el),
g as (select *, count(fixed) over ({_P} rows unbounded preceding) as g from x),
s as (select *, sum(case when fixed is null then coalesce(step, 0) else 0 end) over w as s, sum(case when fixed is null and step is null then 1 else 0 end) over w as gap, first_value(fixed) over w as base from g window w as (partition by person, g order by elem rows unbounded preceding))
select person, elem as elem_idx, cast(case when gap = 0 then case when g = 0 then 0 else base end + s end as bigint) as at_ns from s""",
    "overnight_wrap": f"""{_EL}, a as (select person, elem, (end_ns % 86400000000000) / 1e9::double as s, (end_ns % 86400000000000 + 60000000000) / 1e9::double as e, row_number() over ({_P}) as i, count(*) over (partition by person) as n from el where act_type = 'home'),
b as (select *, last_value(s) over (partition by person order by elem rows between unbounded preceding and unbounded following) as ls from a)
select person, elem as elem_idx, round(case when n = 1 then 0.0 when i = 1 then ls else s end, 6) as arrival_s, round(case when n = 1 then 86400.0 when i = 1 then e + 86400 else e end, 6) as departure_s from b where n = 1 or i < n""",
    "activity_utility": """with a as (select o_orderkey, o_totalprice as p, case when 50000 > o_totalprice then o_totalprice else 50000 end as s, case when 50000 > o_totalprice then o_totalprice else least(200000, o_totalprice) end as e from orders),
b as (select *, e - s as d, 28800 * exp(-1.0) as z, 6.0::double / 3600 as b from a)
select o_orderkey, round(case when d >= z then b * 28800 * (ln(d / 28800) + 1) else -(b * 28800 / z) * (z - d) end, 6) as utility, round(greatest(s, 0.0) + greatest(p - e, 0.0), 6) as waiting_s from b""",
    "order_check": f"with {_LOG}, v as (select event_id, us * 1000 as time_ns, lag(us * 1000) over (partition by vehicle order by event_id * 7919 % 1000003) as previous_ns from log) select * from v where previous_ns > time_ns",
    "keep_last": f"with {_PLANS} select person, plan_idx from p where selected",
    "best_plan": f"with {_PLANS} select person, arg_max(plan_idx, {{'a': score, 'b': plan_idx}}) as plan_idx from p where score is not null group by person",
    "worst_plan": f"with {_PLANS}, r as (select *, row_number() over (partition by person order by selected, score nulls first, plan_idx) as r from p) select person, plan_idx from r where r = 1",
    "random_plan": f"with {_PLANS}, r as (select *, row_number() over (partition by person order by plan_idx) - 1 as i, count(*) over (partition by person) as n from p) select person, plan_idx from r where i = least(cast(floor({_U} * n) as bigint), n - 1)",
    "plan_memory": f"with {_PLANS}, r as (select *, row_number() over (partition by person order by selected, score nulls first, plan_idx) as r, count(*) over (partition by person) as n from p) select person, plan_idx from r where r > n - 5",
    "softmax_probs": f"with {_PLANS}, w as (select *, exp(1e-5 * (score - max(score) over (partition by person))) as w, count(*) over (partition by person) = count(score) over (partition by person) as ok, min(plan_idx) over (partition by person) as f from p) select person, plan_idx, round(case when ok then w / sum(w) over (partition by person) when plan_idx = f then 1.0 else 0.0 end, 9) as probability from w",
    "softmax_pick": f"with {_PLANS}, w as (select *, exp(1e-5 * (score - max(score) over (partition by person))) as w, count(*) over (partition by person) = count(score) over (partition by person) as ok, min(plan_idx) over (partition by person) as f from p), q as (select person, plan_idx, case when ok then w / sum(w) over (partition by person) when plan_idx = f then 1.0 else 0.0 end as q from w), r as (select *, sum(q) over (partition by person order by plan_idx rows unbounded preceding) as run, sum(q) over (partition by person) as a from q where q > 0) select person, min(plan_idx) as plan_idx from r where {_U} * a < run group by person",
    "strategy_pick": f"with w(s, strategy, weight) as (values ('BUILDING', 'BestScore', 1.0), ('BUILDING', 'ReRoute', 3.0), ('MACHINERY', 'KeepLastSelected', 2.0), ('MACHINERY', 'SelectRandom', 5.0), ('FURNITURE', 'ReRoute', 1.0)), p as (select c_custkey as person, strategy, cast(weight as double) as weight from customer join w on s = c_mktsegment), r as (select *, sum(weight) over (partition by person order by strategy rows unbounded preceding) as run, sum(weight) over (partition by person) as a from p) select person, min(strategy) as strategy from r where {_U} * a < run group by person",
    "copied_plans": f"with {_PLANS}, t as (select person, max(plan_idx) + 1 as nw from p group by person) select person, plan_idx, score, selected and person % 3 <> 0 as selected from p union all select p.person, nw, null, true from p join t on t.person = p.person where selected and p.person % 3 = 0",
    "event_multiset_diff": f"with {_LOG}, a as (select us * 1000 as time_ns, type, link, vehicle, 1 as x, 0 as y from log), b as (select us * 1000 as time_ns, type, case when event_id % 10 = 0 then 'other' else link end as link, vehicle, 0 as x, case when event_id % 31 = 0 then 2 else 1 end as y from log where event_id % 23 <> 0) select time_ns, link, vehicle, cast(sum(x) as bigint) as n_first, cast(sum(y) as bigint) as n_second from (select * from a union all select * from b) group by time_ns, type, link, vehicle having sum(x) <> sum(y)",
    "merge_sorted": f"with {_LOG} select event_id, row_number() over (order by us) - 1 as seq from log",
    "nearest_node": f"with {_NODE_PTS}, d as (select f.id, n.id as node, sqrt((f.x - n.x) * (f.x - n.x) + (f.y - n.y) * (f.y - n.y)) as d from f, n) select id, arg_min(node, {{'d': d, 'n': node}}) as node, round(min(d), 6) as distance from d group by id",
    "nearest_by_mode": f"with {_NEAR_BIKE} select id, link, round(d, 6) as distance from nb",
    "modal_fallback": f"with {_NEAR_BIKE} select f.id, case when f.link in (select id from links where list_contains(modes, 'bike')) then f.link else coalesce(nb.link, f.link) end as link from f left join nb on nb.id = f.id",
    "set_or_default": "select c_custkey as person, case c_mktsegment when 'BUILDING' then 8.0::double when 'AUTOMOBILE' then 4.0::double else 6.0::double end as performing from customer",
    "semi_partition": "with n as (select distinct id, partition_no from nodes), l as (select distinct id, to_node from links), f as (select distinct id, x, y, link from facilities where x is not null and y is not null and not (x = 0 and y = 0)) select n.partition_no, count(*) as n from f join l on l.id = f.link join n on n.id = l.to_node group by 1",
    "route_counts": "select l_suppkey as link, count(*) as n from lineitem group by 1",
    "mode_links": "select mode, count(distinct id) as n from (select id, unnest(modes) as mode from links) group by 1 union all select 'none', count(distinct id) from links where len(modes) = 0",
    "undirected_edges": "with l as (select distinct id, from_node, to_node, permlanes from links where from_node <> to_node) select least(from_node, to_node) as a, greatest(from_node, to_node) as b, cast(greatest(sum(trunc(permlanes / 2)), 1) as bigint) as weight from l group by 1, 2",
    "vertex_weights": "with n as (select distinct id from nodes), l as (select distinct id, from_node, to_node, capacity from links) select n.id as node, count(l.id) as in_links, round(coalesce(sum(l.capacity), 0.0), 6) as in_capacity from n left join l on l.to_node = n.id group by 1",
    "neighbour_counts": "with n as (select distinct id, partition_no as p from nodes), x as (select a.p as p, b.p as q, list_contains(l.modes, 'car') as main from links l join n a on a.id = l.from_node join n b on b.id = l.to_node where a.p <> b.p), y as (select p, q, main from x union all select q, p, main from x), z as (select p, count(distinct case when main then q end) as m, count(distinct q) as n from y group by p) select k.p as partition_no, coalesce(case when m > 0 then m else n end, 0) as n from (select distinct p from n) k left join z on z.p = k.p",
    "route_lengths": "with l as (select id, max(length_m) as len, any_value(from_node) as f from links group by id), r as (select f, len, row_number() over (partition by f order by id) as i, count(*) over (partition by f) as n from l) select f as route_id, round(sum(case when n = 1 then 0.0 when i = 1 or i = n then len * 0.5 else len end), 4) as distance from r group by f",
    "route_validity": "with l as (select distinct id, from_node, to_node, modes from links), m as (select list_contains(a.modes, 'car') and list_contains(b.modes, 'car') as v from l a join l b on b.from_node = a.to_node union all select false from l) select v as valid, count(*) as n from m group by 1",
    "hop_distance": f"{_E}, r(node, h) as (select min(f), 0 from l union all select distinct e.t, r.h + 1 from r join e on e.f = r.node where r.h < 40) select node, cast(min(h) as integer) as hops from r group by node",
    "departure_sequence": "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) - 1 as sequence from lineitem",
    "vehicle_copies": "with d as (select cast(l_orderkey as varchar) as line, cast(l_partkey as varchar) as route, cast(l_linenumber as varchar) as id, 'v' || (l_orderkey * 7 + l_linenumber) as v from lineitem), c as (select *, count(*) over (partition by v) as n from d) select line, id, case when n > 1 then concat_ws('_', v, line, route, id) else v end as vehicle, case when n > 1 then v end as copied_from from c",
    "transit_drivers": "select concat_ws('_', 'pt', o_custkey, o_orderpriority, o_orderkey) as driver from orders",
    "vehicles_per_mode": "with p as (select distinct id from persons) select id || '_' || mode as vehicle, id as person, mode from p, (values ('car'), ('bike')) m(mode) where not (mode = 'car' and length(id) % 2 = 0)",
    "delay_propagation": "with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, sum(cast(l_quantity as bigint) - l_partkey % 40) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) as s from lineitem) select l_orderkey, l_linenumber, l_partkey, cast(s - least(min(s) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding), 0) as bigint) as delay from l",
    "teleport_arrivals": "with n as (select distinct id, x, y from nodes), l as (select distinct l.id, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) as d from links l join n a on a.id = l.from_node join n b on b.id = l.to_node) select id, round(d * 1.3, 6) as distance_m, cast(round(floor(d * 1.3 / (3 / 3.6::double) * 1e9) / 1e6, 0) as bigint) as travel_ms from l",
    "teleport_plans": f"""{_EL}, l as (select *, lag(case when kind = 'act' then end_ns end) over ({_P}) as e from el), g as (select *, row_number() over ({_P}) - 1 as k from l where kind = 'leg')
select person, elem as elem_idx, max(coalesce(e, 0) - k * 601000000000) over w + k * 601000000000 as dep_ns, max(coalesce(e, 0) - k * 601000000000) over w + k * 601000000000 + 600000000000 as arr_ns from g window w as (partition by person order by elem rows unbounded preceding)""",
    "capacities": "with l as (select distinct id, length_m as d, permlanes as p, freespeed as s, capacity as c from links where capacity is not null) select id, round(greatest(greatest(c * 0.1 / 3600, d * p * 0.1 / 7.5), d / s * (c * 0.1 / 3600)), 6) as queue, round(greatest(greatest(c * 0.1 / 3600, d * p * 0.1 / 7.5), (d / s + d / (15 / 3.6::double)) * (c * 0.1 / 3600)), 6) as waves, round(c * 0.1 / 3600, 9) as flow from l",
    "time_parse": "select seq, 0::bigint as off_hms, 0::bigint as off_s from act_starts where time_ns is not null",
    "time_format": """with t as (select seq, time_ns, time_ns // 1000000000 as s, time_ns % 1000000000 as f from act_starts where time_ns is not null)
select seq, time_ns, case when s // 3600 < 10 then '0' else '' end || (s // 3600) || ':' || lpad(cast(s // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') || case when f = 0 then '' else '.' || rtrim(lpad(cast(f as varchar), 9, '0'), '0') end as clock, (time_ns * 10 + 999999999) // 1000000000 as tick, ((time_ns * 3 + 999999999) // 1000000000) * 1000000000 // 3 as tick_ns from t""",
    "start_summary": "select iteration, least(time_ns // 3600000000000, 30) as hour, coalesce(contains(act_type, 'interaction'), false) as interaction, count(*) as n from act_starts where time_ns is not null group by all",
    "node_components": f"{_E}, r as (select id as node, id as root from nodes union select e.t, r.root from r join e on e.f = r.node) select node, min(root) as component from r group by node",
    "kcore_dead_ends": f"""with recursive {_LINKS}, e as (select distinct f as a, t as b from l where f <> t union select distinct t, f from l where f <> t),
r(k, es, n) as (select 0, list({{'a': a, 'b': b}}), -1::bigint from e union all select k + 1, list_filter(es, lambda x: len(list_filter(es, lambda y: y.a = x.a)) > 1 and len(list_filter(es, lambda y: y.a = x.b)) > 1), len(es) from r where n <> len(es)),
core as (select distinct u.a as id from (select unnest(es) as u from (select es from r order by k desc limit 1))) select distinct id as node from nodes where id not in (select id from core)""",
    "shortest_path": f"{_COSTS} select node, round(cost, 4) as cost from best, s where src = s.s",
    "shortest_path_kernel": _COSTS.replace("select min(f) as s, max(f) as z from l)", "select arg_min(t, {'a': f, 'b': t, 'c': id}) as s, arg_min(t, {'a': f, 'b': t, 'c': id}) as z, min({'a': f, 'b': t, 'c': id}).c as first from l)") + " select l.id as request, round(b.cost, 4) as cost from l cross join s left join best b on b.node = l.f and b.src = s.s where l.id <> s.first",
    "simulated_teleports": f"""{_EL}, b as (select person, elem, kind, case when kind = 'act' then (end_ns // 1000000000 - 757382400) * 1000000000 end as e, min(case when kind = 'act' then elem end) over (partition by person) as f, max(case when kind = 'act' then elem end) over (partition by person) as z from el),
c as (select *, lead(kind) over ({_P}) as nx from b where elem between f and z), d as (select *, lag(e) over ({_P}) as pe from c where not (kind = 'act' and coalesce(nx, '') = 'act')),
l as (select *, row_number() over ({_P}) - 1 as k from d where kind = 'leg'), t as (select person, max(coalesce(pe, 0) - k * 601000000000) over ({_P} rows unbounded preceding) + k * 601000000000 as dep from l)
select person, dep as time_ns, 'departure' as type from t union all select person, dep + 600000000000, 'arrival' from t""",
    "leg_scores": f"""{_EL}, l as (select person, trip, elem, mode, row_number() over (partition by person, trip, mode order by elem) as it, row_number() over (partition by person, mode order by elem) as id, sum(case when mode = 'view' then 1 else 0 end) over (partition by person, trip order by elem rows unbounded preceding) as tn from tr where kind = 'leg')
select person, round(sum(case mode when 'view' then -1.0 - 1.0 + case when it = 1 then -0.5 else 0 end + case when id = 1 then -3.0 else 0 end + case when tn > 1 then -1.0 else 0 end when 'click' then -0.5 - 2.0 + case when id = 1 then -4.0 else 0 end else -1.0::double / 6 + case when it = 1 then -7.0 else 0 end end), 6) as score from l group by person""",
    "first_persons": f"with {_LOG}, f as (select vehicle from log group by vehicle order by min(us) limit 10) select vehicle as person, us as seq from log where vehicle in (select vehicle from f)",
    "route_texts": "with r as (select l_orderkey, list_sort(list(l_suppkey)) as l from lineitem group by 1), t as (select l_orderkey, case when len(l) = 2 and l[1] = l[2] then [l[1]] else l end as l from r) select l_orderkey, array_to_string(l, ' ') as text, cast(len(l) as integer) as n from t",
    "node_weights": "with c as (select link, count(*) as n from act_starts group by 1) select to_node as node, max(n) as weight from (select distinct id, to_node from links) l join c on c.link = l.id group by 1",
    "session_windows": f"with {_LOG}, g as (select user_id, us, case when us - lag(us) over (partition by user_id order by us) < 21600000000 then 0 else 1 end as f from log), s as (select *, sum(f) over (partition by user_id order by us rows unbounded preceding) as s from g) select user_id, min(us) + 946684800000000 as start_us, count(*) as n from s group by user_id, s",
    "attr_default": "with p as (select id, arg_max(attributes, {'a': first_iter, 'b': cast(to_json(attributes) as varchar)}) as a from persons group by id) select id, coalesce(try_cast(a['age'] as integer), 30) as age, cast(cardinality(a) + 2 - case when a['age'] is null then 0 else 1 end as integer) as n, '1' as new_age from p",
}

QUERIES = {f.__name__: f for f in (
    event_type_view, pair_enter_leave, asof_mode, asof_stop, interval_occupancy, tt_bins_mean, dense_bins, tt_decay_fill, tt_interpolate, tt_lookup_default, trip_segments, trip_main_mode, next_trips, plan_clock, overnight_wrap, activity_utility, order_check,
    keep_last, best_plan, worst_plan, random_plan, plan_memory, softmax_probs, softmax_pick, strategy_pick, copied_plans, event_multiset_diff, merge_sorted, nearest_node, nearest_by_mode, modal_fallback, set_or_default, semi_partition, route_counts, mode_links, undirected_edges, vertex_weights, neighbour_counts, route_lengths, route_validity,
    kcore_dead_ends, node_components, hop_distance, shortest_path, shortest_path_kernel, departure_sequence, vehicle_copies, transit_drivers, vehicles_per_mode, delay_propagation, teleport_arrivals, teleport_plans, capacities, time_parse, time_format, attr_default, start_summary, simulated_teleports, leg_scores, first_persons, route_texts, node_weights, session_windows,
)}
