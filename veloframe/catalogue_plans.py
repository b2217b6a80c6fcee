"""Queries of plan preparation, transit schedules, routing, scoring and configuration over the test tables, with the SQL that gives the same rows.

As in ``catalogue``, users' events are the elements of plans: sign-ups are main activities, errors interactions, other events legs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from veloframe import catalogue as cat
from veloframe.catalogue import _COSTS, _EL, _LOG, _NODE_PTS, _P, _elements, _network, _points, table
from veloframe.functions import attributes, geometry, rng, times
from veloframe.functions.times import NS
from veloframe.operators import network, planops, prepare, routing, scoring, selection, transit
from veloframe.operators.references import NO_REFERENCE
from veloframe.plans import controller
from veloframe.sources import config
from veloframe.storage import materialize

_CLOCK, _SEGMENTS = cat.SQL["plan_clock"], cat.SQL["trip_segments"]
_NULLS = "('', 'null', 'undefined')"


def _null(kind: str):
    return F.lit(None).cast(kind)


def trip_departures(spark, sf):
    """WIN-06: when each trip begins; null after a gap in the chain of times."""
    return planops.departures(cat.clock_elements(spark, sf)).select("person", F.col("trip").cast("long").alias("trip"), "departure_ns")


def spliced_trips(spark, sf):
    """PLN-03: each trip replaced by one ride, elements renumbered."""
    e = _elements(spark, sf)
    spans = planops.trip_spans(e)
    new = spans.select("person", "plan_idx", "origin_idx", F.lit(0).alias("pos"), F.lit("leg").alias("kind"), F.lit("taxi").alias("mode"))
    return planops.spliced(e, spans, new).select("person", "elem_idx", "kind", F.coalesce("mode", "act_type").alias("what"), "event_id")


_SPLICED = f"""with t as ({_EL} select * from tr), s as ({_SEGMENTS}), k as (select person, elem as pl, -1 as pos, kind, coalesce(mode, act_type) as what, event_id from t where not exists (select 1 from s where s.person = t.person and t.elem > s.origin_idx and t.elem < s.destination_idx)
 union all select person, origin_idx, 0, 'leg', 'taxi', null from s) select person, cast(row_number() over (partition by person order by pl, pos) - 1 as integer) as elem_idx, kind, what, event_id from k"""


def synchronised_times(spark, sf):
    """PLN-09: travel times of legs and routes, each from the other where only one is known."""
    n = lambda k, s: F.when(F.col("event_id") % k == 0, F.lit(s * NS).cast("long"))
    e = _elements(spark, sf).filter("kind = 'leg'").withColumns({"trav_ns": n(3, 600), "route_trav_ns": n(5, 900), "route_type": F.when(F.col("event_id") % 2 == 0, "generic")})
    return planops.synchronised(e).select("event_id", "trav_ns", "route_trav_ns")


def leg_distances(spark, sf):
    """PLN-08, SCO-07: every pair of links that meet as a trip of two driven legs; where one distance is missing, both are computed."""
    l = _network(spark, sf)  # noqa: E741
    a, b = l.select(F.col("id").alias("a"), F.col("to_node").alias("n")), l.select(F.col("id").alias("b"), F.col("from_node").alias("n"))
    pairs = a.join(b, "n").select(F.concat_ws(">", "a", "b").alias("person"), "a", "b")
    leg = lambda i, links, d: F.struct(F.lit(i).alias("elem_idx"), F.lit("leg").alias("kind"), _null("string").alias("act_type"), links.alias("links"), d.alias("distance"), F.lit("links").alias("route_type"))
    act = lambda i, t: F.struct(F.lit(i).alias("elem_idx"), F.lit("act").alias("kind"), F.lit(t).alias("act_type"), _null("array<string>").alias("links"), _null("double").alias("distance"), _null("string").alias("route_type"))
    rows = F.explode(F.array(act(0, "home"), leg(1, F.array("a", "b"), F.when(F.length("a") % 2 == 1, 7.0)), act(2, "car interaction"), leg(3, F.array("b"), F.lit(5.0)), act(4, "work")))
    e = pairs.select("person", F.lit(0).alias("plan_idx"), rows.alias("e")).select("person", "plan_idx", "e.*")
    return planops.filled_distances(e, l).filter("kind = 'leg'").select("person", "elem_idx", F.round("distance", 4).alias("distance"))


_DISTANCES = """with l as (select id, min(from_node) as f, min(to_node) as t, min(length_m) as len from links group by id), p as (select a.id || '>' || b.id as person, a.id as a, b.len as len from l a join l b on b.f = a.t)
select person, 1 as elem_idx, case when length(a) % 2 = 1 then 7.0 else round(len, 4) end as distance from p union all select person, 3, case when length(a) % 2 = 1 then 5.0 else 0.0 end from p"""


def _legs_to_check(spark, sf):
    k = F.col("event_id")
    e = _elements(spark, sf).withColumns({"route_type": F.lit("generic"), "distance": F.when(k % 13 == 0, -1.0).when(k % 11 != 0, 100.0), "trav_ns": F.when(k % 7 != 0, F.lit(600 * NS).cast("long")), "route_trav_ns": _null("long"), "start_link": F.lit("l"), "end_link": F.when(k % 17 == 0, "other").otherwise("l"), "links": _null("array<string>")})
    return e.withColumns({c: _null("string") for c in ("line", "route", "access_facility", "egress_facility")})


def valid_trips(spark, sf):
    """PLN-10, AGG-14, PRJ-13: trips of one routing mode whose legs have distances, times and links that meet."""
    found = planops.trip_validity(_legs_to_check(spark, sf), table(spark, sf, "links"), ["car"])
    return found.select("person", F.col("trip").cast("long").alias("trip"), "valid")


_VALID = f"""{_EL}, g as (select *, lag(case when event_id % 17 = 0 then 'other' else 'l' end) over (partition by person, trip order by elem) as b from tr where kind = 'leg')
select person, cast(trip as bigint) as trip, bool_and(event_id % 13 <> 0 and event_id % 11 <> 0 and event_id % 7 <> 0 and coalesce(b, 'l') = 'l' and {{}}) and count(distinct coalesce(rm, '')) = 1 as valid from g group by person, trip"""


def valid_transit_trips(spark, sf):
    """PLN-12: views are rides, from a stop to a later one of a line that there is."""
    k = F.col("event_id")
    view = F.col("mode") == "view"
    name = lambda p, c: F.when(view, F.concat(F.lit(p), c.cast("string")))
    e = _legs_to_check(spark, sf).withColumns({"route_type": F.when(view, "default_pt").otherwise("generic"), "line": name("m", k % 3), "route": name("m", k % 3), "access_facility": name("s", k % 5), "egress_facility": name("s", k * 7 % 5)})
    lines = spark.createDataFrame([(m, m, [f"s{i}" for i in range(5)]) for m in ("m0", "m1")], "line string, route string, stops array<string>")
    found = planops.trip_validity(e, table(spark, sf, "links"), ["car"], transit=lines)
    return found.select("person", F.col("trip").cast("long").alias("trip"), "valid")


_SEGMENT = "case when (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 then least(1.0, greatest(0.0, ((f.x - x0) * (x1 - x0) + (f.y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) else 0.0 end"
_NEAR = lambda name, mode: f"""l{name} as (select distinct l.id, p.x as x0, p.y as y0, q.x as x1, q.y as y1 from links l join n p on p.id = l.from_node join n q on q.id = l.to_node{f" where list_contains(l.modes, '{mode}')" if mode else ""}),
t{name} as (select f.id, l.id as link, f.x, f.y, x0, y0, x1 - x0 as dx, y1 - y0 as dy, {_SEGMENT} as t from f, l{name} l),
d{name} as (select id, link, sqrt((x - (x0 + t * dx)) * (x - (x0 + t * dx)) + (y - (y0 + t * dy)) * (y - (y0 + t * dy))) as d from t{name}), {name} as (select id, arg_min(link, {{'d': d, 'l': link}}) as link from d{name} group by id)"""  # noqa: E731


def _base(c):
    return F.when(~c.isin(*NO_REFERENCE), c)


def located_acts(spark, sf):
    """PLN-04: activities at facilities' places: the nearest link where there is none, the middle of the link where only that is known."""
    p = _points(spark, sf).withColumn("link", _base(F.col("link")))
    odd = (F.length("id") + F.ascii(F.substring("id", -1, 1))) % 2 == 1
    e = p.select(F.col("id").alias("person"), F.lit(0).alias("plan_idx"), F.lit(0).alias("elem_idx"), F.lit("act").alias("kind"), _null("string").alias("facility"), "link", F.when(F.col("link").isNull() | odd, F.col("x")).alias("x"), F.when(F.col("link").isNull() | odd, F.col("y")).alias("y"))
    got = planops.located_activities(e, table(spark, sf, "facilities").select("id", "link", "x", "y").limit(0), table(spark, sf, "links"), table(spark, sf, "nodes"))
    return got.select("person", "link", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_LOCATED = f"""with {_NODE_PTS}, {_NEAR("nr", None)}, m as (select l.id, (p.x + q.x) / 2 as mx, (p.y + q.y) / 2 as my from (select id, min(from_node) as a, min(to_node) as b from links group by id) l join n p on p.id = a join n q on q.id = b),
g as (select id, x, y, case when link not in {_NULLS} then link end as link, (length(id) + ascii(right(id, 1))) % 2 = 1 as odd from f)
select g.id as person, coalesce(g.link, nr.link) as link, round(case when g.link is null or odd then x else mx end, 4) as x, round(case when g.link is null or odd then y else my end, 4) as y from g left join nr on nr.id = g.id left join m on m.id = g.link"""


def facility_links(spark, sf):
    """PLN-05, RTE-16: the base link of each facility and, where it differs, its link for bikes."""
    p = _points(spark, sf).withColumn("link", _base(F.col("link")))
    got = planops.prepared_facilities(p, table(spark, sf, "links"), table(spark, sf, "nodes"), ["bike"])
    return got.select("id", "link", F.col("mode_links")["bike"].alias("bike_link"))


_FACILITY_LINKS = f"""with {_NODE_PTS}, {_NEAR("nr", None)}, {_NEAR("nb", "bike")}, g as (select f.id, coalesce(case when f.link not in {_NULLS} then f.link end, nr.link) as link, nb.link as bike from f left join nr on nr.id = f.id left join nb on nb.id = f.id),
h as (select id, link, case when link in (select id from links where list_contains(modes, 'bike')) then link else coalesce(bike, link) end as bike from g) select id, link, case when bike is distinct from link then bike end as bike_link from h"""


def leg_vehicles(spark, sf):
    """PLN-07, JON-16: the vehicle a leg names, else the person's own, and whether there is none of that name."""
    e = _elements(spark, sf).withColumn("vehicle", F.when((F.col("kind") == "leg") & (F.col("event_id") % 4 == 0), F.concat(F.lit("own"), (F.col("event_id") % 10).cast("string"))))
    have = table(spark, sf, "events").filter("user_id % 2 = 0").select(F.concat("user_id", F.lit("_view")).alias("vehicle")).union(spark.createDataFrame([(f"own{i}",) for i in range(5)], "vehicle string"))
    return planops.resolved_vehicles(e, have, ["view"]).select("event_id", "vehicle", "vehicle_missing")


_VEHICLES = f"""{_EL}, v as (select event_id, person, case when kind = 'leg' and event_id % 4 = 0 then 'own' || (event_id % 10) when kind = 'leg' and mode = 'view' then person || '_view' end as vehicle from tr)
select event_id, vehicle, vehicle is not null and not (vehicle in ('own0', 'own1', 'own2', 'own3', 'own4') or (vehicle like '%_view' and cast(person as bigint) % 2 = 0)) as vehicle_missing from v"""


def adaptive_users(spark, sf):
    """PRJ-14."""
    e = _elements(spark, sf).withColumn("attributes", F.when(F.col("event_id") % 50 == 0, F.create_map(F.lit("preplanningHorizon"), F.lit("600"))))
    return planops.adaptive_persons(e)


def plan_issues(spark, sf):
    """PLN-14, AGG-17: what can't be prepared, counted with a few examples each."""
    k = F.col("event_id")
    e = cat.clock_elements(spark, sf).withColumns({"facility": F.when(F.col("act_type") == "home", F.concat(F.lit("f"), (k % 20).cast("string"))), "link": F.when(k % 2 == 0, "l"), "x": F.when(k % 3 == 0, 1.0), "y": F.lit(1.0)})
    known = spark.createDataFrame([(f"f{i}",) for i in range(18)], "id string")
    return planops.issue_report(planops.issues(e, known)).select("message", "n", F.size("examples").alias("examples"))


_ISSUES = f"""with t as ({_EL} select * from tr), d as ({{}}), c as (select 'unknown facility' as message, count(*) as n from t where act_type = 'home' and event_id % 20 >= 18
 union all select 'no place', count(*) from t where kind = 'act' and act_type <> 'home' and event_id % 2 = 1 and event_id % 3 <> 0 union all select 'no departure time', count(*) from d where departure_ns is null) select message, n, cast(least(n, 20) as integer) as examples from c where n > 0"""


def start_partitions(spark, sf):
    """PLN-18, PRJ-11: users by the part of the link of their first activity."""
    e = _elements(spark, sf).withColumn("link", F.concat(F.lit("l"), (F.col("event_id") % 5).cast("string")))
    parts = spark.createDataFrame([(f"l{i}", i * i) for i in range(5)], "id string, partition_no int")
    return planops.by_start_partition(e, parts)


def main_acts(spark, sf):
    """PRJ-05, PRJ-07."""
    return planops.main_activities(_elements(spark, sf)).groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.min("elem_idx").alias("first"))


def typed_attributes(spark, sf):
    """PRJ-15, PRJ-16, FUN-22, FUN-26: attribute values by their class, and vehicles from a map in an attribute."""
    k = F.col("event_id")
    v = F.when(k % 5 == 0, F.lit("x")).otherwise(k.cast("string"))
    cls = F.element_at(F.array(*(F.lit(f"java.lang.{c}") for c in ("Integer", "String", "Boolean", "Odd"))), (k % 4 + 1).cast("int"))
    cars = F.create_map(F.lit("vehicles"), F.concat(F.lit('{"car":"c'), v, F.lit('"}')))
    return table(spark, sf, "events").select("event_id", attributes.typed(v, cls).alias("value"), attributes.vehicle_of(cars, "car").alias("car"), attributes.vehicle_of(cars, "bike").alias("bike"), attributes.reference(F.when(k % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit(" v"), v))).alias("vehicle"), F.array_join(attributes.modes(F.concat(F.lit(" car,,"), v, F.lit(" ,"))), "|").alias("modes"))


_TYPED = """with v as (select event_id, event_id % 4 as c, case when event_id % 5 = 0 then 'x' else cast(event_id as varchar) end as v from events)
select event_id, case when c = 0 then case when v = 'x' then null else v end when c = 1 then v when c = 2 then case v when '1' then 'true' when '0' then 'false' end end as value, 'c' || v as car, cast(null as varchar) as bike, case when event_id % 3 = 0 then null else 'v' || v end as vehicle, 'car|' || v as modes from v"""


def _stops(spark, sf):
    """Lines of an order as stops: a third has no arrival, a fifth no departure."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    l = l.withColumn("pos", pos)  # noqa: E741
    at = F.when(F.col("l_partkey") % 17 == 0, F.lit(0)).otherwise(F.col("pos") * 100).cast("long") * NS
    return l.select(F.col("l_orderkey").cast("string").alias("line"), F.lit("r").alias("route"), "pos", F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("facility"), F.when(F.col("l_partkey") % 3 != 0, at).alias("arr_ns"), F.when(F.col("l_partkey") % 5 != 0, at + 30 * NS).alias("dep_ns"))


_STOPS = """s as (select cast(l_orderkey as varchar) as line, 'r' as route, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as pos, l_suppkey % 10 as f, l_partkey from lineitem),
a as (select *, case when l_partkey % 17 = 0 then 0 else pos * 100000000000 end as att from s), b as (select *, case when l_partkey % 3 <> 0 then att end as arr, case when l_partkey % 5 <> 0 then att + 30000000000 end as dep from a),
o as (select *, coalesce(arr, dep) as ao, coalesce(dep, arr) as d from b)"""


def _stop_places(spark):
    return spark.createDataFrame([(f"s{i}", None if i == 8 else f"k{i % 7}") for i in range(9)], "id string, link string")


def route_ends(spark, sf):
    """PRJ-19."""
    return transit.end_links(_stops(spark, sf), _stop_places(spark))


def stop_times(spark, sf):
    """PRJ-18, JON-02: the stops of one departure per order, with offsets that fall back to each other."""
    s = _stops(spark, sf)
    d = s.select("line", "route").distinct().select("line", "route", F.lit("d").alias("id"), (F.col("line").cast("long") % 1000 * NS).alias("dep_ns"))
    return transit.timetable(d, s).select("line", "pos", "arr_ns", "dep_ns")


def stop_delays(spark, sf):
    """WIN-14, STR-07: delays along the departures when some stops add a minute and halts absorb what they can."""
    s = _stops(spark, sf)
    d = s.select("line", "route").distinct().select("line", "route", F.lit("d").alias("id"), F.lit(0).cast("long").alias("dep_ns"))
    return transit.delayed(transit.timetable(d, s), F.when(F.col("pos") % 2 == 1, F.lit(60 * NS).cast("long")).otherwise(F.lit(0).cast("long"))).select("line", "pos", "delay_ns")


def schedule_issues(spark, sf):
    """PLN-16: unknown stops, stops without a link or off the route, times that go back."""
    s = _stops(spark, sf)
    routes = s.select("line", "route").distinct().withColumn("links", F.array(*(F.lit(f"k{i}") for i in range(5))))
    none = spark.createDataFrame([], "line string, route string, id string, dep_ns long, vehicle string")
    return transit.schedule_errors(s, _stop_places(spark), none, routes).groupBy("kind", "line", "what").agg(F.count(F.lit(1)).alias("n"))


_SCHEDULE = f"""with {_STOPS}, p as (select *, lag(d) over (partition by line order by pos) as b from o),
k as (select line, 's' || f as what, case when f = 9 then 'unknown stop' when f = 8 then 'stop without link' when f % 7 >= 5 then 'stop off the route' when ao < b or d < ao then 'time goes back' end as kind from p) select kind, line, what, count(*) as n from k where kind is not null group by all"""


def boarded_calls(spark, sf):
    """JON-13, JON-14: users' events as passengers who wait for the first departure that goes on to where they get off, of any line or of a named one."""
    stops = spark.createDataFrame([(f"L{i}", "r", k, f"s{(k + i) % 4}", k * 300 * NS, k * 300 * NS + 60 * NS) for i in range(3) for k in range(4)], "line string, route string, pos int, facility string, arr_ns long, dep_ns long")
    deps = spark.createDataFrame([(f"L{i}", "r", f"d{h:02d}", (h * 3600 + i * 700) * NS, "v") for i in range(3) for h in range(24)], "line string, route string, id string, dep_ns long, vehicle string")
    k = F.col("event_id")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    w = table(spark, sf, "events").select(k.alias("agent"), name(k % 4).alias("stop"), name((k + 1 + k % 3) % 4).alias("egress"), F.when(k % 2 == 0, F.concat(F.lit("L"), (k % 3).cast("string"))).alias("line"), (k * 7919 % 86_400 * NS).alias("time_ns"))
    return transit.boardings(w, transit.timetable(deps, stops)).select("agent", "line", "departure", "boarding_ns")


_BOARDED = """with c as (select 'L' || i as line, 'd' || lpad(cast(h as varchar), 2, '0') as dep, k as pos, 's' || ((k + i) % 4) as stop, (h * 3600 + i * 700 + k * 300 + 60) * 1000000000 as att from (select unnest(range(3)) as i), (select unnest(range(24)) as h), (select unnest(range(4)) as k)),
w as (select event_id as agent, 's' || (event_id % 4) as stop, 's' || ((event_id + 1 + event_id % 3) % 4) as egress, case when event_id % 2 = 0 then 'L' || (event_id % 3) end as line, event_id * 7919 % 86400 * 1000000000 as t from events),
j as (select w.agent, min({'at': c.att, 'line': c.line, 'dep': c.dep}) as m from w join c on c.stop = w.stop and c.att >= w.t and (w.line is null or w.line = c.line) join c e on e.line = c.line and e.dep = c.dep and e.pos > c.pos and e.stop = w.egress group by w.agent)
select agent, m.line as line, m.dep as departure, m.at as boarding_ns from j"""


def ride_distances(spark, sf):
    """AGG-06: from the first to the last supplier of each order, along the suppliers in order of their number."""
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("ride")).agg(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: F.lpad(x.cast("string"), 9, "0")).alias("links"))
    links = table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("id"), (F.col("s_suppkey") % 100).cast("double").alias("length_m"))
    rides = r.select("ride", F.col("ride").alias("line"), F.lit("r").alias("route"), F.col("links")[0].alias("access_link"), F.element_at("links", -1).alias("egress_link"))
    return transit.ride_distance(rides, r.select(F.col("ride").alias("line"), F.lit("r").alias("route"), "links"), links)


_RIDES = """with l as (select l_orderkey, l_suppkey % 100 as len, l_suppkey = min(l_suppkey) over w as lo, l_suppkey = max(l_suppkey) over w as hi from lineitem window w as (partition by l_orderkey)), g as (select l_orderkey, sum(len) as s, max(case when lo then len end) as a, max(case when hi then len end) as z, count(*) filter (hi) as h, bool_or(lo and hi) as one from l group by 1)
select cast(l_orderkey as varchar) as ride, cast(case when one then 0 else s - a - (h - 1) * z end as double) as distance from g"""


def router_answers(spark, sf):
    """JON-17: legs and the activities between them in turn; answers with too many activities are errors."""
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    seq = lambda k: F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    acts = F.when(F.col("l_orderkey") % 5 == 0, F.col("n")).otherwise(F.col("n") - 1)
    rows = r.select(F.col("l_orderkey").alias("request"), seq(F.col("n")).alias("legs"), seq(acts).alias("activities"))
    return prepare.answered(rows).select("request", "pos", "kind", F.coalesce("leg", "activity").alias("what"))


_ANSWERS = """with g as (select l_orderkey as request, count(*) as n from lineitem group by 1) select request, 0 as pos, 'error' as kind, null as what from g where request % 5 = 0
union all select request, cast(k as integer), case when k % 2 = 0 then 'leg' else 'act' end, cast(k // 2 + 1 as varchar) from (select request, unnest(range(2 * n - 1)) as k from g where request % 5 <> 0)"""


def _from_first(spark, sf):
    l = _network(spark, sf)  # noqa: E741
    start = l.agg(F.min(F.struct("from_node", "to_node", "id")).alias("s")).first()["s"]  # one row
    requests = l.select(F.col("id").alias("request"), F.lit(start["id"]).alias("from_link"), F.col("id").alias("to_link"), F.lit(0.0).alias("dep_s")).filter(F.col("request") != start["id"])
    return l, requests


def network_trips(spark, sf):
    """RTE-11, RTE-12: the elements of the trips from the first link to every other one, with a walk at either end."""
    l, requests = _from_first(spark, sf)  # noqa: E741
    paths = routing.least_cost_paths(requests, routing.build_graph(table(spark, sf, "nodes"), l), 20.0)
    trips = routing.network_trip(paths, F.lit(30.0), F.lit(45.0), "car")
    return trips.select("request", "pos", "kind", F.coalesce("mode", "act_type").alias("what"), F.round(F.col("trav_ns") / NS, 3).alias("trav_s"))


_FIRST = "select arg_min(t, {'a': f, 'b': t, 'c': id}) as s, arg_min(t, {'a': f, 'b': t, 'c': id}) as z, min({'a': f, 'b': t, 'c': id}).c as first from l)"
_FROM = _COSTS.replace("select min(f) as s, max(f) as z from l)", _FIRST)
_TRIPS = _FROM.replace("len / sp", "len / least(sp, 20)") + """, c as (select l.id as request, round(b.cost + len / least(sp, 20), 3) as t from l cross join s join best b on b.node = l.f and b.src = s.s where l.id <> s.first)
select request, p.pos, p.kind, p.what, case when p.pos = 2 then t else p.trav end as trav_s from c, (values (0, 'leg', 'walk', 30.0::double), (1, 'act', 'car interaction', 0.0), (2, 'leg', 'car', 0.0), (3, 'act', 'car interaction', 0.0), (4, 'leg', 'walk', 45.0)) p(pos, kind, what, trav)"""


def reroute_observed(spark, sf):
    """RTE-17, EXT-08, EXT-09, EXT-11: least costs to every link when long links have been seen to take 500 s at any time of the day; bikes by the times of cars."""
    l, requests = _from_first(spark, sf)  # noqa: E741
    g = routing.build_graph(table(spark, sf, "nodes"), l)
    seen = l.filter("length_m > 5000").select(F.lit("car").alias("mode"), F.col("id").alias("link"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("bin"), F.lit(500e9).alias("mean_ns"))
    bound = controller.Scenario(None, l, None, None, travel_time_modes={"bike": "car"}).travel_time_modes.get("bike", "bike")
    bins = routing.observed_bins(seen, g, bound, 24)
    return routing.least_cost_paths(requests, g, observed=bins, bin_s=3600.0).select("request", F.round("cost", 4).alias("cost"))


_REROUTE = _FROM.replace("else len / sp end", "else case when len > 5000 then 500 else len / sp end end") + " select l.id as request, round(b.cost, 4) as cost from l cross join s left join best b on b.node = l.f and b.src = s.s where l.id <> s.first"


def routers_by_mode(spark, sf):
    """RTE-14, RTE-15, EXT-07: links as trips of two modes, each by the router of its mode."""
    e = network.with_ends(table(spark, sf, "links").select("id", "from_node", "to_node").distinct(), table(spark, sf, "nodes")).withColumn("mode", F.when(F.length("id") % 2 == 0, "walk").otherwise("bike"))
    by = lambda factor, speed: lambda df: routing.teleported(df, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), factor, speed)
    return routing.routed_by_mode(e, {"walk": by(1.5, 1.0), "bike": by(1.25, 4.0)}).select("id", "mode", F.round("distance_m", 5).alias("distance_m"))


def edited_network(spark, sf):
    """RTE-21: the nodes of part 0 go with their links, and some links are added, of which one is there already and others lead nowhere."""
    n = table(spark, sf, "nodes").select("id", "x", "y", "partition_no").distinct()
    l = _network(spark, sf).select("id", "from_node", "to_node")  # noqa: E741
    gone = n.filter("partition_no = 0").select("id")
    kept = l.join(gone.select(F.col("id").alias("from_node")), "from_node", "left_anti").join(gone.select(F.col("id").alias("to_node")), "to_node", "left_anti")
    twice = kept.agg(F.min(F.struct("id", "from_node", "to_node")).alias("s")).select("s.*")
    lost = gone.select(F.concat(F.lit("to "), "id").alias("id"), F.col("id").alias("from_node"), F.col("id").alias("to_node"))
    nodes, links, bad = network.edited(n, l, add_links=twice.union(lost), drop_nodes=gone)
    return bad.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).union(links.select(F.lit("links"), F.col("id")).groupBy("links").count()).union(nodes.select(F.lit("nodes").alias("nodes")).groupBy("nodes").count())


_EDITED = """with n as (select distinct id, partition_no from nodes), g as (select id from n where partition_no = 0), l as (select id, min(from_node) as f, min(to_node) as t from links group by id), k as (select * from l where f not in (select id from g) and t not in (select id from g))
select * from (select 'repeated link' as kind, 1::bigint as n where (select count(*) from k) > 0 union all select 'unknown from_node', (select count(*) from g) union all select 'unknown to_node', (select count(*) from g) union all select 'links', (select count(*) from k) + (select count(*) from g) + case when (select count(*) from k) > 0 then 1 else 0 end union all select 'nodes', (select count(*) from n where partition_no <> 0)) where n > 0"""


def rest_of_partition(spark, sf):
    """RTE-19: nodes without a car link get the part of the nearest node that has one."""
    n = table(spark, sf, "nodes").select("id", "x", "y", "partition_no").distinct()
    l = table(spark, sf, "links").select("id", "from_node", "to_node", "modes").distinct()  # noqa: E741
    return network.partition_rest(n, l, n.select(F.col("id").alias("node"), "partition_no"), ["car"])


_REST = """with n as (select distinct id, x, y, partition_no as p from nodes), u as (select from_node as id from links where list_contains(modes, 'car') union select to_node from links where list_contains(modes, 'car')), h as (select * from n where id in (select id from u)), r as (select * from n where id not in (select id from u)),
d as (select r.id, h.p, h.id as o, sqrt((r.x - h.x) * (r.x - h.x) + (r.y - h.y) * (r.y - h.y)) as d from r, h) select id as node, p as partition_no from h union all select id, arg_min(p, {'d': d, 'o': o}) from d group by id"""


def link_part_sizes(spark, sf):
    """RTE-20: links by the part of the node they end at."""
    n = table(spark, sf, "nodes").select(F.col("id").alias("node"), "partition_no").distinct()
    return network.link_partitions(_network(spark, sf), n).groupBy("partition_no").agg(F.count(F.lit(1)).alias("n"))


def modal_counts(spark, sf):
    """AGG-10, PRJ-08: the modes of the network and how many links each may use."""
    l = table(spark, sf, "links").groupBy("id").agg(F.max("modes").alias("modes"))  # noqa: E741
    kinds = sorted(r["mode"] for r in network.modes_of(l).collect())  # a few
    return l.select(F.explode(F.array(*(F.when(network.allows(F.col("modes"), m), F.lit(m)) for m in kinds))).alias("mode")).filter("mode is not null").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def node_modes(spark, sf):
    """SET-04: the modes of all links that leave a node, sorted and distinct."""
    return network.mode_union(table(spark, sf, "links"), "from_node").select("from_node", F.array_join("modes", ",").alias("modes"))


def united_shards(spark, sf):
    """SET-03: a population in three parts that have no person in common."""
    p = _elements(spark, sf)
    return planops.united([p.filter(F.col("person").cast("long") % 3 == i) for i in range(3)]).groupBy("person").agg(F.count(F.lit(1)).alias("n"))


def averaged_scores(spark, sf):
    """WIN-13, SCO-10, SCO-13: new scores of selected plans averaged with those counted so far."""
    p = cat.plans(spark, sf).withColumn("msa_n", (F.col("plan_idx") % 3).cast("int"))
    new = p.select("person").distinct().select("person", (F.col("person") % 100).cast("double").alias("score"))
    return selection.assign_scores(p, new, True).select("person", "plan_idx", F.round("score", 6).alias("score"), "msa_n")


_AVERAGED = f"""with {cat._PLANS}, q as (select *, cast(plan_idx % 3 as integer) as m, cast(person % 100 as double) as new from p)
select person, plan_idx, round(case when not selected then score when score is null then new else new / (m + 1) + (1 - 1.0::double / (m + 1)) * score end, 6) as score, case when selected and score is not null then m + 1 else m end as msa_n from q"""


def _parameters(spark, waiting_pt=None):
    return scoring.Parameters(
        spark.createDataFrame([(None, 6.0, 0.0, 1.0, -18.0, waiting_pt, -1.0)], "subpopulation string, performing double, waiting double, money double, aborted double, waiting_pt double, line_switch double"),
        spark.createDataFrame([(None, "home", 28_800.0, True, None, None)], "subpopulation string, act_type string, typical_s double, scored boolean, open_s double, close_s double"),
        spark.createDataFrame([(None, "view", -6.0, 0.0, -0.001, -1.0, -2.0, -0.5), (None, "click", -3.0, -0.002, 0.0, 0.0, -4.0, 0.0), (None, "purchase", -1.0, 0.0, 0.0, 0.0, 0.0, -7.0)], "subpopulation string, mode string, travelling_h double, distance_m double, money_rate_m double, daily_money double, daily_utility double, constant double"),
    )


def _scored(spark, sf):
    act = F.col("kind") == "act"
    e = _elements(spark, sf)
    return e.withColumns({"start_ns": F.when(act, F.col("end_ns") % times.DAY_NS), "dep_ns": F.col("end_ns"), "end_ns": F.when(act, F.col("end_ns") % times.DAY_NS + 60 * NS), "trav_ns": F.lit(600 * NS).cast("long"), "distance": F.lit(1000.0), "boarding_ns": _null("long"), "route_type": F.lit("generic"), "aborted": F.lit(False)})


def _users(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("person")).distinct().withColumn("subpopulation", _null("string"))


def plan_scores(spark, sf):
    """SCO-02, SCO-03, SCO-04, SCO-05, AGG-15: activities and legs of every user's plan."""
    return scoring.scores(_scored(spark, sf), _users(spark, sf), _parameters(spark), ["view"], 86_400 * NS).select("person", F.round("score", 4).alias("score"))


_SCORES = f"""with a as ({cat.SQL["overnight_wrap"]}), l as ({cat.SQL["leg_scores"]}), u as (select person, departure_s - arrival_s as d, 28800 * exp(-1.0) as z, 6.0::double / 3600 as b from a),
s as (select person, sum(case when d >= z then b * 28800 * (ln(d / 28800) + 1) else -(b * 28800 / z) * (z - d) end) as s from u group by person), p as (select distinct cast(user_id as varchar) as person from events)
select p.person, round(coalesce(s.s, 0) + coalesce(l.score, 0), 4) as score from p left join s on s.person = p.person left join l on l.person = p.person"""


def waiting_scores(spark, sf):
    """SCO-06: views as transit legs boarded two minutes after the departure; waiting costs 2 an hour where travelling costs 6."""
    e = _scored(spark, sf).filter("kind = 'leg'").withColumns({"boarding_ns": F.col("dep_ns") + 120 * NS, "route_type": F.when(F.col("mode") == "view", "default_pt").otherwise("generic")})
    known = _users(spark, sf).withColumn("_set", _null("string"))
    p = _parameters(spark, -2.0)
    with_wait, without = scoring.leg_scores(e, known, p, []), scoring.leg_scores(e.withColumn("route_type", F.lit("generic")), known, p, [])
    total = lambda df, n: df.groupBy("person").agg(F.sum("score").alias(n))
    return total(with_wait, "a").join(total(without, "b"), "person").select("person", F.round(F.col("a") - F.col("b"), 6).alias("correction"))


def abort_scores(spark, sf):
    """SCO-08, PRJ-13: plans with an error are aborted and cost the abort parameter for each hour of the simulation."""
    e = _scored(spark, sf).withColumn("aborted", F.col("act_type") == "car interaction").filter("act_type = 'car interaction'")
    return scoring.scores(e, _users(spark, sf), _parameters(spark), [], 36 * 3600 * NS)


def travel_scores(spark, sf):
    """SCO-09, WIN-10: elapsed times of trips, waits included; null where a leg departs before the one before has arrived."""
    e = _elements(spark, sf).withColumns({"dep_ns": F.col("end_ns"), "trav_ns": F.lit(60 * NS).cast("long")})
    return scoring.travel_time_scores(e).select("person", F.round("score", 3).alias("score"))


_TRAVEL = f"""{_EL}, g as (select *, lag(end_ns) over (partition by person, trip order by elem) as b from tr where kind = 'leg'), t as (select person, trip, max(end_ns) + 60000000000 - min(end_ns) as ns, bool_or(coalesce(end_ns < b + 60000000000, false)) as bad from g group by person, trip)
select person, case when not bool_or(bad) then round(-sum(ns) / 1e9::double, 3) end as score from t group by person"""


def parameter_faults(spark, sf):
    """SCO-11: market segments as parameter sets: those that are there several times, and opening hours that end before they begin."""
    c = table(spark, sf, "customer")
    acts = c.select(F.lit(None).cast("string").alias("subpopulation"), F.concat(F.lit("a"), "c_custkey").alias("act_type"), F.lit(1.0).alias("typical_s"), F.lit(True).alias("scored"), F.lit(3600.0).alias("open_s"), F.col("c_acctbal").cast("double").alias("close_s"))
    faults = scoring.Parameters(c.select(F.col("c_mktsegment").alias("subpopulation"), "c_custkey"), acts, _parameters(spark).modes).errors()
    return spark.createDataFrame([(x,) for x in faults], "fault string")


_FAULTS = "select 'repeated: (''' || c_mktsegment || ''',)' as fault from customer group by c_mktsegment having count(*) > 1 union all select 'opens after it closes: a' || c_custkey from customer where 3600 > c_acctbal"


def converted_parameters(spark, sf):
    """SRC-12, SRC-21, SCO-12, AGG-16, SNK-15: a set per nation, converted from the XML scoring module, with the score of an aborted hour, by way of the YAML file."""
    from veloframe.catalogue_runs import _folder

    folder = Path(_folder(spark, "parameters"))
    folder.mkdir(parents=True)
    nations = table(spark, sf, "nation").collect()  # 25 rows
    mode = lambda v: f'<parameterset type="modeParams"><param name="mode" value="car"/><param name="marginalUtilityOfTraveling_util_hr" value="{v}"/></parameterset>'
    box = lambda r: f'<parameterset type="scoringParameters"><param name="subpopulation" value="n{r.n_nationkey}"/><param name="performing" value="{r.n_nationkey}"/><param name="lateArrival" value="{-r.n_regionkey}"/>{mode(-2 * r.n_regionkey)}</parameterset>'
    (folder / "s.xml").write_text(f'<config><module name="scoring">{"".join(map(box, nations))}</module></config>')
    config.write_parameters(config.converted(str(folder / "s.xml")), str(folder / "s.yml"))
    return config.parameters(spark, str(folder / "s.yml")).sets.select("subpopulation", "performing", "aborted")


def cost_factors(spark, sf):
    """AGG-09, FUN-12: over the parameter sets of market segments, the least cost of a second and of a metre."""
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("subpopulation")).agg(F.max("c_acctbal").cast("double").alias("p"), F.min("c_acctbal").cast("double").alias("t"))
    sets = c.select("subpopulation", F.col("p").alias("performing"), F.lit(0.1).alias("money"))
    modes = c.select("subpopulation", F.lit("car").alias("mode"), F.col("t").alias("travelling_h"), F.col("t").alias("distance_m"), F.col("p").alias("money_rate_m"))
    return scoring.least_cost_factors(scoring.Parameters(sets, None, modes)).select("mode", F.round("per_second", 9).alias("t"), F.round("per_metre", 6).alias("d"))


def spatial_distances(spark, sf):
    """FUN-13, FUN-14: lengths and middles of links, with their lanes as a height."""
    e = network.with_ends(table(spark, sf, "links").select("id", "from_node", "to_node", "permlanes").distinct(), table(spark, sf, "nodes"))
    d = geometry.distance(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(0.0), F.col("permlanes"))
    return e.select("id", F.round(d, 6).alias("distance"), F.round(geometry.midpoint(F.col("x0"), F.col("x1")), 6).alias("x"))


def usable_bins(spark, sf):
    """FUN-08: which order quantities, in half seconds, are a bin of whole ticks."""
    def ok(q: int, tps: int) -> bool:
        try:
            return times.checked_bin(q * NS // 2, tps) == q * NS // 2
        except ValueError:
            return False

    q = sorted(int(r[0]) for r in table(spark, sf, "lineitem").select("l_quantity").distinct().collect())  # 50 quantities
    return spark.createDataFrame([(k, t, ok(k, t)) for k in q for t in (1, 2)], "q int, ticks int, ok boolean")


def resolved_paths(spark, sf):
    """SRC-20, SRC-27, FUN-29, FUN-30, EXT-13: paths of nations' files beside the configuration, and overrides put over it."""
    from veloframe.catalogue_runs import _folder

    folder = Path(_folder(spark, "config"))
    folder.mkdir(parents=True)
    (folder / "c.yml").write_text("modules:\n  qsim: {end_time: 7}\n")
    rows = []
    for r in table(spark, sf, "nation").collect():  # 25 rows
        c = config.load(str(folder / "c.yml"), [f"qsim.stuck_threshold={r.n_nationkey}", f"network.path={r.n_name}.xml"])
        rows.append((r.n_nationkey, c.qsim.end_time, c.qsim.stuck_threshold, c.path(c.files.network).removeprefix(str(folder)), config.resolved(f"./{r.n_name}", "/b"), config.resolved(f"/{r.n_name}", "/b")))
    return spark.createDataFrame(rows, "n int, end_s int, stuck int, beside string, here string, absolute string")


def random_numbers(spark, sf):
    """FUN-19, FUN-20: one number per customer, the same at every run, and what a weighted draw by it gives."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("person"))
    a, b = (c.withColumn("u", rng.uniform(42, "test", F.col("person"))) for _ in range(2))
    j = a.join(b.withColumnRenamed("u", "v"), "person")
    return j.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("u") == F.col("v")) & (F.col("u") >= 0) & (F.col("u") < 1)).alias("same"), (F.abs(F.avg("u") - 0.5) < 0.05).alias("even"))


def _run(spark, sf, output: str | None = None, scorer=controller.travel_time_scorer):
    """Two iterations of every user as a walker, scored by travel time, and what was announced."""
    home = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("person")).agg(F.expr("min(event_id) % 80000").alias("t"))
    element = lambda i, **v: F.struct(F.lit(i).alias("elem_idx"), *(v.get(c, F.lit(None)).cast(k).alias(c) for c, k in prepare._KINDS.items()))
    walk = element(1, kind=F.lit("leg"), mode=F.lit("walk"), routing_mode=F.lit("walk"), route_type=F.lit("generic"), start_link=F.lit("a"), end_link=F.lit("a"), trav_ns=F.lit(600 * NS), route_trav_ns=F.lit(600 * NS), distance=F.lit(500.0))
    rows = F.array(element(0, kind=F.lit("act"), act_type=F.lit("home"), link=F.lit("a"), end_ns=F.col("t") * NS), walk, element(2, kind=F.lit("act"), act_type=F.lit("work"), link=F.lit("a")))
    e = home.select("person", F.lit(0).alias("plan_idx"), F.lit(True).alias("selected"), F.lit(None).cast("double").alias("score"), F.explode(rows).alias("e")).select("person", "plan_idx", "selected", "score", "e.*")
    links = spark.createDataFrame([("a", "p", "q", 10.0, 10.0, 3600.0, 1.0, ["car"])], "id string, from_node string, to_node string, length_m double, freespeed double, capacity double, permlanes double, modes array<string>")
    nodes = spark.createDataFrame([("p", 0.0, 0.0), ("q", 10.0, 0.0)], "id string, x double, y double")
    c = config.Config()
    c.controller.last_iteration, c.qsim.main_modes, c.scoring.fraction_for_msa = 1, ["car"], 0.0
    if output:
        c.output.output_dir, c.output.overwrite_files, c.output.write_events, c.controller.write_events_interval = output, config.Overwrite.DELETE, "File", 1
    seen, bus = [], controller.Bus()
    bus.on("*", lambda p: seen.append((p["number"], p["name"], p["iteration"])))
    st = controller.run(controller.Scenario(nodes, links, materialize(e, "elements"), home.select("person", F.lit("person").alias("subpopulation"))), c, scorer, bus, write=output is not None)
    return st, seen


def run_plans(spark, sf):
    """SCO-01, SCO-13, EXT-05, STR-06: plans after a run of two iterations, with averaged scores."""
    return _run(spark, sf)[0].plans.select("person", "plan_idx", "selected", "score", "msa_n")


def run_announcements(spark, sf):
    """STR-12, PRJ-03, EXT-02, EXT-03: what a listener of everything hears of a run, in order."""
    return spark.createDataFrame(_run(spark, sf)[1], "number int, name string, iteration int")


def run_files(spark, sf):
    """SNK-09, SNK-11, SNK-04, SCO-14: a run without a scorer into a folder that another file is in: events of each iteration and of the run, and plans without scores."""
    from veloframe.catalogue_runs import _folder

    folder = Path(_folder(spark, "run"))
    folder.mkdir(parents=True)
    (folder / "old.txt").write_text("goes")
    _run(spark, sf, str(folder), None)
    count = lambda path, name: spark.read.parquet(f"{folder}/{path}").groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("file", F.lit(name))
    plans = spark.read.parquet(f"{folder}/1.plans.parquet").filter("score is null and kind = 'leg'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("leg").alias("type"), "n", F.lit("plans").alias("file"))
    old = spark.createDataFrame([("old", int((folder / "old.txt").exists()), "old")], "type string, n long, file string")
    return count("output_events.parquet", "run").unionByName(count("events/iteration=0", "first")).unionByName(plans).unionByName(old)


_RUN_FILES = "with u as (select count(distinct user_id) as n from events) select type, n, file from u, (values ('actend'), ('departure'), ('travelled'), ('arrival'), ('actstart')) t(type), (values ('run'), ('first')) f(file) union all select 'leg', n, 'plans' from u union all select 'old', 0, 'old'"


def ignored_trips(spark, sf):
    """PLN-13, SEL-11: trips without a distance are routed anew, but for those of bikes, which are ignored."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    kinds = {**prepare._KINDS}
    element = lambda i, **v: F.struct(F.lit(i).alias("elem_idx"), *(v.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))
    mode = F.when(k % 2 == 0, "walk").otherwise("bike")
    rows = F.array(element(0, kind=F.lit("act"), act_type=F.lit("home"), link=F.lit("l"), x=k, y=F.lit(0.0), end_ns=F.lit(NS)), element(1, kind=F.lit("leg"), mode=mode, routing_mode=mode), element(2, kind=F.lit("act"), act_type=F.lit("work"), link=F.lit("l"), x=k + k % 7, y=F.lit(0.0)))
    e = c.select(k.cast("string").alias("person"), F.lit(0).alias("plan_idx"), F.explode(rows).alias("e")).select("person", "plan_idx", "e.*")
    l, n = _network(spark, sf), table(spark, sf, "nodes")  # noqa: E741
    got = prepare.prepared(e, l, n, routing.build_graph(n, l, "car"), ["car"], {"walk": (1.5, 2.0), "bike": (1.5, 4.0)}, ignore=("bike",))
    return got.filter("kind = 'leg'").select("person", "mode", F.round("distance", 4).alias("distance"), F.expr(f"trav_ns div {NS // 1000}").alias("trav_ms"))


_REF = "select cast(user_id as varchar) as person"
SQL = {
    "trip_departures": f"with pc as ({_CLOCK}), sp as ({_SEGMENTS}) select sp.person, sp.trip, pc.at_ns as departure_ns from sp join pc on pc.person = sp.person and pc.elem_idx = sp.origin_idx",
    "spliced_trips": _SPLICED,
    "synchronised_times": f"{_EL} select event_id, case when event_id % 3 = 0 then 600000000000 when event_id % 5 = 0 then 900000000000 end as trav_ns, case when event_id % 2 = 0 then case when event_id % 5 = 0 then 900000000000 when event_id % 3 = 0 then 600000000000 end end as route_trav_ns from tr where kind = 'leg'",
    "leg_distances": _DISTANCES, "valid_trips": _VALID.format("true"), "valid_transit_trips": _VALID.format("(mode <> 'view' or (event_id % 3 <> 2 and event_id * 7 % 5 > event_id % 5))"),
    "located_acts": _LOCATED, "facility_links": _FACILITY_LINKS, "leg_vehicles": _VEHICLES, "adaptive_users": "select cast(user_id as varchar) as person, bool_or(event_id % 50 = 0) as adaptive from events group by 1",
    "start_partitions": f"{_EL}, f as (select person, arg_min(event_id, elem) as e from tr where kind = 'act' group by person) select person, cast((e % 5) * (e % 5) as integer) as partition_no from f",
    "main_acts": f"{_EL} select person, count(*) as n, min(elem) as first from tr where act_type = 'home' group by person",
    "typed_attributes": _TYPED,
    "route_ends": f"with {_STOPS}, k as (select line, route, pos, case when f <= 7 then 'k' || (f % 7) end as link from o), m as (select line, route, min(pos) as a, max(pos) as z from k group by all) select m.line, m.route, p.link as start_link, q.link as end_link from m join k p on p.line = m.line and p.pos = a join k q on q.line = m.line and q.pos = z",
    "stop_times": f"with {_STOPS} select line, pos, cast(line as bigint) % 1000 * 1000000000 + ao as arr_ns, cast(line as bigint) % 1000 * 1000000000 + d as dep_ns from o",
    "stop_delays": f"with {_STOPS}, x as (select line, pos, sum(case when pos % 2 = 1 then 60000000000 else 0 end - coalesce(d - ao, 0)) over (partition by line order by pos rows unbounded preceding) as s from o) select line, pos, cast(s - least(min(s) over (partition by line order by pos rows unbounded preceding), 0) as bigint) as delay_ns from x",
    "schedule_issues": _SCHEDULE, "boarded_calls": _BOARDED, "ride_distances": _RIDES, "router_answers": _ANSWERS, "network_trips": _TRIPS, "reroute_observed": _REROUTE,
    "routers_by_mode": "with n as (select distinct id, x, y from nodes), l as (select distinct l.id, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) as d from links l join n a on a.id = l.from_node join n b on b.id = l.to_node) select id, case when length(id) % 2 = 0 then 'walk' else 'bike' end as mode, round(d * case when length(id) % 2 = 0 then 1.5 else 1.25 end, 5) as distance_m from l",
    "edited_network": _EDITED, "rest_of_partition": _REST,
    "link_part_sizes": "with n as (select distinct id, partition_no from nodes), l as (select id, min(to_node) as t from links group by id) select partition_no, count(*) as n from l left join n on n.id = l.t group by 1",
    "modal_counts": "with l as (select id, max(modes) as m from links group by id) select mode, count(*) as n from (select id, unnest(list_distinct(m)) as mode from l) group by mode",
    "node_modes": "with x as (select from_node, unnest(modes) as m from links) select n.from_node, coalesce(string_agg(distinct m, ',' order by m), '') as modes from (select distinct from_node from links) n left join x on x.from_node = n.from_node group by 1",
    "united_shards": f"{_REF}, count(*) as n from events group by 1", "averaged_scores": _AVERAGED, "plan_scores": _SCORES,
    "waiting_scores": f"{_REF}, round(count(*) filter (event_type = 'view') * 120 * 4.0::double / 3600, 6) as correction from events where event_type in ('view', 'click', 'purchase') group by 1",
    "abort_scores": f"{_REF}, case when bool_or(event_type = 'error') then 36 * -18.0::double else 0.0 end as score from events group by 1",
    "travel_scores": _TRAVEL, "parameter_faults": _FAULTS,
    "converted_parameters": "select 'n' || n_nationkey as subpopulation, cast(n_nationkey as double) as performing, cast(least(-n_regionkey, 0, -2 * n_regionkey - n_nationkey, -n_nationkey) as double) as aborted from nation",
    "cost_factors": "with c as (select max(c_acctbal) as p, min(c_acctbal) as t from customer group by c_mktsegment) select 'car' as mode, round(min((-t + p) / 3600), 9) as t, round(min(-t - p * 0.1), 6) as d from c",
    "spatial_distances": "with n as (select distinct id, x, y from nodes), l as (select distinct l.id, a.x as x0, a.y as y0, b.x as x1, b.y as y1, permlanes as z from links l join n a on a.id = l.from_node join n b on b.id = l.to_node) select id, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + z * z), 6) as distance, round((x0 + x1) / 2, 6) as x from l",
    "usable_bins": "select cast(q as integer) as q, t as ticks, q * t % 2 = 0 as ok from (select distinct l_quantity as q from lineitem), (values (1), (2)) v(t)",
    "resolved_paths": "select cast(n_nationkey as integer) as n, 7 as end_s, cast(n_nationkey as integer) as stuck, '/' || n_name || '.xml' as beside, './' || n_name as here, '/' || n_name as absolute from nation",
    "random_numbers": "select count(*) as n, true as same, true as even from customer",
    "run_files": _RUN_FILES, "ignored_trips": "select cast(c_custkey as varchar) as person, case when c_custkey % 2 = 0 then 'walk' else 'bike' end as mode, case when c_custkey % 2 = 0 then round(c_custkey % 7 * 1.5::double, 4) end as distance, case when c_custkey % 2 = 0 then c_custkey % 7 * 750 end as trav_ms from customer",
    "run_plans": f"{_REF}, 0 as plan_idx, true as selected, -600.0::double as score, 1 as msa_n from events group by 1",
    "run_announcements": "select * from (values (1, 'iteration_starts', 0), (2, 'simulated', 0), (3, 'scored', 0), (4, 'iteration_ends', 0), (5, 'iteration_starts', 1), (6, 'simulated', 1), (7, 'scored', 1), (8, 'iteration_ends', 1)) v(number, name, iteration)",
}
SQL["plan_issues"] = _ISSUES.format(SQL["trip_departures"])
QUERIES = {f.__name__: f for f in (
    trip_departures, spliced_trips, synchronised_times, leg_distances, valid_trips, valid_transit_trips, located_acts, facility_links, leg_vehicles, adaptive_users, plan_issues, start_partitions, main_acts, typed_attributes, route_ends, stop_times, stop_delays, schedule_issues, boarded_calls, ride_distances, router_answers, network_trips, reroute_observed,
    routers_by_mode, edited_network, rest_of_partition, link_part_sizes, modal_counts, node_modes, united_shards, averaged_scores, plan_scores, waiting_scores, abort_scores, travel_scores, parameter_faults, converted_parameters, cost_factors, spatial_distances, usable_bins, resolved_paths, random_numbers, run_plans, run_announcements, run_files, ignored_trips,
)}
