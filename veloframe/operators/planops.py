"""Plans as element rows: trips, times along a plan, checks, repairs and preparation.

Elements: ``person, plan_idx, elem_idx, kind`` (act, leg), of activities ``act_type, link, x, y, facility, start_ns, end_ns, max_dur_ns``, of legs
``mode, routing_mode, dep_ns, trav_ns, route_type, start_link, end_link, route_trav_ns, distance, vehicle, links``. A person's plans lie in one
partition after the first window, and all further windows of a chain use that partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloframe.functions.attributes import is_interaction
from veloframe.functions.times import NS
from veloframe.operators.network import connected, modal_link, nearest_link, route_distance

PLAN = ["person", "plan_idx"]
#: More modes than this are refused where every person gets something of each.
MOST_MODES = 10_000


def _plan() -> Window:
    return Window.partitionBy(*PLAN).orderBy("elem_idx")


def united(shards: list[DataFrame]) -> DataFrame:
    """Parts of a population as one; a person in more than one part is an error, found before anything is used."""
    parts = [df.select("person").distinct() for df in shards]
    twice = reduce(DataFrame.unionAll, parts).groupBy("person").count().filter("count > 1").select("person").limit(5).collect()
    if twice:
        raise ValueError(f"persons in several parts: {[r[0] for r in twice]}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def main_activities(elements: DataFrame) -> DataFrame:
    return elements.filter((F.col("kind") == "act") & ~is_interaction(F.col("act_type")))


def with_trips(elements: DataFrame, stage: Column | None = None) -> DataFrame:
    """Elements with ``trip``: how many main activities lie at or before them. Elements that are no main activity belong to trip ``trip``;
    stage: what is not a main activity (by default an interaction)."""
    stage = is_interaction(F.col("act_type")) if stage is None else stage
    main = (F.col("kind") == "act") & ~F.coalesce(stage, F.lit(False))
    return elements.withColumn("is_main", main).withColumn("trip", F.sum(main.cast("int")).over(_plan().rowsBetween(Window.unboundedPreceding, 0)))


def trip_spans(elements: DataFrame, stage: Column | None = None) -> DataFrame:
    """``person, plan_idx, trip, origin_idx, destination_idx``: two consecutive main activities with something between them."""
    main = with_trips(elements, stage).filter("is_main").withColumn("destination_idx", F.lead("elem_idx").over(_plan()))
    return main.filter("destination_idx > elem_idx + 1").select(*PLAN, "trip", F.col("elem_idx").alias("origin_idx"), "destination_idx")


def next_trip(spans: DataFrame, at: Column) -> DataFrame:
    """Of each plan the first trip that begins at or after an element."""
    return spans.filter(F.col("origin_idx") >= at).groupBy(*PLAN).agg(F.min(F.struct("origin_idx", "destination_idx", "trip")).alias("t")).select(*PLAN, "t.*")


def main_modes(elements: DataFrame) -> DataFrame:
    """``person, plan_idx, trip, main_mode``: the one routing mode of a trip's legs, else the mode of its only leg; null is an error."""
    legs = with_trips(elements).filter("kind = 'leg'")
    per = legs.groupBy(*PLAN, "trip").agg(F.collect_set("routing_mode").alias("m"), F.count(F.lit(1)).alias("n"), F.first("mode").alias("only"))
    return per.select(*PLAN, "trip", F.when(F.size("m") == 1, F.get("m", F.lit(0))).when((F.size("m") == 0) & (F.col("n") == 1), F.col("only")).alias("main_mode"))


def plan_times(elements: DataFrame, start_ns: int = 0) -> DataFrame:
    """Elements with ``at_ns``, the time at their end: a fixed end is the time; a maximum duration adds to the time before; of a leg the
    route's travel time comes before the leg's. A gap makes the time null up to the next fixed end.

    One running sum per stretch between fixed ends, no loop along the plan."""
    run = _plan().rowsBetween(Window.unboundedPreceding, 0)
    act = F.col("kind") == "act"
    fixed = F.when(act, F.col("end_ns"))
    step = F.when(act, F.col("max_dur_ns")).otherwise(F.coalesce("route_trav_ns", "trav_ns"))
    rows = elements.withColumn("_fixed", fixed).withColumn("_g", F.count("_fixed").over(run))
    part = Window.partitionBy(*PLAN, "_g").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, 0)
    add = F.when(F.col("_fixed").isNotNull(), F.lit(0).cast("long")).otherwise(step)
    rows = rows.withColumn("_gap", F.sum(add.isNull().cast("int")).over(part)).withColumn("_sum", F.sum(add).over(part)).withColumn("_base", F.coalesce(F.first("_fixed", ignorenulls=True).over(part), F.when(F.col("_g") == 0, F.lit(start_ns).cast("long"))))
    return rows.withColumn("at_ns", F.when(F.col("_gap") == 0, F.col("_base") + F.col("_sum"))).drop("_fixed", "_g", "_gap", "_sum", "_base")


def departures(elements: DataFrame) -> DataFrame:
    """``person, plan_idx, trip, departure_ns``: the time at the end of each trip's origin; null if the chain of times has a gap."""
    return plan_times(elements).join(trip_spans(elements).withColumnRenamed("origin_idx", "elem_idx"), [*PLAN, "elem_idx"]).select(*PLAN, "trip", F.col("at_ns").alias("departure_ns"))


def spliced(elements: DataFrame, spans: DataFrame, new: DataFrame) -> DataFrame:
    """Plans in which what lies within ``spans`` (``person, plan_idx, origin_idx, destination_idx``) is replaced by the rows of ``new``
    (``person, plan_idx, origin_idx, pos`` and element columns), renumbered."""
    s = spans.select(*PLAN, F.col("origin_idx").alias("_o"), F.col("destination_idx").alias("_d"))
    inside = elements.join(s, PLAN).filter((F.col("elem_idx") > F.col("_o")) & (F.col("elem_idx") < F.col("_d"))).select(*PLAN, "elem_idx")
    kept = elements.join(inside, [*PLAN, "elem_idx"], "left_anti").withColumns({"_at": F.col("elem_idx"), "_pos": F.lit(-1)})
    put = new.withColumnsRenamed({"origin_idx": "_at", "pos": "_pos"})
    rows = kept.drop("elem_idx").unionByName(put, allowMissingColumns=True)
    order = Window.partitionBy(*PLAN).orderBy("_at", "_pos")
    return rows.withColumn("elem_idx", (F.row_number().over(order) - 1).cast("int")).drop("_at", "_pos").select(*elements.columns)


def synchronised(elements: DataFrame) -> DataFrame:
    """A leg's travel time and its route's, each taken from the other where only one is set."""
    return elements.withColumns({"trav_ns": F.coalesce("trav_ns", "route_trav_ns"), "route_trav_ns": F.when(F.col("route_type").isNotNull(), F.coalesce("route_trav_ns", "trav_ns"))})


def filled_distances(elements: DataFrame, links: DataFrame) -> DataFrame:
    """Where a network leg of a trip lacks its distance, those of all network legs of the trip are computed from their links."""
    rows = with_trips(elements)
    net = (F.col("kind") == "leg") & (F.col("route_type") == "links")
    rows = rows.withColumn("_lack", F.max(F.coalesce(net & F.col("distance").isNull(), F.lit(False))).over(Window.partitionBy(*PLAN, "trip")))
    rows = rows.withColumn("_leg", F.concat_ws("\u0001", *PLAN, "elem_idx"))
    far = route_distance(rows.filter(net & F.col("_lack")).select("_leg", "links"), links, "_leg").withColumnRenamed("distance", "_far")
    return rows.join(far, "_leg", "left").withColumn("distance", F.when(net & F.col("_lack"), F.col("_far")).otherwise(F.col("distance"))).select(*elements.columns)


def trip_validity(elements: DataFrame, links: DataFrame, main: list[str], access_mode: str = "walk", transit: DataFrame | None = None) -> DataFrame:
    """``person, plan_idx, trip, valid``: whether a trip can be simulated as it is.

    All legs have one routing mode; distances are finite and not negative; legs of other than main modes have a travel time; network routes
    are connected and allowed; the links of consecutive legs meet; a trip by a main mode begins and ends with an access leg and has two
    interactions; with ``transit`` (``line, route, stops``), transit legs are served: access before egress on an existing route."""
    rows = with_trips(elements).withColumn("_leg", F.concat_ws("\u0001", *PLAN, "elem_idx"))
    inside = rows.filter("not is_main")
    legs = inside.filter("kind = 'leg'")
    net = legs.filter("route_type = 'links'")
    good = [connected(net.filter(F.col("mode") == m).select("_leg", "links"), links, "_leg", m) for m in main]
    others = connected(net.filter(~F.col("mode").isin(*main)).select("_leg", "links"), links, "_leg")
    routes = reduce(DataFrame.unionAll, [*good, others]).withColumnRenamed("valid", "_route")
    w = Window.partitionBy(*PLAN, "trip").orderBy("elem_idx")
    is_main = F.col("mode").isin(*main)
    legs = legs.join(routes, "_leg", "left").withColumns({"_i": F.row_number().over(w), "_before": F.lag("end_link").over(w), "_lastleg": F.lead("elem_idx").over(w).isNull()})
    fine = F.col("distance").isNotNull() & ~F.isnan("distance") & (F.col("distance") >= 0) & (F.col("distance") < float("inf"))
    ok = fine & (is_main | F.coalesce("trav_ns", "route_trav_ns").isNotNull()) & (F.col("_before").isNull() | F.col("_before").eqNullSafe(F.col("start_link"))) & F.when(F.col("route_type") == "links", F.coalesce("_route", F.lit(False))).otherwise(~is_main)
    if transit is not None:
        t = transit.select(F.col("line").alias("_l"), F.col("route").alias("_r"), "stops")
        legs = legs.join(t, (F.col("line") == F.col("_l")) & (F.col("route") == F.col("_r")), "left")
        a, e = F.array_position("stops", F.col("access_facility")), F.array_position("stops", F.col("egress_facility"))
        ok = ok & F.when(F.col("route_type") == "default_pt", F.coalesce((a > 0) & (e > a), F.lit(False))).otherwise(True)
    stops = inside.filter("kind = 'act'").groupBy(*PLAN, "trip").agg(F.count(F.lit(1)).alias("n_stops"))
    ends = ((F.col("_i") == 1) | F.col("_lastleg")) & (F.col("mode") != access_mode)
    per = legs.groupBy(*PLAN, "trip").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"), F.count_distinct(F.coalesce("routing_mode", F.lit(""))).alias("k"), F.max(is_main).alias("by_main"), F.max(F.coalesce(ends, F.lit(False))).alias("bare"))
    per = per.join(stops, [*PLAN, "trip"], "left")
    framed = ~F.col("by_main") | (~F.col("bare") & (F.coalesce("n_stops", F.lit(0)) >= 2))
    return per.select(*PLAN, "trip", (F.col("ok") & (F.col("k") == 1) & framed).alias("valid"))


def located_activities(elements: DataFrame, facilities: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Activities with link and place: those of the facility, else their own; the middle of the link where only that is known, the nearest
    link where only a place is. What stays without both is an issue (see ``issues``)."""
    f = facilities.select(F.col("id").alias("facility"), F.col("link").alias("_fl"), F.col("x").alias("_fx"), F.col("y").alias("_fy"))
    rows = elements.join(f, "facility", "left").withColumns({"link": F.coalesce("_fl", "link"), "x": F.coalesce("_fx", "x"), "y": F.coalesce("_fy", "y")}).drop("_fl", "_fx", "_fy")
    n = nodes.groupBy("id").agg(F.first("x").alias("nx"), F.first("y").alias("ny"))
    mid = links.groupBy("id").agg(F.first("from_node").alias("a"), F.first("to_node").alias("b")).join(n.toDF("a", "ax", "ay"), "a").join(n.toDF("b", "bx", "by"), "b").select(F.col("id").alias("link"), ((F.col("ax") + F.col("bx")) / 2).alias("_mx"), ((F.col("ay") + F.col("by")) / 2).alias("_my"))
    act = F.col("kind") == "act"
    rows = rows.join(mid, "link", "left").withColumns({"x": F.coalesce("x", F.when(act, F.col("_mx"))), "y": F.coalesce("y", F.when(act, F.col("_my")))}).drop("_mx", "_my")
    rows = rows.withColumn("_place", F.when(act & F.col("link").isNull() & F.col("x").isNotNull() & F.col("y").isNotNull(), F.concat_ws(",", "x", "y")))
    lost = rows.filter("_place is not null").select(F.col("_place").alias("id"), "x", "y").distinct()
    near = nearest_link(lost, links, nodes).select(F.col("id").alias("_place"), F.col("link").alias("_near"))
    return rows.join(near, "_place", "left").withColumn("link", F.coalesce("link", "_near")).select(*elements.columns)


def prepared_facilities(facilities: DataFrame, links: DataFrame, nodes: DataFrame, modes: list[str], base_first: bool = True) -> DataFrame:
    """``id, link, mode_links``: the base link, the nearest one where there is none, and a map with the link of each mode where it differs."""
    near = nearest_link(facilities.filter("link is null").select("id", "x", "y"), links, nodes).select("id", F.col("link").alias("_n"))
    rows = facilities.join(near, "id", "left").withColumn("link", F.coalesce("link", "_n")).drop("_n")
    out = rows.select("id", "link")
    for m in modes:
        out = out.join(modal_link(rows.select("id", "x", "y", "link"), links, nodes, m, base_first).withColumnRenamed("link", f"_{m}"), "id", "left")
    entries = F.array(*(F.when(F.col(f"_{m}").isNotNull() & ~F.col(f"_{m}").eqNullSafe(F.col("link")), F.struct(F.lit(m).alias("key"), F.col(f"_{m}").alias("value"))) for m in modes))
    return out.select("id", "link", F.map_from_entries(F.array_compact(entries)).alias("mode_links"))


def generated_vehicles(persons: DataFrame, modes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``vehicle, person, mode`` named ``<person>_<mode>`` for every person and mode (a small table ``mode``) that isn't there yet.

    More than MOST_MODES modes are an error, as every person gets a vehicle of each."""
    named = modes.select("mode").filter("mode is not null").distinct()
    if (n := named.count()) > MOST_MODES:
        raise ValueError(f"{n} modes are too many for vehicles of each person")
    kinds = "\u0001".join(sorted(r["mode"] for r in named.collect()))
    every = persons.select("person").distinct().filter(F.lit(n > 0)).select("person", F.explode(F.split(F.lit(kinds), "\u0001")).alias("mode"))
    every = every.select(F.concat_ws("_", "person", "mode").alias("vehicle"), "person", "mode")
    return every.join(existing.select("vehicle").distinct(), "vehicle", "left_anti") if existing is not None else every


def resolved_vehicles(elements: DataFrame, vehicles: DataFrame, main: list[str]) -> DataFrame:
    """Elements in which network legs have a vehicle, the one named or ``<person>_<mode>``, and ``vehicle_missing`` where it doesn't exist."""
    named = F.when((F.col("kind") == "leg") & F.col("mode").isin(*main), F.coalesce("vehicle", F.concat_ws("_", "person", "mode"))).otherwise(F.col("vehicle"))
    there = vehicles.select("vehicle").distinct().withColumn("_there", F.lit(True))
    return elements.withColumn("vehicle", named).join(there, "vehicle", "left").withColumn("vehicle_missing", F.col("vehicle").isNotNull() & F.col("_there").isNull()).drop("_there")


def adaptive_persons(elements: DataFrame, attribute: str = "preplanningHorizon") -> DataFrame:
    """Persons any of whose activities has the attribute (elements with an ``attributes`` map)."""
    return elements.groupBy("person").agg(F.bool_or(F.coalesce(F.map_contains_key("attributes", attribute), F.lit(False))).alias("adaptive"))


def issues(elements: DataFrame, facilities: DataFrame) -> DataFrame:
    """``person, plan_idx, elem_idx, message`` of what can't be prepared: unknown facilities, places without anything, trips without a departure."""
    unknown = elements.filter("facility is not null").join(facilities.select(F.col("id").alias("facility")), "facility", "left_anti").select(*PLAN, "elem_idx", F.lit("unknown facility").alias("message"))
    nowhere = elements.filter("kind = 'act' and facility is null and link is null and (x is null or y is null)").select(*PLAN, "elem_idx", F.lit("no place").alias("message"))
    timeless = departures(elements).filter("departure_ns is null").join(trip_spans(elements), [*PLAN, "trip"]).select(*PLAN, F.col("origin_idx").alias("elem_idx"), F.lit("no departure time").alias("message"))
    return unknown.unionAll(nowhere).unionAll(timeless)


def issue_report(found: DataFrame, most: int = 20) -> DataFrame:
    """``message, n, examples``: counts with the first few cases by person."""
    r = Window.partitionBy("message").orderBy("person", "plan_idx", "elem_idx")
    few = found.withColumn("_r", F.row_number().over(r)).filter(F.col("_r") <= most)
    counts = found.groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(few.groupBy("message").agg(F.array_sort(F.collect_list(F.struct("person", "plan_idx", "elem_idx"))).alias("examples")), "message")


def by_start_partition(elements: DataFrame, link_parts: DataFrame) -> DataFrame:
    """``person, partition_no``: that of the link of the first activity of the selected plan (rows of one plan per person)."""
    first = elements.filter("kind = 'act'").groupBy("person").agg(F.min_by("link", "elem_idx").alias("link"))
    return first.join(link_parts.select(F.col("id").alias("link"), "partition_no").distinct(), "link").select("person", "partition_no")


def teleport_schedule(elements: DataFrame, start_ns: int = 0, tick_ns: int = NS) -> DataFrame:
    """Departures and arrivals of plans with teleported legs only, without a simulation: ``person, plan_idx, elem_idx, dep_ns, arr_ns``.

    A leg departs at the end of the activity before it, or, where it arrives after that, a tick after its arrival; arrivals are the
    departure plus the travel time. The running maximum of slack gives the recursion in one window."""
    run = _plan().rowsBetween(Window.unboundedPreceding, 0)
    legs = elements.withColumn("_end", F.lag("end_ns").over(_plan())).filter("kind = 'leg'")
    step = F.coalesce("route_trav_ns", "trav_ns") + tick_ns
    legs = legs.withColumn("_step", step).withColumn("_before", F.sum("_step").over(run) - F.col("_step"))
    free = F.coalesce("_end", F.lit(start_ns).cast("long")) - F.col("_before")
    legs = legs.withColumn("dep_ns", F.max(free).over(run) + F.col("_before"))
    return legs.select(*PLAN, "elem_idx", "dep_ns", (F.col("dep_ns") + F.col("_step") - tick_ns).alias("arr_ns"))
