"""Making plans ready for a simulation: trips that can't be simulated as they are get routed anew and spliced into their plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloframe.functions.geometry import beeline_time_ns, projected
from veloframe.functions.times import NS, parse_time
from veloframe.operators import planops, routing
from veloframe.operators.network import with_ends
from veloframe.storage import materialize

PLAN = planops.PLAN
#: How legs that aren't simulated on the network travel, by default: beeline factor and speed (m/s).
TELEPORTED = {"walk": (1.3, 3 / 3.6)}

_KINDS = {"kind": "string", "act_type": "string", "link": "string", "facility": "string", "x": "double", "y": "double", "start_ns": "bigint", "end_ns": "bigint", "max_dur_ns": "bigint", "mode": "string", "routing_mode": "string", "dep_ns": "bigint", "trav_ns": "bigint", "route_type": "string", "start_link": "string", "end_link": "string", "route_trav_ns": "bigint", "distance": "double", "vehicle": "string", "links": "array<string>", "line": "string", "route": "string", "access_facility": "string", "egress_facility": "string", "boarding_ns": "bigint", "horizon_ns": "bigint"}
COLUMNS = [*PLAN, "elem_idx", *_KINDS]


def normal(elements: DataFrame) -> DataFrame:
    """Elements with exactly the columns of a plan, missing ones null; how long before its end an activity's agent looks for a route comes from its
    attributes."""
    if "horizon_ns" not in elements.columns and dict(elements.dtypes).get("attributes") == "map<string,string>":
        elements = elements.withColumn("horizon_ns", parse_time(F.try_element_at("attributes", F.lit("preplanningHorizon"))))
    have = set(elements.columns)
    return elements.select(*PLAN, F.col("elem_idx").cast("int").alias("elem_idx"), *((F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in _KINDS.items()))


def _element(pos: int, **given: Column) -> Column:
    return F.struct(F.lit(pos).alias("pos"), *((given[c] if c in given else F.lit(None)).cast(k).alias(c) for c, k in _KINDS.items()))


def trip_requests(elements: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """One row per trip: ``person, plan_idx, trip, origin_idx, destination_idx, main_mode, departure_ns`` and link and place of both ends;
    of ``trips`` only if given."""
    spans = planops.trip_spans(elements)
    if trips is not None:
        spans = spans.join(trips.select(*PLAN, "trip"), [*PLAN, "trip"], "left_semi")
    rows = spans.join(planops.main_modes(elements), [*PLAN, "trip"], "left").join(planops.departures(elements), [*PLAN, "trip"], "left")
    for side, at in (("o", "origin_idx"), ("d", "destination_idx")):
        end = elements.select(*PLAN, F.col("elem_idx").alias(at), F.col("link").alias(f"{side}_link"), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
        rows = rows.join(end, [*PLAN, at])
    return rows


def routed(requests: DataFrame, links: DataFrame, nodes: DataFrame, graph: routing.Graph, network_modes: list[str], teleported: dict[str, tuple[float, float]] = TELEPORTED, access: str = "walk", max_speed: float = float("inf"), observed: dict | None = None, bin_s: float = 900.0) -> DataFrame:
    """New elements between origin and destination of each request (``person, plan_idx, origin_idx, pos`` and element columns).

    Network modes: a walk to the nearest point of the origin's link, an interaction, the least-cost path, an interaction, a walk. Other modes: one
    leg along the beeline. Requests of unknown modes or without a path have no rows, see ``unrouted``."""
    ends = with_ends(links.select("id", "from_node", "to_node").dropDuplicates(["id"]), nodes).select("id", "x0", "y0", "x1", "y1")
    r = requests.filter(F.col("main_mode").isin(*network_modes))
    for s in "od":
        e = ends.select(F.col("id").alias(f"{s}_link"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
        r = r.join(e, f"{s}_link").withColumn(f"{s}_at", projected(F.col(f"{s}_x"), F.col(f"{s}_y"), *(F.col(f"_{c}") for c in ("x0", "y0", "x1", "y1")))).drop("_x0", "_y0", "_x1", "_y1")
    factor, speed = teleported[access]
    far = lambda s: F.sqrt((F.col(f"{s}_x") - F.col(f"{s}_at.x")) ** 2 + (F.col(f"{s}_y") - F.col(f"{s}_at.y")) ** 2)
    r = r.withColumns({"o_far": far("o"), "d_far": far("d")}).withColumns({"o_ns": beeline_time_ns(F.col("o_far"), factor, speed), "d_ns": beeline_time_ns(F.col("d_far"), factor, speed)})
    r = r.withColumn("request", F.concat_ws("\u0001", *PLAN, "origin_idx"))
    paths = routing.least_cost_paths(r.select("request", F.col("o_link").alias("from_link"), F.col("d_link").alias("to_link"), ((F.coalesce("departure_ns", F.lit(0)) + F.col("o_ns")) / NS).alias("dep_s")), graph, max_speed, observed=observed, bin_s=bin_s)
    r = r.join(paths.filter("links is not null"), "request")
    mode, walk, ns = F.col("main_mode"), F.lit(access), F.floor(F.col("travel_s") * NS).cast("long")
    stop = F.concat(mode, F.lit(" interaction"))
    car = F.concat_ws("_", "person", "main_mode")
    leg = lambda pos, s: _element(pos, kind=F.lit("leg"), mode=walk, routing_mode=mode, trav_ns=F.col(f"{s}_ns"), route_trav_ns=F.col(f"{s}_ns"), route_type=F.lit("generic"), start_link=F.col(f"{s}_link"), end_link=F.col(f"{s}_link"), distance=F.col(f"{s}_far") * factor)
    wait = lambda pos, s: _element(pos, kind=F.lit("act"), act_type=stop, link=F.col(f"{s}_link"), x=F.col(f"{s}_at.x"), y=F.col(f"{s}_at.y"), max_dur_ns=F.lit(0))
    drive = _element(2, kind=F.lit("leg"), mode=mode, routing_mode=mode, trav_ns=ns, route_trav_ns=ns, route_type=F.lit("links"), start_link=F.col("o_link"), end_link=F.col("d_link"), distance=F.col("distance_m"), vehicle=car, links=F.col("links"))
    driven = r.select(*PLAN, "origin_idx", F.explode(F.array(leg(0, "o"), wait(1, "o"), drive, wait(3, "d"), leg(4, "d"))).alias("e"))
    out = driven
    for m, (f, v) in teleported.items():
        t = requests.filter(F.col("main_mode") == m)
        d = F.sqrt((F.col("o_x") - F.col("d_x")) ** 2 + (F.col("o_y") - F.col("d_y")) ** 2)
        one = _element(0, kind=F.lit("leg"), mode=F.lit(m), routing_mode=F.lit(m), trav_ns=beeline_time_ns(d, f, v), route_trav_ns=beeline_time_ns(d, f, v), route_type=F.lit("generic"), start_link=F.col("o_link"), end_link=F.col("d_link"), distance=d * f)
        out = out.unionByName(t.select(*PLAN, "origin_idx", one.alias("e")))
    return out.select(*PLAN, "origin_idx", "e.*")


def unrouted(requests: DataFrame, new: DataFrame) -> DataFrame:
    """Requests that got no elements."""
    return requests.join(new.select(*PLAN, "origin_idx").distinct(), [*PLAN, "origin_idx"], "left_anti")


def prepared(elements: DataFrame, links: DataFrame, nodes: DataFrame, graph: routing.Graph, network_modes: list[str], teleported: dict[str, tuple[float, float]] = TELEPORTED, ignore: tuple[str, ...] = (), max_speed: float = float("inf"), observed: dict | None = None, bin_s: float = 900.0, transit: DataFrame | None = None) -> DataFrame:
    """Plans in which every trip that isn't valid, but for those of ignored modes, has been routed; travel times and distances are filled.

    Trips that can't be routed stay as they are. transit: ``line, route, stops`` by which transit legs are checked. max_speed, observed, bin_s: see ``routing.least_cost_paths``."""
    e = materialize(planops.filled_distances(planops.synchronised(normal(elements)), links), "elements")  # used five times below
    bad = planops.trip_validity(e, links, network_modes, transit=transit).filter("not valid")
    requests = trip_requests(e, materialize(bad, "invalid")).filter(~F.coalesce(F.col("main_mode").isin(*ignore), F.lit(False)) if ignore else F.lit(True))
    requests = materialize(requests, "requests")
    new = materialize(routed(requests, links, nodes, graph, network_modes, teleported, max_speed=max_speed, observed=observed, bin_s=bin_s), "routed")
    spans = requests.join(new.select(*PLAN, "origin_idx").distinct(), [*PLAN, "origin_idx"], "left_semi")
    return planops.spliced(e, spans, new)


def answered(responses: DataFrame, legs: str = "legs", activities: str = "activities") -> DataFrame:
    """``request, pos, kind, leg, activity`` of a router's answers: legs and the activities between them in turn. ``request`` rows whose
    activities aren't fewer than their legs are errors and come out with kind ``error``."""
    wrong = F.size(activities) >= F.greatest(F.size(legs), F.lit(1))
    pairs = F.arrays_zip(F.col(legs).alias("leg"), F.col(activities).alias("activity"))
    rows = responses.select("request", wrong.alias("_w"), F.posexplode_outer(pairs).alias("_i", "_p")).filter("not _w or coalesce(_i, 0) = 0")
    parts = F.array_compact(F.array(F.when(~F.col("_w") & F.col("_p.leg").isNotNull(), F.struct((F.col("_i") * 2).alias("pos"), F.lit("leg").alias("kind"))), F.when(~F.col("_w") & F.col("_p.activity").isNotNull(), F.struct((F.col("_i") * 2 + 1).alias("pos"), F.lit("act").alias("kind"))), F.when(F.col("_w"), F.struct(F.lit(0).alias("pos"), F.lit("error").alias("kind")))))
    out = rows.select("request", "_p", F.explode(parts).alias("e"))
    return out.select("request", "e.pos", "e.kind", F.when(F.col("e.kind") == "leg", F.col("_p.leg")).alias("leg"), F.when(F.col("e.kind") == "act", F.col("_p.activity")).alias("activity"))
