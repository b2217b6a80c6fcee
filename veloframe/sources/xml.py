"""Scans of scenario files in XML (plain, .gz or .zst) into flat tables.

Flat elements go through Spark's own splitting XML source with a schema. Persons are read as text split at their closing tag, which keeps large
files splittable, and parsed a batch at a time, because the order of activities and legs must survive."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veloframe.functions import attributes as at
from veloframe.functions.times import parse_time
from veloframe.operators.events import COLUMNS, KINDS
from veloframe.storage import parameters

_ATTRS = "attributes struct<attribute:array<struct<_name:string,_class:string,_VALUE:string>>>"


def scan(spark: SparkSession, path: str | list[str], tag: str, schema: str) -> DataFrame:
    """Rows of one element with ``seq``, its place in its file, and ``file``. Attributes have a leading underscore."""
    df = spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select("*", (F.col("_metadata.file_block_start") * 1024 + local).alias("seq"), F.col("_metadata.file_path").alias("file"))


def attribute_map(entries: Column) -> Column:
    """Attributes by name as text; those of unknown classes are skipped, the last of a repeated name counts."""
    known = [*at.CLASSES]
    keep = F.filter(entries, lambda a: a["_class"].isin(*known) | a["_class"].endswith("." + at.MAP_CLASSES[0]) | a["_class"].endswith("." + at.MAP_CLASSES[1]))
    last = F.aggregate(keep, F.expr("cast(map() as map<string,string>)"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, _: k != a["_name"]), F.create_map(a["_name"], a["_VALUE"])))
    return F.coalesce(last, F.expr("cast(map() as map<string,string>)"))


def network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, float]:
    """``nodes(id, x, y, partition_no, weight, seq)``, ``links(id, from_node, to_node, length_m, capacity, freespeed, permlanes, modes,
    attributes, partition_no, seq)`` and the effective cell size (7.5 by default). A node's partition is 0 and its weight 1 by default."""
    n = scan(spark, path, "node", f"_id string, _x double, _y double, {_ATTRS}").withColumn("a", attribute_map(F.col("attributes.attribute")))
    nodes = n.select(F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"), at.with_default(F.col("a"), "partition", "int", 0).alias("partition_no"), at.with_default(F.col("a"), "cmp_weight", "int", 1).alias("weight"), "seq")
    l = scan(spark, path, "link", f"_id string, _from string, _to string, _length double, _capacity double, _freespeed double, _permlanes double, _modes string, {_ATTRS}").withColumn("a", attribute_map(F.col("attributes.attribute")))  # noqa: E741
    links = l.select(F.col("_id").alias("id"), F.col("_from").alias("from_node"), F.col("_to").alias("to_node"), F.col("_length").alias("length_m"), F.col("_capacity").alias("capacity"), F.col("_freespeed").alias("freespeed"), F.col("_permlanes").alias("permlanes"), at.modes(F.coalesce("_modes", F.lit(""))).alias("modes"), F.col("a").alias("attributes"), at.with_default(F.col("a"), "partition", "int", 0).alias("partition_no"), "seq")
    head = spark.read.format("xml").option("rowTag", "links").schema("_effectivecellsize double").load(path).agg(F.max("_effectivecellsize")).first()[0]
    return nodes, links, head if head is not None else 7.5


ELEMENTS = """person string, plan_idx int, selected boolean, score double, elem_idx int, kind string, act_type string, link string, facility string, x double, y double, start_text string, end_text string, max_dur_text string,
mode string, routing_mode string, dep_text string, trav_text string, route_type string, start_link string, end_link string, route_trav_text string, distance double, vehicle string, route_text string, attributes string, person_attributes string, plan_attributes string"""


def _attrs(e: ET.Element | None) -> dict[str, str]:
    box = e.find("attributes") if e is not None else None
    return {a.get("name"): a.text or "" for a in box} if box is not None else {}


def _number(v: str | None) -> float | None:
    try:
        return float(v) if v not in (None, "", "undefined", "null") else None
    except ValueError:
        return None


def person_rows(text: str) -> list[dict]:
    """The element rows of one ``<person>``; a person without plans gives one row without an element."""
    p = ET.fromstring(text)
    who, pa = p.get("id"), json.dumps(_attrs(p))
    rows = []
    for i, plan in enumerate(p.iter("plan")):
        head = {"person": who, "plan_idx": i, "selected": plan.get("selected") == "yes", "score": _number(plan.get("score")), "person_attributes": pa, "plan_attributes": json.dumps(_attrs(plan))}
        k = 0
        for e in plan:
            r = dict(head, elem_idx=k, attributes=json.dumps(_attrs(e)))
            if e.tag in ("activity", "act"):
                r |= {"kind": "act", "act_type": e.get("type"), "link": e.get("link"), "facility": e.get("facility"), "x": _number(e.get("x")), "y": _number(e.get("y")), "start_text": e.get("start_time"), "end_text": e.get("end_time"), "max_dur_text": e.get("max_dur")}
            elif e.tag == "leg":
                own, route = _attrs(e), e.find("route")
                r |= {"kind": "leg", "mode": e.get("mode"), "routing_mode": own.get("routingMode"), "dep_text": e.get("dep_time"), "trav_text": e.get("trav_time")}
                if route is not None:
                    r |= {"route_type": route.get("type"), "start_link": route.get("start_link"), "end_link": route.get("end_link"), "route_trav_text": route.get("trav_time"), "distance": _number(route.get("distance")), "vehicle": route.get("vehicleRefId"), "route_text": route.text}
            else:
                continue
            rows.append(r)
            k += 1
    return rows or [{"person": who, "person_attributes": pa}]


def population(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Element rows of all plans, as the plan operators take them, with ``selected, score`` of the plan, ``seq`` of the person, and attributes as
    maps. Missing and ``undefined`` times are null; routes of links are arrays, transit routes are parsed from their JSON."""
    raw = spark.read.option("lineSep", "</person>").text(path)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = raw.select("value", (F.col("_metadata.file_block_start") * 1024 + local).alias("seq")).filter(F.col("value").contains("<person"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ELEMENTS.replace("\n", " ").split(","))] + [("seq", pa.int64())])
        for b in batches:
            out = []
            for v, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [dict(r, seq=s) for r in person_rows(v[v.rfind("<person ") :] + "</person>")]
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = raw.mapInArrow(run, ELEMENTS + ", seq long")
    json_map = lambda c: F.from_json(c, "map<string,string>")
    net = F.when(F.col("route_type") == "links", at.route_links(F.col("route_text")))
    pt = F.when(F.col("route_type") == "default_pt", at.pt_route(F.col("route_text")))
    rows = rows.withColumns({"start_ns": parse_time(F.col("start_text")), "end_ns": parse_time(F.col("end_text")), "max_dur_ns": parse_time(F.col("max_dur_text")), "dep_ns": parse_time(F.col("dep_text")), "trav_ns": parse_time(F.col("trav_text")), "route_trav_ns": parse_time(F.col("route_trav_text")), "vehicle": at.reference(F.col("vehicle")), "links": net, "_pt": pt, "attributes": json_map("attributes"), "person_attributes": json_map("person_attributes"), "plan_attributes": json_map("plan_attributes")})
    rows = rows.withColumns({"line": F.col("_pt.transitLineId"), "route": F.col("_pt.transitRouteId"), "access_facility": F.col("_pt.accessFacilityId"), "egress_facility": F.col("_pt.egressFacilityId"), "boarding_ns": parse_time(F.col("_pt.boardingTime"))})
    return rows.drop("start_text", "end_text", "max_dur_text", "dep_text", "trav_text", "route_trav_text", "route_text", "_pt")


def persons(elements: DataFrame) -> DataFrame:
    """``person, subpopulation, attributes``; a missing subpopulation is ``person``."""
    rows = elements.groupBy("person").agg(F.first("person_attributes").alias("attributes"))
    return rows.select("person", F.coalesce(F.try_element_at("attributes", F.lit("subpopulation")), F.lit("person")).alias("subpopulation"), "attributes")


def vehicles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``types(id, length, width, max_v, pce, fef, net_mode)`` and ``vehicles(vehicle, type, max_v, pce)``."""
    num = lambda name: f"{name[0]} struct<_{name[1]}:double>"
    t = scan(spark, path, "vehicleType", "_id string, " + ", ".join(map(num, (("length", "meter"), ("width", "meter"), ("maximumVelocity", "meterPerSecond"), ("passengerCarEquivalents", "pce"), ("flowEfficiencyFactor", "factor")))) + ", networkMode struct<_networkMode:string>")
    types = t.select(F.col("_id").alias("id"), F.coalesce("length._meter", F.lit(7.5)).alias("length"), F.coalesce("width._meter", F.lit(1.0)).alias("width"), F.coalesce("maximumVelocity._meterPerSecond", F.lit(float("inf"))).alias("max_v"), F.coalesce("passengerCarEquivalents._pce", F.lit(1.0)).alias("pce"), F.coalesce("flowEfficiencyFactor._factor", F.lit(1.0)).alias("fef"), F.coalesce("networkMode._networkMode", F.lit("car")).alias("net_mode"))
    v = scan(spark, path, "vehicle", "_id string, _type string").select(F.col("_id").alias("vehicle"), F.col("_type").alias("type"))
    return types, v.join(parameters(types.select(F.col("id").alias("type"), "max_v", "pce")), "type").select("vehicle", "type", "max_v", "pce")


def facilities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``facilities(id, x, y, link, descr)``, ``options(facility, act_type, capacity)`` and ``opening(facility, act_type, open_day, start_ns,
    end_ns)``. Repeated ids are an error."""
    act = "activity array<struct<_type:string,capacity:struct<_value:double>,opentime:array<struct<_day:string,_start_time:string,_end_time:string>>>>"
    f = scan(spark, path, "facility", f"_id string, _x double, _y double, _linkId string, _desc string, {act}")
    twice = f.groupBy("_id").count().filter("count > 1").select("_id").limit(5).collect()
    if twice:
        raise ValueError(f"repeated facilities: {[r[0] for r in twice]}")
    one = f.select(F.col("_id").alias("facility"), F.explode("activity").alias("a"))
    opening = one.select("facility", F.col("a._type").alias("act_type"), F.explode("a.opentime").alias("o"))
    return f.select(F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_linkId").alias("link"), F.col("_desc").alias("descr")), one.select("facility", F.col("a._type").alias("act_type"), F.col("a.capacity._value").alias("capacity")), opening.select("facility", "act_type", F.coalesce("o._day", F.lit("wk")).alias("open_day"), parse_time(F.col("o._start_time")).alias("start_ns"), parse_time(F.col("o._end_time")).alias("end_ns"))


def transit(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``stop_facilities, routes(line, route, mode, links), route_stops, departures, transfers`` of a schedule; of repeated ids the last counts."""
    from veloframe.operators.transit import last_wins

    s = scan(spark, path, "stopFacility", "_id string, _x double, _y double, _z double, _linkRefId string, _name string, _stopAreaId string, _isBlocking boolean")
    stops = last_wins(s.select(F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"), F.col("_linkRefId").alias("link"), F.col("_name").alias("name"), "seq"), ["id"]).drop("seq")
    route = "transitRoute array<struct<_id:string,transportMode:string,routeProfile:struct<stop:array<struct<_refId:string,_arrivalOffset:string,_departureOffset:string,_awaitDeparture:boolean,_allowBoarding:boolean,_allowAlighting:boolean,_minimumStopDuration:string>>>,route:struct<link:array<struct<_refId:string>>>,departures:struct<departure:array<struct<_id:string,_departureTime:string,_vehicleRefId:string>>>>>"
    t = scan(spark, path, "transitLine", f"_id string, _name string, {route}").select(F.col("_id").alias("line"), "seq", F.posexplode("transitRoute").alias("p", "r"))
    t = t.select("line", F.col("r._id").alias("route"), "r", F.struct("seq", "p").alias("o"))
    t = t.groupBy("line", "route").agg(F.max_by("r", "o").alias("r"))
    stop_rows = t.select("line", "route", F.posexplode("r.routeProfile.stop").alias("pos", "s"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    return {
        "stop_facilities": stops,
        "routes": t.select("line", "route", F.col("r.transportMode").alias("mode"), F.transform("r.route.link", lambda x: x["_refId"]).alias("links")),
        "route_stops": stop_rows.select("line", "route", "pos", F.col("s._refId").alias("facility"), parse_time(F.col("s._arrivalOffset")).alias("arr_ns"), parse_time(F.col("s._departureOffset")).alias("dep_ns"), F.col("s._awaitDeparture").alias("await"), yes("s._allowBoarding").alias("allow_boarding"), yes("s._allowAlighting").alias("allow_alighting"), F.coalesce(parse_time(F.col("s._minimumStopDuration")), F.lit(0)).alias("min_stop_ns")),
        "departures": t.select("line", "route", F.explode("r.departures.departure").alias("d")).select("line", "route", F.col("d._id").alias("id"), parse_time(F.col("d._departureTime")).alias("dep_ns"), F.col("d._vehicleRefId").alias("vehicle")),
        "transfers": scan(spark, path, "relation", "_fromStop string, _toStop string, _transferTime double").select(F.col("_fromStop").alias("from_stop"), F.col("_toStop").alias("to_stop"), F.col("_transferTime").alias("seconds")),
    }


#: Attributes of event elements and the columns they fill.
EVENT_ATTRIBUTES = {"person": "person", "link": "link", "vehicle": "vehicle", "x": "x", "y": "y", "actType": "act_type", "legMode": "leg_mode", "computationalRoutingMode": "routing_mode", "networkMode": "network_mode", "relativePosition": "relative_position", "distance": "distance", "mode": "mode", "line": "line", "route": "route", "boardingTime": "boarding_time_ns", "accessFacility": "access_facility", "egressFacility": "egress_facility", "driverId": "driver", "vehicleId": "vehicle", "transitLineId": "transit_line", "transitRouteId": "transit_route", "departureId": "departure", "facility": "facility", "delay": "delay", "agent": "agent", "atStop": "at_stop", "destinationStop": "destination_stop", "reason": "reason"}


def events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of one or more files as a log with the columns of all types, ``seq`` and ``file``. A missing delay of a stop event is 0."""
    df = scan(spark, path, "event", "_time string, _type string, " + ", ".join(f"_{a} string" for a in EVENT_ATTRIBUTES))
    out: dict[str, Column] = {}
    for a, c in EVENT_ATTRIBUTES.items():
        v = parse_time(F.col(f"_{a}")) if c == "boarding_time_ns" else F.col(f"_{a}").cast(KINDS.get(c, "string"))
        out[c] = F.coalesce(out[c], v) if c in out else v
    stop = F.col("_type").isin("VehicleArrivesAtFacility", "VehicleDepartsAtFacility")
    out["delay"] = F.when(stop, F.coalesce(out["delay"], F.lit(0.0))).otherwise(out["delay"])
    out["agent"] = F.when(F.col("_type") == "waitingForPt", F.coalesce(out["agent"], out["person"]))
    out["person"] = F.when(F.col("_type") != "waitingForPt", out["person"])
    return df.select(parse_time(F.col("_time")).alias("time_ns"), "seq", F.col("_type").alias("type"), *(out[c].alias(c) for c in COLUMNS), "file")
