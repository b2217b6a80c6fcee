"""Experienced plans: the activities and legs that persons really had, rebuilt from an event log.

Everything is keyed: vehicle events reach the persons in the vehicle by a join on the vehicle within its occupancy, then activities and legs
are sessions of a person's events, cut by running counts in one window and folded by aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloframe.functions.times import minus
from veloframe.operators.network import route_distance
from veloframe.storage import materialize, shuffle_partitions

#: Events that are worth a task, while there are fewer tasks than partitions of a shuffle.
LEAST_EVENTS = 500_000


def occupancy(events: DataFrame) -> DataFrame:
    """``person, vehicle, enter_seq, leave_seq, enter_ns, leave_ns``: one row per ride; a ride that doesn't end has no leaving."""
    w = Window.partitionBy("person", "vehicle").orderBy("seq")
    rides = events.filter(F.col("type").isin("PersonEntersVehicle", "PersonLeavesVehicle")).withColumn("next", F.lead(F.struct("type", "seq", "time_ns")).over(w))
    left = F.when(F.col("next.type") == "PersonLeavesVehicle", F.col("next"))
    return rides.filter("type = 'PersonEntersVehicle'").select("person", "vehicle", F.col("seq").alias("enter_seq"), left["seq"].alias("leave_seq"), F.col("time_ns").alias("enter_ns"), left["time_ns"].alias("leave_ns"))


def occupied(rides: DataFrame, vehicle_events: DataFrame) -> DataFrame:
    """Vehicle events with the ``person`` of every ride they fall into. The equi-join on the vehicle bounds the range condition."""
    r = rides.select("person", F.col("vehicle").alias("_v"), "enter_seq", "leave_seq")
    e = vehicle_events.drop("person")
    return e.join(r, (e["vehicle"] == F.col("_v")) & (e["seq"] >= F.col("enter_seq")) & (F.col("leave_seq").isNull() | (e["seq"] <= F.col("leave_seq")))).drop("_v", "enter_seq", "leave_seq")


def last_stop(events: DataFrame) -> DataFrame:
    """Events of transit vehicles with the line, route and stop at which the vehicle is: each the last one seen of it."""
    w = Window.partitionBy("vehicle").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda kind, col: F.last(F.when(F.col("type") == kind, F.col(col)), ignorenulls=True).over(w)
    served = events.filter("type = 'TransitDriverStarts'").select("vehicle").distinct()
    rows = events.filter("vehicle is not null").join(served, "vehicle", "left_semi")
    return rows.withColumns({"at_line": at("TransitDriverStarts", "transit_line"), "at_route": at("TransitDriverStarts", "transit_route"), "at_driver": at("TransitDriverStarts", "driver"), "at_stop_now": at("VehicleArrivesAtFacility", "facility")})


def transit_rides(events: DataFrame) -> DataFrame:
    """``person, enter_seq, line, route, access_facility, egress_facility, boarding_time_ns`` of passengers, drivers left out."""
    at = last_stop(events).filter("type in ('PersonEntersVehicle', 'PersonLeavesVehicle') and person <> at_driver")
    w = Window.partitionBy("person", "vehicle").orderBy("seq")
    at = at.withColumn("_out", F.lead(F.struct("type", "at_stop_now")).over(w)).filter("type = 'PersonEntersVehicle'")
    return at.select("person", F.col("seq").alias("enter_seq"), F.col("at_line").alias("line"), F.col("at_route").alias("route"), F.col("at_stop_now").alias("access_facility"), F.when(F.col("_out.type") == "PersonLeavesVehicle", F.col("_out.at_stop_now")).alias("egress_facility"), F.col("time_ns").alias("boarding_time_ns"))


TRANSIT = ["TransitDriverStarts", "VehicleArrivesAtFacility", "PersonLeavesVehicle"]
PERSONAL = ["actstart", "actend", "departure", "arrival", "travelled", "travelled with pt", "PersonEntersVehicle", "stuckAndAbort"]
DRIVING = ["vehicle enters traffic", "entered link", "vehicle leaves traffic"]


def experienced_plans(events: DataFrame, links: DataFrame) -> DataFrame:
    """``person, elem_idx, kind`` with ``act_type, link, x, y, start_ns, end_ns`` of activities and ``mode, routing_mode, dep_ns, trav_ns, route_type,
    start_link, end_link, distance, vehicle, links, line, route, access_facility, egress_facility, boarding_ns`` of legs, and ``aborted``.

    A plan begins with an open activity that has no start; one that was never ended nor started is dropped. ``stuckAndAbort`` marks the open
    activity, or, between elements, the last one; a leg without an arrival is kept as aborted, with the links so far if it was driven. A leg
    is generic if it was teleported, a network route if a vehicle was entered, and a transit route if a transit vehicle was boarded or it
    travelled with pt. Drivers of transit vehicles have no plans. Events without a person, in vehicles nobody is in, or of other types are
    ignored. The order is that of ``seq``. The log, which is read several times and may be a simulation's, is written once first, as are the
    activities and legs before they are numbered. Fields that the log hasn't got are null."""
    needed = ["seq", "time_ns", "type", "person", "vehicle", "driver", "link", "facility", "x", "y", "act_type", "leg_mode", "routing_mode", "distance", "line", "route", "transit_line", "transit_route", "boarding_time_ns", "access_facility", "egress_facility", "relative_position"]
    events = materialize(events.filter(F.col("type").isin(*PERSONAL, *DRIVING, *TRANSIT)).select(*(c for c in needed if c in events.columns)), "log")
    events = events.withColumns({c: F.lit(None).cast("double" if c in ("x", "y", "distance", "relative_position") else "bigint" if c.endswith("_ns") else "string") for c in needed if c not in events.columns})
    drivers = events.filter("type = 'TransitDriverStarts'").select(F.col("driver").alias("person")).distinct()
    served = events.filter("type = 'TransitDriverStarts'").select("vehicle").distinct()
    cars = events.join(served, "vehicle", "left_anti")
    boarded = transit_rides(events)
    cols = ["person", "seq", "time_ns", "type", "link", "x", "y", "act_type", "leg_mode", "routing_mode", "distance", "vehicle", "line", "route", "boarding_time_ns", "access_facility", "egress_facility", "relative_position"]
    own = events.filter(F.col("type").isin(*PERSONAL) & F.col("person").isNotNull()).join(drivers, "person", "left_anti").select(*cols)
    driven = occupied(occupancy(cars), cars.filter(F.col("type").isin(*DRIVING))).select(*cols)
    rides = boarded.select("person", F.col("enter_seq").alias("_s"), F.lit(True).alias("boards"), *(F.col(c).alias(f"b_{c}") for c in ("line", "route", "access_facility", "egress_facility", "boarding_time_ns")))
    rows = own.unionByName(driven).join(rides.withColumnRenamed("person", "_p"), (F.col("person") == F.col("_p")) & (F.col("seq") == F.col("_s")), "left")
    rows = rows.repartition(min(shuffle_partitions(events.sparkSession), events.count() // LEAST_EVENTS + 1), "person")  # by their bytes Spark would take few tasks
    run = Window.partitionBy("person").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy("person").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda kind, w: F.coalesce(F.sum((F.col("type") == kind).cast("int")).over(w), F.lit(0))
    rows = rows.withColumns({"acts": count("actstart", run), "ends": count("actend", so_far), "deps": count("departure", run), "arrs": count("arrival", so_far)})
    in_leg, in_act = F.col("deps") > F.col("arrs"), F.col("acts") >= F.col("ends")
    pick = lambda kind, c: F.max(F.when(F.col("type") == kind, F.col(c)))
    stuck_in = F.when(in_act & ~in_leg, "act").when(~in_leg, "last")
    rows = rows.withColumn("stuck", F.when(F.col("type") == "stuckAndAbort", stuck_in))
    # activities: number 0 is the one that was open at the beginning
    act_no = F.when(F.col("type") == "actstart", F.col("acts")).when(F.col("type") == "actend", F.col("ends")).when(F.col("stuck") == "act", F.col("acts")).when(F.col("stuck") == "last", F.lit(-1))  # -1: the last element of the person is stuck
    on_act = F.col("type").isin("actstart", "actend")
    last_of = lambda c: F.max_by(F.when(on_act, F.col(c)), F.when(on_act, F.col("seq")))
    acts = rows.withColumn("no", act_no).filter("no is not null").groupBy("person", "no").agg(last_of("act_type").alias("act_type"), last_of("link").alias("link"), last_of("x").alias("x"), last_of("y").alias("y"), pick("actstart", "time_ns").alias("start_ns"), pick("actend", "time_ns").alias("end_ns"), F.min(F.when(on_act, F.col("seq"))).alias("at"), (F.count("stuck") > 0).alias("aborted"))
    acts = acts.filter("at is not null or no = -1").withColumn("kind", F.lit("act"))
    # legs
    leg_types = ["departure", "arrival", "travelled", "travelled with pt", "PersonEntersVehicle", *DRIVING]
    legs = rows.filter(F.col("type").isin(*leg_types) & (F.col("deps") > F.col("arrs"))).withColumn("no", F.col("deps"))
    entered = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "entered link", F.struct("seq", "link")))), lambda s: s["link"])
    car = (F.col("type") == "PersonEntersVehicle") & F.col("boards").isNull()
    b = lambda c: F.max(F.coalesce(F.col(f"b_{c}"), F.when(F.col("type") == "travelled with pt", F.col(c))))
    legs = legs.groupBy("person", "no").agg(
        pick("departure", "leg_mode").alias("mode"), pick("departure", "routing_mode").alias("routing_mode"), pick("departure", "time_ns").alias("dep_ns"), pick("arrival", "time_ns").alias("arr_ns"), pick("departure", "link").alias("start_link"), pick("arrival", "link").alias("end_link"),
        F.max(F.when(F.col("type").isin("travelled", "travelled with pt"), F.col("distance"))).alias("told"), F.max(F.when(car, F.col("vehicle"))).alias("vehicle"), F.max(F.col("boards")).alias("boards"), F.max(F.col("type") == "travelled with pt").alias("pt"), F.max(F.col("type") == "travelled").alias("tele"),
        entered.alias("entered"), pick("vehicle enters traffic", "relative_position").alias("from_position"), pick("vehicle leaves traffic", "relative_position").alias("to_position"), b("line").alias("line"), b("route").alias("route"), b("access_facility").alias("access_facility"), b("egress_facility").alias("egress_facility"), b("boarding_time_ns").alias("boarding_ns"), F.min("seq").alias("at"),
    )
    kind = F.when(F.col("boards") | F.col("pt"), "default_pt").when(F.col("vehicle").isNotNull(), "links").when(F.col("tele"), "generic")
    front = F.when(F.get("entered", F.lit(0)).eqNullSafe(F.col("start_link")), F.col("entered")).otherwise(F.concat(F.array("start_link"), "entered"))
    whole = F.when(F.col("end_link").isNull() | F.element_at(front, -1).eqNullSafe(F.col("end_link")), front).otherwise(F.concat(front, F.array("end_link")))
    legs = legs.withColumn("route_type", kind).withColumn("links", F.when(F.col("route_type") == "links", whole)).withColumn("kind", F.lit("leg")).drop("boards", "pt", "tele", "entered")
    parts = materialize(acts.unionByName(legs, allowMissingColumns=True).withColumn("_leg", F.concat_ws("\u0001", "person", "no", F.when(F.col("kind") == "act", "act"))), "parts")
    driven_far = route_distance(parts.filter("links is not null and arr_ns is not null").select("_leg", "links", F.coalesce("from_position", F.lit(1.0)).alias("fp"), F.coalesce("to_position", F.lit(1.0)).alias("tp")), links, "_leg", F.col("fp"), F.col("tp"))
    is_leg = F.col("kind") == "leg"
    both = parts.filter("no <> -1").join(driven_far.withColumnRenamed("distance", "driven"), "_leg", "left")
    both = both.withColumns({"distance": F.when(F.col("route_type") == "links", F.col("driven")).otherwise(F.col("told")), "trav_ns": F.when(is_leg, minus(F.col("arr_ns"), F.col("dep_ns"))), "aborted": F.when(is_leg, F.col("arr_ns").isNull()).otherwise(F.col("aborted"))})
    order = Window.partitionBy("person").orderBy("at")
    marked = parts.filter("no = -1").select("person").distinct().withColumn("_stuck", F.lit(True))
    both = both.withColumn("elem_idx", (F.row_number().over(order) - 1).cast("int")).join(marked, "person", "left")
    is_last = F.col("elem_idx") == F.max("elem_idx").over(Window.partitionBy("person"))
    both = both.withColumn("aborted", F.col("aborted") | F.coalesce(F.col("_stuck") & is_last, F.lit(False)))
    return both.select("person", "elem_idx", "kind", "act_type", "link", "x", "y", "start_ns", "end_ns", "mode", "routing_mode", "dep_ns", "trav_ns", "route_type", "start_link", "end_link", "distance", "vehicle", "links", "line", "route", "access_facility", "egress_facility", "boarding_ns", "aborted")
