"""Transit schedules as tables: offsets, departures, vehicles and drivers per departure, delays along a departure, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUTE = ["line", "route"]
#: Time in which passengers of a stop are looked at together.
SLICE_NS = 15 * 60 * 10**9


def offsets(stops: DataFrame) -> DataFrame:
    """``route_stops`` with ``arr_off_ns, dep_off_ns``, each falling back to the other."""
    return stops.withColumns({"arr_off_ns": F.coalesce("arr_ns", "dep_ns"), "dep_off_ns": F.coalesce("dep_ns", "arr_ns")})


def end_links(stops: DataFrame, facilities: DataFrame) -> DataFrame:
    """``line, route, start_link, end_link``: the links of the first and the last stop."""
    rows = stops.join(facilities.select(F.col("id").alias("facility"), "link"), "facility", "left")
    return rows.groupBy(*ROUTE).agg(F.min_by("link", "pos").alias("start_link"), F.max_by("link", "pos").alias("end_link"))


def last_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of rows with one id the last in the file."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def sequences(departures: DataFrame) -> DataFrame:
    """Departures with ``sequence``, their place in their route by time and then id, from 0."""
    w = Window.partitionBy(*ROUTE).orderBy("dep_ns", "id")
    return departures.withColumn("sequence", F.row_number().over(w) - 1)


def own_vehicles(departures: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Departures with a vehicle of their own: one that serves several gets a copy ``<vehicle>_<line>_<route>_<departure>`` for every one.

    ``copied_from`` names the original; ``clash`` marks a copy whose name is taken."""
    n = F.count(F.lit(1)).over(Window.partitionBy("vehicle"))
    copy = F.concat_ws("_", "vehicle", *ROUTE, "id")
    rows = departures.withColumn("_n", n).withColumn("copied_from", F.when(F.col("_n") > 1, F.col("vehicle"))).withColumn("vehicle", F.when(F.col("_n") > 1, copy).otherwise(F.col("vehicle"))).drop("_n")
    if existing is None:
        return rows.withColumn("clash", F.lit(False))
    there = existing.select("vehicle").distinct().withColumn("_t", F.lit(True))
    return rows.join(there, "vehicle", "left").withColumn("clash", F.col("_t").isNotNull() & F.col("copied_from").isNotNull()).drop("_t")


def drivers(departures: DataFrame) -> DataFrame:
    """``driver, line, route, departure``: one driver ``pt_<line>_<route>_<departure>`` each."""
    return departures.select(F.concat_ws("_", F.lit("pt"), *ROUTE, "id").alias("driver"), *ROUTE, F.col("id").alias("departure"))


def timetable(departures: DataFrame, stops: DataFrame) -> DataFrame:
    """Every stop of every departure: ``line, route, departure, pos, facility, arr_ns, dep_ns``."""
    s = offsets(stops).select(*ROUTE, "pos", "facility", "arr_off_ns", "dep_off_ns")
    d = departures.select(*ROUTE, F.col("id").alias("departure"), F.col("dep_ns").alias("_at"))
    return d.join(s, ROUTE).select(*ROUTE, "departure", "pos", "facility", (F.col("_at") + F.col("arr_off_ns")).alias("arr_ns"), (F.col("_at") + F.col("dep_off_ns")).alias("dep_ns"))


def lindley(rows: DataFrame, keys: list[str], order: list[str], extra: Column, slack: Column, name: str = "delay") -> DataFrame:
    """``d_k = max(0, d_(k-1) + extra_k - slack_k)`` along each group, as a running sum less its running minimum (at most 0)."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum(extra - slack).over(run))
    return rows.withColumn(name, F.col("_s") - F.least(F.min("_s").over(run), F.lit(0))).drop("_s")


def delayed(table: DataFrame, extra: Column) -> DataFrame:
    """A timetable with ``delay_ns`` at departure when each stop adds ``extra`` and its scheduled halt can absorb delay."""
    halt = F.coalesce(F.col("dep_ns") - F.col("arr_ns"), F.lit(0))
    return lindley(table, [*ROUTE, "departure"], ["pos"], extra, halt, "delay_ns")


def boardings(waiting: DataFrame, calls: DataFrame) -> DataFrame:
    """The departure each waiting passenger takes: the first that calls at the stop at or after the time and later calls at the passenger's
    egress stop, of the line if one is named. waiting: ``agent, stop, egress, line, time_ns``; calls: a timetable.

    A call stands once for each later stop of its departure, so passengers and calls meet on stop, egress and line. Their times are cut into
    slices, so that a stop where everybody waits is spread: in a slice one sorted window runs from the last call to the first, and for whoever has
    no call left there the first call of the next slice that has one is looked up, by windows over slices instead of rows."""
    stops = F.array_sort(F.collect_list(F.struct("pos", "facility", "dep_ns")))
    trips = calls.groupBy(*ROUTE, "departure").agg(stops.alias("s"))  # bounded by the stops of a route
    at = trips.select(*ROUTE, "departure", F.posexplode("s").alias("i", "c"), "s").select(*ROUTE, "departure", "c", F.explode(F.array_distinct(F.transform(F.slice("s", F.col("i") + 2, F.size("s")), lambda x: x["facility"]))).alias("egress"))
    call = F.struct(F.col("c.dep_ns").alias("dep_ns"), *ROUTE, "departure")
    at = at.select(F.col("c.facility").alias("stop"), "egress", F.explode(F.array(F.col("line"), F.lit(None).cast("string"))).alias("key"), F.col("c.dep_ns").alias("t"), F.lit(1).alias("o"), F.lit(None).cast(waiting.schema["agent"].dataType).alias("agent"), call.alias("call"))
    who = waiting.select("stop", "egress", F.col("line").alias("key"), F.col("time_ns").alias("t"), F.lit(0).alias("o"), "agent", F.lit(None).cast(at.schema["call"].dataType).alias("call"))
    key, order = ["stop", "egress", "key"], ["t", "o", "call.line", "call.route", "call.departure"]
    slice_ = F.floor(F.col("t") / SLICE_NS).alias("slice")
    rows = who.unionByName(at).withColumn("slice", slice_)
    # backwards, as a frame that ends at the current row is not begun anew for each
    back = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    here = back(*key, "slice").orderBy(*(F.col(c).desc() for c in order))
    firsts = at.withColumn("slice", slice_).groupBy(*key, "slice").agg(F.min(F.struct("t", "call")).alias("f"))
    slices = firsts.unionByName(who.select(*key, slice_).distinct(), allowMissingColumns=True).groupBy(*key, "slice").agg(F.max("f").alias("f"))
    later = slices.select(*key, "slice", F.last("f.call", ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    found = rows.withColumn("b", F.last("call", ignorenulls=True).over(here)).filter("o = 0")
    none = found.filter("b is null").drop("b", "call").alias("w").join(later.filter("later is not null").alias("l"), F.expr(" and ".join(f"w.{c} <=> l.{c}" for c in (*key, "slice")))).select("w.agent", F.col("l.later").alias("b"))
    found = found.filter("b is not null").select("agent", "b").unionByName(none)
    return found.select("agent", F.col("b.line").alias("line"), F.col("b.route").alias("route"), F.col("b.departure").alias("departure"), F.col("b.dep_ns").alias("boarding_ns"))


def ride_distance(rides: DataFrame, routes: DataFrame, links: DataFrame) -> DataFrame:
    """``ride, distance`` between two stop links of a route: the lengths after the first occurrence of the access link up to and including the
    first occurrence of the egress link at or after it. rides: ``ride, line, route, access_link, egress_link``; routes: ``line, route, links``."""
    r = rides.join(routes.select(*ROUTE, "links"), ROUTE)
    a = F.array_position("links", F.col("access_link"))
    rest = F.slice("links", a + 1, F.size("links"))
    z = F.array_position(rest, F.col("egress_link"))
    part = F.when(F.col("access_link") == F.col("egress_link"), F.array().cast("array<string>")).when((a > 0) & (z > 0), F.slice(rest, F.lit(1), z))
    rows = r.select("ride", part.alias("p")).filter("p is not null")
    length = links.groupBy(F.col("id").alias("link")).agg(F.max("length_m").alias("length_m"))
    return rows.select("ride", F.explode_outer("p").alias("link")).join(length, "link", "left").groupBy("ride").agg(F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("distance"))


def schedule_errors(stops: DataFrame, facilities: DataFrame, departures: DataFrame, routes: DataFrame) -> DataFrame:
    """``kind, line, route, what`` of what a schedule mustn't have: unknown stops, stops without a link or off the route, times that go back,
    drivers that aren't unique."""
    f = facilities.select(F.col("id").alias("facility"), "link", F.lit(True).alias("_f"))
    s = offsets(stops).join(f, "facility", "left").join(routes.select(*ROUTE, "links"), ROUTE, "left")
    w = Window.partitionBy(*ROUTE).orderBy("pos")
    s = s.withColumn("_b", F.lag("dep_off_ns").over(w))
    kind = F.when(F.col("_f").isNull(), "unknown stop").when(F.col("link").isNull(), "stop without link").when(~F.coalesce(F.array_contains("links", F.col("link")), F.lit(False)), "stop off the route").when((F.col("arr_off_ns") < F.col("_b")) | (F.col("dep_off_ns") < F.col("arr_off_ns")), "time goes back")
    bad = s.select(kind.alias("kind"), *ROUTE, F.col("facility").alias("what")).filter("kind is not null")
    twice = drivers(departures).groupBy("driver").agg(F.count(F.lit(1)).alias("n"), F.first("line").alias("line"), F.first("route").alias("route")).filter("n > 1").select(F.lit("driver twice").alias("kind"), *ROUTE, F.col("driver").alias("what"))
    return bad.unionAll(twice)
