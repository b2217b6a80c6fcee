"""Utility scores of experienced plans: activities, legs and aborted plans, from plan-element rows.

Elements: ``person, elem_idx, kind`` (act or leg) and, for activities, ``act_type, start_ns, end_ns``; for legs ``mode, dep_ns, trav_ns,
distance, route_type, boarding_ns``; ``aborted``. Parameters are small tables per subpopulation; a null subpopulation is the default set, which
holds for persons whose subpopulation has no set of its own, as a whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloframe.functions.attributes import is_interaction
from veloframe.functions.geometry import distance_factor, time_factor
from veloframe.functions.times import NS
from veloframe.storage import parameters

DAY_S = 86_400.0


@dataclass(frozen=True)
class Parameters:
    """sets: ``subpopulation, performing, waiting, money, aborted, waiting_pt, line_switch`` (utilities per hour; a null waiting_pt: that of
    travelling by pt); activities: ``subpopulation, act_type, typical_s, scored, open_s, close_s``; modes: ``subpopulation, mode, travelling_h,
    distance_m, money_rate_m, daily_money, daily_utility, constant``."""

    sets: DataFrame
    activities: DataFrame
    modes: DataFrame

    def errors(self) -> list[str]:
        """What can't be used: several sets of a subpopulation, repeated activity types or modes, opening after closing."""
        out = []
        for df, keys in ((self.sets, ["subpopulation"]), (self.activities, ["subpopulation", "act_type"]), (self.modes, ["subpopulation", "mode"])):
            out += [f"repeated: {tuple(r)[:-1]}" for r in df.groupBy(*keys).count().filter("count > 1").collect()]
        out += [f"opens after it closes: {r.act_type}" for r in self.activities.filter("open_s > close_s").collect()]
        return out


def least_cost_factors(p: Parameters) -> DataFrame:
    """``mode, per_second, per_metre``: the least of each cost factor over all parameter sets, a lower bound of what any person pays."""
    s = p.sets.select(F.col("subpopulation").alias("_s"), "performing", "money")
    rows = p.modes.join(parameters(s), F.col("subpopulation").eqNullSafe(F.col("_s")))
    return rows.groupBy("mode").agg(F.min(time_factor(F.col("travelling_h"), F.col("performing"))).alias("per_second"), F.min(distance_factor(F.col("distance_m"), F.col("money_rate_m"), F.col("money"))).alias("per_metre"))


def activity_utility(duration_s: Column, typical_s: Column, performing_s: Column) -> Column:
    """Logarithmic from the zero-utility duration typical/e on, linear with the slope at that point below it."""
    zero = typical_s * F.exp(F.lit(-1.0))
    above = performing_s * typical_s * (F.ln(duration_s / typical_s) + 1)
    return F.when(duration_s >= zero, above).otherwise(-(performing_s * typical_s / zero) * (zero - duration_s))


def opened(arrival: Column, departure: Column, opens: Column, closes: Column) -> tuple[Column, Column]:
    """Duration performed and time waited when an activity is only performed while it is open."""
    start = F.when(opens.isNotNull() & (arrival < opens), opens).otherwise(arrival)
    end = F.when(closes.isNotNull() & (closes < departure), closes).otherwise(departure)
    apart = opens.isNotNull() & closes.isNotNull() & ((opens > departure) | (closes < arrival))
    start, end = F.when(apart, departure).otherwise(start), F.when(apart, departure).otherwise(end)
    return end - start, F.greatest(start - arrival, F.lit(0.0)) + F.greatest(departure - end, F.lit(0.0))


def set_or_default(persons: DataFrame, sets: DataFrame) -> DataFrame:
    """``persons`` with ``_set``: their subpopulation if it has a set, else the default (null), and ``_known``, false where there is neither."""
    names = sets.select(F.col("subpopulation").alias("_n")).distinct()
    own = persons.join(parameters(names.filter("_n is not null")), F.col("subpopulation") == F.col("_n"), "left").withColumnRenamed("_n", "_set")
    default = bool(names.filter("_n is null").take(1))
    return own.withColumn("_known", F.col("_set").isNotNull() | F.lit(default))


def intervals(elements: DataFrame) -> DataFrame:
    """``person, elem_idx, act_type, arrival_s, departure_s``: what is scored of the main activities of each plan.

    Aborted plans: completed activities only. One activity: the whole day. First and last of one type: from the start of the last to the end
    of the first on the next day, with the first's parameters; else the first from 0 h and the last to 24 h. A needed time that is missing is
    null in the result."""
    acts = elements.filter((F.col("kind") == "act") & ~is_interaction(F.col("act_type")))
    w = Window.partitionBy("person")
    by = w.orderBy("elem_idx")
    flags = elements.groupBy("person").agg(F.max(F.coalesce("aborted", F.lit(False))).alias("plan_aborted"))
    r = acts.withColumns({"i": F.row_number().over(by), "n": F.count(F.lit(1)).over(w), "s": F.col("start_ns") / NS, "e": F.col("end_ns") / NS})
    last = w.orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = r.withColumns({"last_type": F.last("act_type").over(last), "last_s": F.last("s").over(last), "first_type": F.first("act_type").over(last)}).join(flags, "person")
    one, is_first, is_last = F.col("n") == 1, F.col("i") == 1, F.col("i") == F.col("n")
    same = F.col("first_type") == F.col("last_type")
    aborted = F.col("plan_aborted")
    arrival = F.when(aborted, F.coalesce("s", F.lit(0.0))).when(one, 0.0).when(is_first & same, F.col("last_s")).when(is_first, 0.0).otherwise(F.col("s"))
    departure = F.when(aborted, F.col("e")).when(one, DAY_S).when(is_first & same, F.col("e") + DAY_S).when(is_last, DAY_S).otherwise(F.col("e"))
    keep = F.when(aborted, F.col("e").isNotNull()).otherwise(~(is_last & same & ~one))
    return r.filter(keep).select("person", "elem_idx", "act_type", arrival.alias("arrival_s"), departure.alias("departure_s"))


def activity_scores(elements: DataFrame, persons: DataFrame, p: Parameters) -> DataFrame:
    """``person, part, score``: one row per scored interval; a null score could not be computed (no parameters, a missing time)."""
    rows = intervals(elements).join(persons.select("person", "_set"), "person")
    a = p.activities.select(F.col("subpopulation").alias("_as"), F.col("act_type").alias("_at"), "typical_s", "scored", "open_s", "close_s")
    s = p.sets.select(F.col("subpopulation").alias("_ss"), "performing", "waiting")
    rows = rows.join(parameters(a), F.col("_set").eqNullSafe(F.col("_as")) & (F.col("act_type") == F.col("_at")), "left").join(parameters(s), F.col("_set").eqNullSafe(F.col("_ss")), "left")
    duration, waited = opened(F.col("arrival_s"), F.col("departure_s"), F.col("open_s"), F.col("close_s"))
    score = activity_utility(duration, F.col("typical_s"), F.col("performing") / 3600) + F.when(waited > 0, F.col("waiting") / 3600 * waited).otherwise(0.0)
    return rows.select("person", F.lit("activity").alias("part"), F.when(~F.col("scored"), 0.0).otherwise(score).alias("score"))


def trips(elements: DataFrame) -> DataFrame:
    """Legs with the number of their trip, a trip being what lies between two main activities."""
    w = Window.partitionBy("person").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, 0)
    main = ((F.col("kind") == "act") & ~is_interaction(F.col("act_type"))).cast("int")
    return elements.withColumn("trip", F.sum(main).over(w)).filter("kind = 'leg'")


def leg_scores(elements: DataFrame, persons: DataFrame, p: Parameters, passenger_modes: list[str]) -> DataFrame:
    """``person, part, score`` per leg: travel time, distance, money, waiting for transit, constants once a trip, daily constants once a plan,
    and the line switch of each transit leg of a trip after its first."""
    legs = trips(elements).join(persons.select("person", "_set"), "person")
    by = Window.partitionBy("person", "trip", "mode").orderBy("elem_idx")
    day = Window.partitionBy("person", "mode").orderBy("elem_idx")
    run = Window.partitionBy("person", "trip").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, 0)
    transit = F.col("mode").isin(*passenger_modes) if passenger_modes else F.lit(False)
    legs = legs.withColumns({"_in_trip": F.row_number().over(by), "_in_day": F.row_number().over(day), "_transit": F.sum(transit.cast("int")).over(run)})
    m = p.modes.select(F.col("subpopulation").alias("_ms"), F.col("mode").alias("_mm"), "travelling_h", "distance_m", "money_rate_m", "daily_money", "daily_utility", "constant")
    pt = m.filter("_mm = 'pt'").select(F.col("_ms").alias("_ps"), F.col("travelling_h").alias("pt_travelling_h"))
    s = p.sets.select(F.col("subpopulation").alias("_ss"), "money", "waiting_pt", "line_switch")
    rows = legs.join(parameters(m), F.col("_set").eqNullSafe(F.col("_ms")) & (F.col("mode") == F.col("_mm")), "left").join(parameters(pt), F.col("_set").eqNullSafe(F.col("_ps")), "left").join(parameters(s), F.col("_set").eqNullSafe(F.col("_ss")), "left")
    trav = F.col("travelling_h") / 3600
    far = F.when((F.col("distance_m") != 0) | (F.col("money_rate_m") != 0), F.col("distance") * F.col("distance_m") + F.col("distance") * F.col("money_rate_m") * F.col("money")).otherwise(0.0)
    wait = F.when(F.col("route_type") == "default_pt", (F.col("boarding_ns") - F.col("dep_ns")) / NS * (F.coalesce("waiting_pt", "pt_travelling_h") / 3600 - trav)).otherwise(0.0)
    once = F.when(F.col("_in_trip") == 1, F.col("constant")).otherwise(0.0) + F.when(F.col("_in_day") == 1, F.col("daily_utility") + F.col("daily_money") * F.col("money")).otherwise(0.0)
    switch = F.when(transit & (F.col("_transit") > 1), F.col("line_switch")).otherwise(0.0)
    return rows.select("person", F.lit("leg").alias("part"), (F.col("trav_ns") / NS * trav + far + wait + once + switch).alias("score"))


def scores(elements: DataFrame, persons: DataFrame, p: Parameters, passenger_modes: list[str], simulation_end_ns: int) -> DataFrame:
    """``person, score``: activities, legs and, for aborted plans, the end of the simulation in hours times the aborted parameter.

    A person whose score can't be computed (no parameters, a missing time or distance) has a null score; persons without elements score 0."""
    known = set_or_default(persons.select("person", "subpopulation"), p.sets)
    parts = activity_scores(elements, known, p).unionByName(leg_scores(elements, known, p, passenger_modes))
    s = p.sets.select(F.col("subpopulation").alias("_ss"), "aborted")
    stuck = elements.filter("aborted").select("person").distinct().join(known, "person").join(parameters(s.withColumnRenamed("aborted", "_a")), F.col("_set").eqNullSafe(F.col("_ss")), "left")
    parts = parts.unionByName(stuck.select("person", F.lit("aborted").alias("part"), (F.lit(simulation_end_ns / NS / 3600) * F.col("_a")).alias("score")))
    total = parts.groupBy("person").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"), F.count("score").alias("k"))
    rows = known.join(total, "person", "left")
    return rows.select("person", F.when(F.col("n").isNull(), 0.0).when(F.col("_known") & (F.col("n") == F.col("k")), F.col("s")).alias("score"))


def travel_time_scores(elements: DataFrame) -> DataFrame:
    """The scorer that only knows travel time: elapsed time of each trip, waits between its legs included, in
    negative seconds.

    A departure before the arrival of the leg before makes the score null."""
    w = Window.partitionBy("person", "trip").orderBy("elem_idx")
    legs = trips(elements).withColumn("arr_ns", F.col("dep_ns") + F.col("trav_ns")).withColumn("before", F.lag("arr_ns").over(w))
    per = legs.groupBy("person", "trip").agg((F.max("arr_ns") - F.min("dep_ns")).alias("ns"), F.max((F.col("dep_ns") < F.col("before"))).alias("bad"), F.max(F.col("arr_ns").isNull()).alias("gap"))
    total = per.groupBy("person").agg(F.sum("ns").alias("ns"), F.max(F.coalesce("bad", F.lit(False)) | F.col("gap")).alias("bad"))
    return total.select("person", F.when(~F.col("bad"), -F.col("ns") / NS).alias("score"))
