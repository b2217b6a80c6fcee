"""Typed, time-ordered event logs: views by type, merging, order checks and comparison.

An event table has ``time_ns, seq, type`` and the fields of all types as nullable columns; ``seq`` is the place in its file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloframe.operators.ordered import with_previous
from veloframe.storage import materialize

#: The event types and their fields besides time.
FIELDS = {
    "generic": [],
    "actstart": ["person", "link", "x", "y", "act_type"],
    "actend": ["person", "link", "x", "y", "act_type"],
    "entered link": ["link", "vehicle"],
    "left link": ["link", "vehicle"],
    "vehicle enters traffic": ["vehicle", "link", "person", "network_mode", "relative_position"],
    "vehicle leaves traffic": ["vehicle", "link", "person", "network_mode", "relative_position"],
    "PersonEntersVehicle": ["person", "vehicle"],
    "PersonLeavesVehicle": ["person", "vehicle"],
    "departure": ["person", "link", "leg_mode", "routing_mode"],
    "arrival": ["person", "link", "leg_mode"],
    "travelled": ["person", "mode", "distance"],
    "travelled with pt": ["person", "distance", "mode", "route", "line", "boarding_time_ns", "access_facility", "egress_facility"],
    "TransitDriverStarts": ["driver", "vehicle", "transit_line", "transit_route", "departure"],
    "VehicleArrivesAtFacility": ["vehicle", "facility", "delay"],
    "VehicleDepartsAtFacility": ["vehicle", "facility", "delay"],
    "waitingForPt": ["agent", "at_stop", "destination_stop"],
    "stuckAndAbort": ["person", "link", "leg_mode", "reason"],
}
KINDS = {"x": "double", "y": "double", "relative_position": "double", "distance": "double", "delay": "double", "boarding_time_ns": "bigint"}
COLUMNS = list(dict.fromkeys(f for fields in FIELDS.values() for f in fields))
SCHEMA = "time_ns bigint, seq bigint, type string, " + ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in COLUMNS)


def of_type(events: DataFrame, kind: str) -> DataFrame:
    """The events of one type with its fields; a field the table hasn't got is null, a missing delay is 0. Unknown types are an error."""
    have = set(events.columns)
    fields = [(F.coalesce(F.col(f), F.lit(0.0)) if f == "delay" else F.col(f)).alias(f) if f in have else F.lit(0.0 if f == "delay" else None).cast(KINDS.get(f, "string")).alias(f) for f in FIELDS[kind]]
    keys = [c for c in ("time_ns", "seq") if c in have]
    return events.filter(F.col("type") == kind).select(*keys, *fields)


def merged(logs: list[DataFrame]) -> DataFrame:
    """One log of several, each in its own order, by time, then the place of the log in the list, then ``seq``; renumbered from 0.

    The number comes from a range-partitioned sort and the sizes of its partitions, so no task sees the whole log."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("_log", F.lit(i)) for i, df in enumerate(logs)])
    return numbered(rows, ["time_ns", "_log", "seq"], "seq").drop("_log")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in a total order, without a window over everything."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    rows = materialize(rows, "sorted")
    upto, starts = 0, []
    for r in sorted(rows.groupBy("_pid").count().collect(), key=lambda r: r["_pid"]):  # one row a partition
        starts.append((r["_pid"], upto))
        upto += r["count"]
    at = df.sparkSession.createDataFrame(starts, "_pid int, _start long")
    at = F.broadcast(at)  # one row a partition
    return rows.join(at, "_pid").withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_pid", "_in", "_start")


def out_of_order(events: DataFrame, source: str | None = None) -> DataFrame:
    """Events before which, in ``seq`` order of their source, a later time stands right before, with that ``previous_ns``."""
    return with_previous(events, [source] if source else [], ["seq"], "time_ns", "previous_ns", "previous_ns > time_ns")


def _identity(df: DataFrame, fields: list[str]) -> Column:
    return F.to_json(F.struct("type", *(F.col(f) for f in fields)), {"ignoreNullFields": "true"})


def difference(a: DataFrame, b: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``time_ns, event, n_first, n_second`` of what two logs don't have equally often at a time; order within a time doesn't matter.

    Both logs are counted per time and event before anything is compared, so repeats and hot times stay small. No rows: they are equal."""
    fields = fields or [c for c in COLUMNS if c in a.columns or c in b.columns]

    def counts(df: DataFrame, n: str, other: str) -> DataFrame:
        have = df.withColumns({f: F.lit(None).cast(KINDS.get(f, "string")) for f in fields if f not in df.columns})
        return have.select("time_ns", _identity(have, fields).alias("event"), F.lit(1).alias(n), F.lit(0).alias(other))

    both = counts(a, "n_first", "n_second").unionByName(counts(b, "n_second", "n_first"))
    return both.groupBy("time_ns", "event").agg(F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second")).filter("n_first <> n_second")


def compare(a: DataFrame, b: DataFrame) -> str:
    """``equal``, or why not at the first time at which the logs differ: ``order``, ``count``, ``time`` or ``missing``.

    One side exhausted is a matter of count; a time that decreases in a log of order; then other times, other counts and missing events."""
    order = [out_of_order(x.select("time_ns", "seq")).agg(F.min("previous_ns").alias("t")).first()["t"] for x in (a, b)]
    times = lambda df, n: df.groupBy("time_ns").agg(F.count(F.lit(1)).alias(n))
    per = times(a, "na").join(times(b, "nb"), "time_ns", "full_outer")
    first = per.filter(F.col("na").isNull() | F.col("nb").isNull()).agg(F.min("time_ns").alias("t"), F.max("time_ns").alias("z")).first()
    bad = difference(a, b).agg(F.min("time_ns").alias("t")).first()["t"]
    counts = per.filter("na <> nb").agg(F.min("time_ns").alias("t")).first()["t"]
    ends = [df.agg(F.max("time_ns").alias("t")).first()["t"] for df in (a, b)]
    found = []
    if first["t"] is not None:
        found.append((first["t"], 2, "time" if all(e is not None and e > first["t"] for e in ends) or (None not in ends and ends[0] >= first["t"] and ends[1] >= first["t"]) else "count"))
    found += [(t, 1, "order") for t in order if t is not None]
    found += [(counts, 3, "count")] if counts is not None else []
    found += [(bad, 4, "missing")] if bad is not None else []
    return min(found)[2] if found else "equal"
