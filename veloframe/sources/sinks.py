"""Sinks: event logs, plans and networks as XML text, Parquet tables, profiles, output names and the policy for output folders.

Text is made in the executors and written in the partitions of a range-sorted table, one document a part; ``single_file`` asks for one file,
which is for exports of moderate size, the engine's own format being Parquet."""

from __future__ import annotations

import gzip
import shutil
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloframe.functions.attributes import route_text
from veloframe.functions.times import format_hms, format_seconds
from veloframe.operators.events import FIELDS
from veloframe.sources.config import Overwrite
from veloframe.sources.xml import EVENT_ATTRIBUTES
from veloframe.storage import materialize


def output_name(name: str, run_id: str | None = None, iteration: int | None = None) -> str:
    """``[run.]output_name`` of the whole run, ``[run.]<iteration>.name`` of one iteration."""
    prefix = f"{run_id}." if run_id else ""
    return f"{prefix}{iteration}.{name}" if iteration is not None else f"{prefix}output_{name}"


def prepare_folder(path: str, policy: Overwrite) -> None:
    p = Path(path)
    if p.exists() and any(p.iterdir()):
        if policy is Overwrite.FAIL:
            raise FileExistsError(f"{path} is not empty")
        if policy is Overwrite.DELETE:
            shutil.rmtree(p)
    p.mkdir(parents=True, exist_ok=True)


def due(iteration: int, last: int, interval: int) -> bool:
    """Whether something is written in this iteration: in the last one, and every ``interval`` (0: never but last)."""
    return iteration == last or (interval > 0 and iteration % interval == 0)


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _attr(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escaped(value.cast("string")), F.lit('"'))).otherwise("")


def _plain(c: Column) -> Column:
    """A number without a needless fraction."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def event_text(events: DataFrame) -> Column:
    """The line of an event; a waiting passenger is written as person and agent."""
    names = {c: a for a, c in EVENT_ATTRIBUTES.items() if a not in ("driverId", "vehicleId")} | {"driver": "driverId"}
    out = F.lit("")
    for kind, fields in FIELDS.items():
        parts = []
        for f in fields:
            v = format_seconds(F.col(f)) if f == "boarding_time_ns" else _plain(F.col(f)) if dict(events.dtypes)[f] == "double" else F.col(f)
            a = {"vehicle": "vehicleId"}.get(f, names[f]) if kind == "TransitDriverStarts" else names[f]
            parts += [_attr("person", v)] if f == "agent" else []
            parts.append(_attr(a, v))
        out = F.when(F.col("type") == kind, F.concat(*parts) if parts else F.lit("")).otherwise(out)
    return F.concat(F.lit('    <event time="'), format_seconds(F.col("time_ns")), F.lit('" type="'), F.col("type"), F.lit('"'), out, F.lit("/>"))


def _write_text(lines: DataFrame, path: str, head: str, tail: str, codec: str | None, single_file: bool) -> None:
    """lines: ``text`` in its order. By default a folder of parts, each of them in its order and a document of its own, written by the executors;
    one file is put together on the driver and takes its disk. Members of gzip and zstd may follow each other in a file."""
    codec = {"gz": "gzip", "zst": "zstd"}.get(codec, codec)
    if codec not in (None, "gzip", "zstd"):
        raise ValueError(f"unknown codec {codec}")
    folder = f"{path}.parts" if single_file else path

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress("".join(f"{x}\n" for x in b.column(0).to_pylist()).encode())], pa.binary())], names=["member"])

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["text"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array([tail])], names=["text"])

    lines = lines.select("text")
    if codec == "zstd":  # the text writer needs a library of the platform for it
        if not single_file:
            raise ValueError("parts are written plain or as gzip; zstd is for one file")
        members = materialize(lines.mapInArrow(packed, "member binary").withColumn("at", F.monotonically_increasing_id()), "members")
        with open(path, "wb") as out:
            out.write(zstandard.compress(f"{head}\n".encode()))
            for r in members.orderBy("at").toLocalIterator():
                out.write(r["member"])
            out.write(zstandard.compress(f"{tail}\n".encode()))
        return
    (lines if single_file else lines.mapInArrow(framed, "text string")).write.mode("overwrite").option("compression", codec or "none").text(folder)
    if single_file:  # parts stand in the order of their numbers
        pack = gzip.compress if codec == "gzip" else bytes
        with open(path, "wb") as out:
            out.write(pack(f"{head}\n".encode()))
            for part in sorted(Path(folder).glob("part-*")):
                with part.open("rb") as src:
                    shutil.copyfileobj(src, out)
            out.write(pack(f"{tail}\n".encode()))
        shutil.rmtree(folder)


def write_events_xml(events: DataFrame, path: str, codec: str | None = None, single_file: bool = False) -> None:
    """An event log as XML in order of time and ``seq``; codec: None or gzip."""
    lines = events.select("time_ns", "seq", event_text(events).alias("text")).orderBy("time_ns", "seq")
    _write_text(lines, path, '<?xml version="1.0" encoding="utf-8"?>\n<events version="1.0">', "</events>", codec, single_file)


def write_events(events: DataFrame, path: str, iteration: int) -> None:
    """A log as Parquet, one folder an iteration, sorted by time."""
    events.withColumn("iteration", F.lit(iteration)).repartitionByRange("time_ns", "seq").sortWithinPartitions("time_ns", "seq").write.mode("overwrite").parquet(f"{path}/iteration={iteration}")


def _attributes(c: Column) -> Column:
    one = lambda e: F.concat(F.lit('<attribute name="'), escaped(e["key"]), F.lit('" class="java.lang.String">'), escaped(e["value"]), F.lit("</attribute>"))
    inner = F.array_join(F.transform(F.map_entries(c), one), "")
    return F.when(F.size(F.coalesce(c, F.expr("cast(map() as map<string,string>)"))) > 0, F.concat(F.lit("<attributes>"), inner, F.lit("</attributes>"))).otherwise("")


def population_lines(elements: DataFrame) -> DataFrame:
    """``person, text``: one ``<person>`` per row, plans and elements in order; a person's elements are bounded by the plan memory."""
    have = set(elements.columns)
    col = lambda c, k="string": F.col(c) if c in have else F.lit(None).cast(k)
    t = lambda c: format_hms(col(c, "bigint"))
    attrs = _attributes(col("attributes", "map<string,string>"))
    act = F.concat(F.lit("<activity"), _attr("type", col("act_type")), _attr("link", col("link")), _attr("facility", col("facility")), _attr("x", col("x")), _attr("y", col("y")), _attr("start_time", t("start_ns")), _attr("end_time", t("end_ns")), _attr("max_dur", t("max_dur_ns")), F.lit(">"), attrs, F.lit("</activity>"))
    pt = F.to_json(F.struct(col("line").alias("transitLineId"), col("route").alias("transitRouteId"), col("access_facility").alias("accessFacilityId"), col("egress_facility").alias("egressFacilityId"), F.coalesce(t("boarding_ns"), F.lit("undefined")).alias("boardingTime")))
    body = F.when(col("route_type") == "links", route_text(col("links", "array<string>"))).when(col("route_type") == "default_pt", pt).otherwise("")
    route = F.when(col("route_type").isNotNull(), F.concat(F.lit("<route"), _attr("type", col("route_type")), _attr("start_link", col("start_link")), _attr("end_link", col("end_link")), _attr("trav_time", F.coalesce(t("route_trav_ns"), t("trav_ns"))), _attr("distance", col("distance")), _attr("vehicleRefId", col("vehicle")), F.lit(">"), escaped(body), F.lit("</route>"))).otherwise("")
    mode = F.when(col("routing_mode").isNotNull(), F.concat(F.lit('<attributes><attribute name="routingMode" class="java.lang.String">'), escaped(col("routing_mode")), F.lit("</attribute></attributes>"))).otherwise("")
    leg = F.concat(F.lit("<leg"), _attr("mode", col("mode")), _attr("dep_time", t("dep_ns")), _attr("trav_time", t("trav_ns")), F.lit(">"), mode, route, F.lit("</leg>"))
    e = elements.select("person", F.coalesce(col("plan_idx", "int"), F.lit(0)).alias("plan_idx"), "elem_idx", F.coalesce(col("selected", "boolean"), F.lit(True)).alias("selected"), col("score", "double").alias("score"), F.when(F.col("kind") == "act", act).otherwise(leg).alias("t"), col("person_attributes", "map<string,string>").alias("pa"))
    plans = e.groupBy("person", "plan_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_idx", "t"))), lambda s: s["t"]), "\n").alias("t"), F.first("selected").alias("selected"), F.first("score").alias("score"), F.first("pa").alias("pa"))
    plans = plans.withColumn("t", F.concat(F.lit("<plan"), _attr("score", F.col("score")), F.when(F.col("selected"), ' selected="yes">').otherwise(' selected="no">'), F.lit("\n"), F.col("t"), F.lit("\n</plan>")))
    per = plans.groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plan_idx", "t"))), lambda s: s["t"]), "\n").alias("t"), F.first("pa").alias("pa"))
    return per.select("person", F.concat(F.lit("<person"), _attr("id", F.col("person")), F.lit(">"), _attributes(F.col("pa")), F.lit("\n"), F.col("t"), F.lit("\n</person>")).alias("text"))


def write_population_xml(elements: DataFrame, path: str, codec: str | None = None, single_file: bool = False) -> None:
    """Plans as XML in order of the person id."""
    _write_text(population_lines(elements).orderBy("person"), path, '<?xml version="1.0" encoding="utf-8"?>\n<population>', "</population>", codec, single_file)


def merged_attributes(rows: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose ``attributes`` have those of ``overrides`` put over them."""
    from veloframe.functions.attributes import merged

    o = overrides.select(F.col(key).alias("_k"), F.col("attributes").alias("_a"))
    return rows.join(o, F.col(key) == F.col("_k"), "left").withColumn("attributes", merged(F.col("attributes"), F.col("_a"))).drop("_k", "_a")


def write_network_xml(nodes: DataFrame, links: DataFrame, path: str, cell: float = 7.5, codec: str | None = None, single_file: bool = False) -> None:
    n = nodes.select(F.lit(0).alias("o"), "seq", F.concat(F.lit("<node"), _attr("id", F.col("id")), _attr("x", F.col("x")), _attr("y", F.col("y")), F.lit("/>")).alias("text"))
    l = links.select(F.lit(2).alias("o"), "seq", F.concat(F.lit("<link"), *(_attr(a, F.col(c)) for a, c in (("id", "id"), ("from", "from_node"), ("to", "to_node"), ("length", "length_m"), ("capacity", "capacity"), ("freespeed", "freespeed"), ("permlanes", "permlanes"))), _attr("modes", F.array_join("modes", ",")), F.lit(">"), _attributes(F.col("attributes")) if "attributes" in links.columns else F.lit(""), F.lit("</link>")).alias("text"))  # noqa: E741
    spark = nodes.sparkSession
    mid = spark.createDataFrame([(1, 0, f'</nodes>\n<links effectivecellsize="{cell}">')], "o int, seq long, text string")
    lines = n.unionAll(mid.select("o", "seq", "text")).unionAll(l).orderBy("o", "seq")
    _write_text(lines, path, '<?xml version="1.0" encoding="utf-8"?>\n<network>\n<nodes>', "</links>\n</network>", codec, single_file)


def write_vehicles_xml(types: DataFrame, vehicles: DataFrame, path: str, codec: str | None = None, single_file: bool = False) -> None:
    one = lambda tag, a, c: F.concat(F.lit(f"<{tag}"), _attr(a, F.col(c)), F.lit("/>"))
    t = types.select(F.lit(0).alias("o"), F.col("id").alias("k"), F.concat(F.lit("<vehicleType"), _attr("id", F.col("id")), F.lit(">"), one("length", "meter", "length"), one("width", "meter", "width"), one("maximumVelocity", "meterPerSecond", "max_v"), one("passengerCarEquivalents", "pce", "pce"), one("networkMode", "networkMode", "net_mode"), one("flowEfficiencyFactor", "factor", "fef"), F.lit("</vehicleType>")).alias("text"))
    v = vehicles.select(F.lit(1).alias("o"), F.col("vehicle").alias("k"), F.concat(F.lit("<vehicle"), _attr("id", F.col("vehicle")), _attr("type", F.col("type")), F.lit("/>")).alias("text"))
    _write_text(t.unionAll(v).orderBy("o", "k"), path, '<?xml version="1.0" encoding="utf-8"?>\n<vehicleDefinitions>', "</vehicleDefinitions>", codec, single_file)


def write_facilities_xml(facilities: DataFrame, opening: DataFrame, path: str, codec: str | None = None, single_file: bool = False) -> None:
    """Facilities with their activity types and opening times."""
    o = F.concat(F.lit("<opentime"), _attr("day", F.col("open_day")), _attr("start_time", format_hms(F.col("start_ns"))), _attr("end_time", format_hms(F.col("end_ns"))), F.lit("/>"))
    a = opening.groupBy("facility", "act_type").agg(F.array_join(F.array_sort(F.collect_list(o)), "").alias("t"))
    a = a.groupBy("facility").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<activity"), _attr("type", F.col("act_type")), F.lit(">"), F.col("t"), F.lit("</activity>")))), "").alias("t"))
    f = facilities.join(a.withColumnRenamed("facility", "id"), "id", "left")
    text = F.concat(F.lit("<facility"), _attr("id", F.col("id")), _attr("x", F.col("x")), _attr("y", F.col("y")), _attr("linkId", F.col("link")), F.lit(">"), F.coalesce("t", F.lit("")), F.lit("</facility>"))
    _write_text(f.select("id", text.alias("text")).orderBy("id"), path, '<?xml version="1.0" encoding="utf-8"?>\n<facilities>', "</facilities>", codec, single_file)


def write_transit_xml(tables: dict[str, DataFrame], path: str, codec: str | None = None, single_file: bool = False) -> None:
    """A schedule (``stop_facilities, routes, route_stops, departures`` as ``xml.transit`` reads them), one line of text per stop and per transit line. A
    line's stops and departures are put together in one row, as they are few."""
    t = lambda c: format_hms(F.col(c))
    have = set(tables["stop_facilities"].columns)
    stop = F.concat(F.lit("<stopFacility"), _attr("id", F.col("id")), *(_attr(a, F.col(a)) for a in ("x", "y") if a in have), _attr("linkRefId", F.col("link")), F.lit("/>"))
    stops = tables["stop_facilities"].select(F.lit(0).alias("o"), F.col("id").alias("k"), stop.alias("text"))
    joined = lambda parts, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, parts.alias("t")))), lambda s: s["t"]), "")
    one = F.concat(F.lit("<stop"), _attr("refId", F.col("facility")), _attr("arrivalOffset", t("arr_ns")), _attr("departureOffset", t("dep_ns")), F.lit("/>"))
    dep = F.concat(F.lit("<departure"), _attr("id", F.col("id")), _attr("departureTime", t("dep_ns")), _attr("vehicleRefId", F.col("vehicle")), F.lit("/>"))
    halts = tables["route_stops"].groupBy("line", "route").agg(joined(one, "pos").alias("stops"))
    runs = tables["departures"].groupBy("line", "route").agg(joined(dep, "id").alias("deps"))
    r = tables["routes"].select("line", "route", "mode", "links").join(halts, ["line", "route"], "left").join(runs, ["line", "route"], "left")
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<link refId="'), escaped(x), F.lit('"/>'))), "")
    body = F.concat(F.lit("<transitRoute"), _attr("id", F.col("route")), F.lit("><transportMode>"), escaped(F.coalesce("mode", F.lit("pt"))), F.lit("</transportMode><routeProfile>"), F.coalesce("stops", F.lit("")), F.lit("</routeProfile><route>"), links, F.lit("</route><departures>"), F.coalesce("deps", F.lit("")), F.lit("</departures></transitRoute>"))
    lines = r.groupBy("line").agg(joined(body, "route").alias("t")).select(F.lit(2).alias("o"), F.col("line").alias("k"), F.concat(F.lit("<transitLine"), _attr("id", F.col("line")), F.lit(">"), F.col("t"), F.lit("</transitLine>")).alias("text"))
    _write_text(stops.unionAll(lines).orderBy("o", "k"), path, '<?xml version="1.0" encoding="utf-8"?>\n<transitSchedule>', "</transitSchedule>", codec, single_file)


#: Columns of the two profiles.
SPAN_COLUMNS = ["timestamp", "target", "func_name", "duration", "sim_time", "rank", "uuid"]
ROUTING_COLUMNS = ["timestamp", "target", "func_name", "duration", "sim_time", "request_uuid", "person_id", "mode"]


def write_profile(rows: DataFrame, path: str, kind: str = "parquet", batch: int = 50_000) -> None:
    """A profile table as Parquet (Snappy, about ``batch`` rows a row group by its size in bytes) or CSV with a header."""
    if kind == "csv":
        binary = {c: F.hex(c) for c, k in rows.dtypes if k == "binary"}
        rows.withColumns(binary).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").option("compression", "snappy").option("parquet.block.size", str(max(1 << 20, batch * 100))).parquet(path)


def write_neighbours(counts: DataFrame, size: int, path: str) -> None:
    """``size,rank,neighbors`` as CSV."""
    counts.select(F.lit(size).alias("size"), F.col("partition_no").alias("rank"), F.col("n").alias("neighbors")).write.mode("append").option("header", True).csv(path)


def experienced_output(experienced: DataFrame, selected: DataFrame) -> DataFrame:
    """Experienced plans with the attributes and the score of the plan they come from, in order of the person id."""
    meta = selected.groupBy("person").agg(F.first("score").alias("score"), F.first("person_attributes").alias("person_attributes"))
    return experienced.withColumn("plan_idx", F.lit(0)).join(meta, "person", "left").withColumn("selected", F.lit(True)).orderBy("person", "elem_idx")
