"""Queries of the general data problems over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloframe.operators import copies, dualtree, features, intervals, references
from veloframe.storage import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FIELDS = ["time_ns", "person", "link", "act_type"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.differences(table(spark, sf, "act_starts"), table(spark, sf, "act_starts_copy"), "seq", FIELDS, newest="logged_at")


def p1_summary(spark: SparkSession, sf: str) -> DataFrame:
    return p1_found(spark, sf).groupBy("field_name").agg(F.count(F.lit(1)).alias("n_cases"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return dualtree.near_pairs(table(spark, sf, "facilities"), "id", "x", "y", 50.0).select(F.col("id_a").alias("facility_a"), F.col("id_b").alias("facility_b"))


def p3_closest_link(spark: SparkSession, sf: str) -> DataFrame:
    """The closest link of each located facility without a base link, over all links that ever exist."""
    f = table(spark, sf, "facilities").filter(F.col("link").isNull() | F.col("link").isin(*references.NO_REFERENCE))
    n = table(spark, sf, "nodes").select("id", "x", "y").distinct()
    links = table(spark, sf, "links").select("id", "from_node", "to_node").distinct()
    ends = links.join(n.toDF("from_node", "x0", "y0"), "from_node").join(n.toDF("to_node", "x1", "y1"), "to_node")
    best = dualtree.nearest_segment(dualtree.located(f, "id", "x", "y"), ends)
    return best.select(F.col("id").alias("facility"), F.col("segment").alias("link"), F.round("distance", 6).alias("distance_m"))


def p3_near_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many other facilities are at most 50 m away from each located one, near nodes counted as wholes."""
    return dualtree.near_counts(table(spark, sf, "facilities"), "id", "x", "y", 50.0).select(F.col("id").alias("facility"), "n_near")


def p3_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions that each located facility lies in: a rhombus around the nodes of each partition, less the rhombus of half its size."""
    box = table(spark, sf, "nodes").groupBy("partition_no").agg(*(f(c).alias(f"{p}{c}") for c in ("x", "y") for p, f in (("a", F.min), ("z", F.max))))
    mid = lambda c: (F.col(f"a{c}") + F.col(f"z{c}")) / 2
    half = lambda c: (F.col(f"z{c}") - F.col(f"a{c}")) / 2
    turn = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 0)]
    corner = lambda i, j, by: (mid("x") + half("x") * (i * by), mid("y") + half("y") * (j * by))
    side = lambda p, q, by: F.struct(*(c.alias(n) for c, n in zip((*corner(*p, by), *corner(*q, by)), ("x0", "y0", "x1", "y1"), strict=True)))
    rings = F.explode(F.array(*(side(p, q, by) for by in (1.0, 0.5) for p, q in zip(turn, turn[1:], strict=False)))).alias("e")
    edges = box.select(F.col("partition_no").alias("region"), rings).select("region", "e.*")
    return dualtree.containing_regions(table(spark, sf, "facilities").select("id", "x", "y"), edges).select(F.col("id").alias("facility"), F.col("region").cast("int").alias("region"))


def reference_graph(spark: SparkSession, sf: str) -> dict[str, references.Table]:
    t = lambda name: table(spark, sf, name)
    return {
        "nodes": references.Table(t("nodes"), "id"),
        "links": references.Table(t("links"), "id", valid=("first_iter", "last_iter"), references={"from_node": "nodes", "to_node": "nodes"}),
        "persons": references.Table(t("persons"), "id", valid=("first_iter", "last_iter")),
        "facilities": references.Table(t("facilities"), "id", time="loaded_iter", references={"link": "links"}),
        "act_starts": references.Table(t("act_starts"), "seq", time="iteration", newest="logged_at", references={"link": "links", "person": "persons"}),
        "opening_times": references.Table(t("opening_times"), "concat_ws('/', facility, act_type, open_day, start_ns, end_ns)", references={"facility": "facilities"}),
    }


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    graph = {k: v for k, v in reference_graph(spark, sf).items() if k != "opening_times"}
    cases = references.orphans(graph)
    return cases.filter("depth = 0 and table_name in ('act_starts', 'facilities')").select("table_name", "record_key", "field_name", "kind")


def p4_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and inherited orphans over the whole graph, counted per table, field, period and kind."""
    return references.orphan_counts(references.orphans(reference_graph(spark, sf)))


def p4_inherited(spark: SparkSession, sf: str) -> DataFrame:
    """Every record that refers to an orphaned record, by how many references lie between it and the orphan."""
    return references.orphans(reference_graph(spark, sf)).filter("depth > 0").select("table_name", "record_key", "field_name", "depth")


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "act_starts").select("seq", "iteration", "time_ns", "person", "act_type", "logged_at")
    return materialize(features.signed_deltas(rows, "seq", "logged_at", ["person", "act_type", "iteration", "time_ns"]).withColumn("time_s", F.expr("time_ns div 1000000000")), "deltas")


_STATE = (["person", "act_type"], "seq", ["iteration", "time_ns"], ("time_s",))


def _feature_state(spark: SparkSession, sf: str) -> DataFrame:
    deltas = _deltas(spark, sf)
    return features.maintain(None, deltas, deltas, *_STATE)


def p5_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_table(_feature_state(spark, sf), "person", "act_type")


def p5_features_long(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_rows(_feature_state(spark, sf), "person", "act_type").filter("person is not null")


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The totals of each person over all types."""
    return p5_features(spark, sf).drop("features")


def p5_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same features in two steps: a state of what was logged up to the middle of the log, then the rest of the log, whose newer versions
    retract events that the state has."""
    deltas = _deltas(spark, sf)
    middle = F.lit(deltas.agg(F.percentile_approx("_at", 0.5).alias("m")).first()["m"])
    first = deltas.filter(F.col("_at") <= middle)
    state = features.maintain(None, first, first, *_STATE)
    state = features.maintain(state, deltas.filter(F.col("_at") > middle), deltas, *_STATE)
    return features.feature_rows(state, "person", "act_type").filter("person is not null")


def _day_periods(spark: SparkSession, sf: str) -> DataFrame:
    rows = intervals.single_days(table(spark, sf, "opening_times"))
    return intervals.islands(rows, ["facility", "act_type", "open_day"], "start_ns", "end_ns")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.gaps(_day_periods(spark, sf), ["facility", "act_type", "open_day"])


def p6_periods(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.periods(_day_periods(spark, sf), ["facility", "act_type", "open_day"])


_CURRENT = "(select * from (select *, row_number() over (partition by seq order by logged_at desc) rn from {}) where rn = 1)"
_P1 = f"""with a as {_CURRENT.format("act_starts")}, b as {_CURRENT.format("act_starts_copy")},
j as (select coalesce(a.seq, b.seq) as seq, a.seq as sa, b.seq as sb, a.time_ns as ta, b.time_ns as tb, a.person as pa, b.person as pb, a.link as la, b.link as lb, a.act_type as ca, b.act_type as cb from a full join b on a.seq = b.seq)
select seq, 'only_in_first' as field_name from j where sb is null union all select seq, 'only_in_second' from j where sa is null
union all select seq, 'time_ns' from j where sa is not null and sb is not null and ta is distinct from tb
union all select seq, 'person' from j where sa is not null and sb is not null and pa is distinct from pb
union all select seq, 'link' from j where sa is not null and sb is not null and la is distinct from lb
union all select seq, 'act_type' from j where sa is not null and sb is not null and ca is distinct from cb"""
_REFS = f"""refs as (
select 'act_starts' as table_name, cast(seq as varchar) as record_key, 'link' as field_name, link as id, iteration as t, 'links' as target from {_CURRENT.format("act_starts")}
union all select 'act_starts', cast(seq as varchar), 'person', person, iteration, 'persons' from {_CURRENT.format("act_starts")}
union all select distinct 'facilities', id, 'link', link, loaded_iter, 'links' from facilities),
valid as (select 'links' as target, id, first_iter, last_iter from links union select 'persons', id, first_iter, last_iter from persons),
r as (select * from refs where id is not null and id not in ('', 'null', 'undefined')),
cases as (select r.table_name, r.record_key, r.field_name, r.t, case when count(v.id) = 0 then 'missing' when count(*) filter (v.first_iter <= r.t and (v.last_iter is null or v.last_iter >= r.t)) > 0 then null
 when count(*) filter (v.last_iter < r.t) > 0 then 'removed' else 'later' end as kind
 from r left join valid v on v.target = r.target and v.id = r.id group by all)"""
_P4 = f"with {_REFS} select table_name, record_key, field_name, kind from cases where kind is not null"
_P4_CASCADE = f"""with {_REFS}, d as (select * from cases where kind is not null),
ends as (select distinct id, field_name, node from (select id, 'from_node' as field_name, from_node as node from links union all select id, 'to_node', to_node from links) where node is not null and node not in ('', 'null', 'undefined') and node not in (select id from nodes)),
ot as (select distinct concat_ws('/', facility, act_type, open_day, start_ns, end_ns) as k, facility from opening_times where facility is not null and facility not in ('', 'null', 'undefined')),
bad_links as (select id from ends), bad_fac as (select record_key as id from d where table_name = 'facilities'),
inh1 as (select distinct 'facilities' as table_name, id as k, 'link' as field_name, loaded_iter as t from facilities where link in (select id from bad_links) and id not in (select id from bad_fac)
 union all select distinct 'act_starts', cast(seq as varchar), 'link', iteration from {_CURRENT.format("act_starts")} where link in (select id from bad_links)),
allrows as (select table_name, field_name, t as period, kind, false as inherited from d
 union all select 'links', field_name, null, 'missing', false from ends
 union all select 'opening_times', 'facility', null, 'missing', false from ot where facility not in (select id from facilities)
 union all select table_name, field_name, t, 'inherited', true from inh1
 union all select 'opening_times', 'facility', null, 'inherited', true from ot where facility in (select id from bad_fac union select k from inh1 where table_name = 'facilities'))
select table_name, field_name, cast(period as bigint) as period, kind, inherited, count(*) as n_cases from allrows group by all"""
_P4_INHERITED = _P4_CASCADE[: _P4_CASCADE.index(",\nallrows as")] + """ select table_name, k as record_key, field_name, 1 as depth from inh1
 union all select 'opening_times', k, 'facility', case when facility in (select id from bad_fac) then 1 else 2 end from ot where facility in (select id from bad_fac union select k from inh1 where table_name = 'facilities')"""
_P5 = f"""with c as {_CURRENT.format("act_starts")}, k as (select person, act_type, iteration, time_ns, case when time_ns is not null and iteration is not null then {{'i': iteration, 't': time_ns}} end as l from c),
e as (select max(l) as e from k), g as (select person, act_type, count(*) as n, max(l) as l, cast(sum(time_ns // 1000000000) as bigint) as total_time_s from k group by all)
select person, act_type, n, l.i as last_iteration, l.t as last_time_ns, (cast(e.e.i as bigint) - l.i) * 86400000000000 + (e.e.t - l.t) as distance_ns, total_time_s from g, e where person is not null"""
_P5_ENTITIES = f"""select person, cast(sum(n) as bigint) as n_events, count(*) as n_kinds, max(last_iteration) as last_iteration, max(case when last_iteration = m then last_time_ns end) as last_time_ns,
 min(distance_ns) as distance_ns, cast(sum(total_time_s) as bigint) as total_time_s from (select *, max(last_iteration) over (partition by person) as m from ({_P5})) group by person"""
_DAYS = """days as (select d, x from (values ('mon'), ('tue'), ('wed'), ('thu'), ('fri'), ('sat'), ('sun')) v(d), (values ('one'), ('wkday'), ('wkend'), ('wk')) w(x)
 where x in ('one', 'wk') or (x = 'wkday' and d not in ('sat', 'sun')) or (x = 'wkend' and d in ('sat', 'sun'))),
o as (select facility, act_type, lower(coalesce(open_day, 'wk')) as od, start_ns, end_ns from opening_times where start_ns is not null and end_ns > start_ns),
i as (select facility, act_type, days.d as open_day, start_ns, end_ns from o join days on (x = 'one' and d = od) or x = od),
b as (select *, max(end_ns) over (partition by facility, act_type, open_day order by start_ns, end_ns rows between unbounded preceding and 1 preceding) as before from i)"""
_P6 = f"with {_DAYS} select facility, act_type, open_day, before as gap_start_ns, start_ns as gap_end_ns from b where start_ns > before"
_P6_PERIODS = f"""with {_DAYS}, l as (select *, sum(case when before is null or start_ns > before then 1 else 0 end) over (partition by facility, act_type, open_day order by start_ns, end_ns rows unbounded preceding) as g from b)
select facility, act_type, open_day, min(start_ns) as period_start_ns, max(end_ns) as period_end_ns, cast(count(*) as bigint) as n_intervals from l group by facility, act_type, open_day, g"""
_P3 = """with f as (select distinct id, x, y from facilities where x is not null and y is not null and not (x = 0 and y = 0))
select distinct a.id as facility_a, b.id as facility_b from f a join f b on a.id < b.id and b.x between a.x - 50 and a.x + 50 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500"""
_P3_LINK = """with f as (select distinct id, x, y from facilities where x is not null and y is not null and not (x = 0 and y = 0) and (link is null or link in ('', 'null', 'undefined'))),
n as (select distinct id, x, y from nodes), l as (select distinct l.id, p.x as x0, p.y as y0, q.x as x1, q.y as y1 from links l join n p on p.id = l.from_node join n q on q.id = l.to_node),
t as (select f.id as facility, l.id as link, f.x, f.y, x0, y0, x1 - x0 as dx, y1 - y0 as dy, case when (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 then least(1.0, greatest(0.0, ((f.x - x0) * (x1 - x0) + (f.y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) else 0.0 end as t from f, l),
d as (select facility, link, sqrt((x - (x0 + t * dx)) * (x - (x0 + t * dx)) + (y - (y0 + t * dy)) * (y - (y0 + t * dy))) as d from t)
select facility, arg_min(link, {'d': d, 'l': link}) as link, round(min(d), 6) as distance_m from d group by facility"""

_P3_COUNTS = f"""with p as ({_P3}), f as (select distinct id from facilities where x is not null and y is not null and not (x = 0 and y = 0)),
e as (select facility_a as id from p union all select facility_b from p), n as (select id, count(*) as n from e group by id)
select f.id as facility, coalesce(n.n, 0) as n_near from f left join n on n.id = f.id"""
_P3_REGIONS = """with b as (select partition_no as region, (min(x) + max(x)) / 2 as mx, (min(y) + max(y)) / 2 as my, (max(x) - min(x)) / 2 as hx, (max(y) - min(y)) / 2 as hy from nodes group by 1),
f as (select distinct id, x, y from facilities where x is not null and y is not null and not (x = 0 and y = 0)), d as (select id, region, abs(x - mx) / hx + abs(y - my) / hy as d from f, b)
select id as facility, region from d where d <= 1 and d > 0.5"""

QUERIES = {f.__name__: f for f in (p1_found, p1_summary, p3_found, p3_closest_link, p3_near_counts, p3_regions, p4_found, p4_cascade, p4_inherited, p5_features, p5_features_long, p5_entities, p5_incremental, p6_found, p6_periods)}
SQL = {"p1_found": _P1, "p1_summary": f"select field_name, count(*) as n_cases from ({_P1}) group by field_name", "p3_found": _P3, "p3_closest_link": _P3_LINK, "p3_near_counts": _P3_COUNTS, "p3_regions": _P3_REGIONS, "p4_found": _P4, "p4_cascade": _P4_CASCADE, "p4_inherited": _P4_INHERITED, "p5_features_long": _P5, "p5_entities": _P5_ENTITIES, "p5_incremental": _P5, "p6_found": _P6, "p6_periods": _P6_PERIODS}
