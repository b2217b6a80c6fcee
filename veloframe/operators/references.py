"""References to records that do not exist: direct orphans, and orphans inherited down the graph of foreign keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloframe.operators.copies import latest_rows
from veloframe.storage import materialize

#: What stands in a reference field without being a reference.
NO_REFERENCE = ["", "null", "undefined"]
#: Distinct bad references up to this many rows are broadcast; beyond it the join is a salted shuffle.
BROADCAST_ROWS = 200_000
SALTS = 32


@dataclass(frozen=True)
class Table:
    """A table of the graph. key: the column (or expression) that names a record; time: the record's own time, if it has one; newest: of
    several rows of a key the one with the greatest value counts; valid: first and last time in which a row of a target exists (a null
    last time: until the end)."""

    df: DataFrame
    key: str
    time: str | None = None
    newest: str | None = None
    valid: tuple[str, str] | None = None
    references: dict[str, str] = field(default_factory=dict)  # field -> target table


def _is_reference(c: Column) -> Column:
    return c.isNotNull() & ~c.isin(*NO_REFERENCE)


def _rows(t: Table) -> DataFrame:
    """``_key, _time`` and the reference fields ``_f0..`` of the current, distinct records of a table."""
    out = [F.expr(t.key).cast("string").alias("_key"), (F.expr(t.time) if t.time else F.lit(None)).cast("long").alias("_time")]
    out += [F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(t.references)]
    if t.newest:
        return latest_rows(t.df.select(*out, F.col(t.newest).alias("_newest")), "_key", "_newest").drop("_newest")
    return t.df.select(*out)


def _bad_references(t: Table, tables: dict[str, Table]) -> DataFrame:
    """``_to, _id, _time, kind`` of the distinct references of a table that no row of their target covers.

    Taken from all versions of the rows, which needs no ordering: distinct values meet before the shuffle."""
    time = (F.expr(t.time) if t.time else F.lit(None)).cast("long").alias("_time")
    parts = []
    for to in dict.fromkeys(t.references.values()):
        fields = [F.col(f).cast("string") for f, x in t.references.items() if x == to]
        refs = t.df.select(F.explode(F.array_distinct(F.array(*fields))).alias("_id"), time).filter(_is_reference(F.col("_id"))).distinct()
        target = tables[to]
        first, last = target.valid or (None, None)
        period = F.struct((F.col(first) if first else F.lit(None)).cast("long").alias("a"), (F.col(last) if last else F.lit(None)).cast("long").alias("z"))
        there = target.df.select(F.expr(target.key).cast("string").alias("_id"), period.alias("p")).groupBy("_id").agg(F.collect_set("p").alias("periods"))
        covers = lambda p: F.col("_time").isNull() | ((p["a"].isNull() | (p["a"] <= F.col("_time"))) & (p["z"].isNull() | (p["z"] >= F.col("_time"))))
        kind = F.when(F.col("periods").isNull(), "missing").when(F.exists("periods", covers), None).when(F.exists("periods", lambda p: p["z"] < F.col("_time")), "removed").otherwise("later")
        parts.append(refs.join(there, "_id", "left").select(F.lit(to).alias("_to"), "_id", "_time", kind.alias("kind")).filter("kind is not null"))
    return reduce(DataFrame.unionAll, parts)


def _salt(key: str, reference: str) -> Column:
    """A number by which the rows of a hot reference are spread; those that refer to nothing, and meet nothing, are spread over many more."""
    h = F.xxhash64(key)
    return F.when(_is_reference(F.col(reference)), F.pmod(h, F.lit(SALTS))).otherwise(-1 - F.pmod(h, F.lit(SALTS * 1000))).cast("int")


def _referring(rows: DataFrame, field: str, ids: DataFrame) -> DataFrame:
    """The rows whose field is one of these distinct ids: a broadcast of few, else a join in which hot ids are salted."""
    ids = ids.select(F.col("record_key").alias(field))
    rows = rows.filter(_is_reference(F.col(field)))
    if ids.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), field, "left_semi")
    ids = ids.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", _salt("_key", field)).join(ids.hint("merge"), [field, "_salt"], "left_semi").drop("_salt")


def _direct(name: str, t: Table, tables: dict[str, Table]) -> DataFrame:
    bad = materialize(_bad_references(t, tables), "bad-references")
    small = bad.count() <= BROADCAST_ROWS
    rows = _rows(t)
    if not t.newest:
        rows = rows.distinct()
    for i, (_, to) in enumerate(t.references.items()):
        hit = bad.filter(F.col("_to") == to).select(F.col("_id").alias(f"_b{i}"), F.col("_time").alias(f"_t{i}"), F.col("kind").alias(f"_k{i}"))
        on = (F.col(f"_f{i}") == F.col(f"_b{i}")) & F.col("_time").eqNullSafe(F.col(f"_t{i}"))
        if small:
            rows = rows.join(F.broadcast(hit), on, "left").drop(f"_b{i}", f"_t{i}")
        else:
            hit = hit.withColumn(f"_s{i}", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("_salt", _salt("_key", f"_f{i}"))
            rows = rows.join(hit.hint("merge"), on & (F.col("_salt") == F.col(f"_s{i}")), "left")  # the planner does not see how the salts multiply it.drop(f"_b{i}", f"_t{i}", f"_s{i}", "_salt")
    cases = F.array_compact(F.array(*(F.when(F.col(f"_k{i}").isNotNull(), F.struct(F.lit(f).alias("field_name"), F.col(f"_k{i}").alias("kind"))) for i, f in enumerate(t.references))))
    return rows.select(F.lit(name).alias("table_name"), F.col("_key").alias("record_key"), F.col("_time").alias("period"), F.explode(cases).alias("c")).select("table_name", "record_key", "c.field_name", "c.kind", "period").filter("record_key is not null").withColumn("depth", F.lit(0))


def orphans(tables: dict[str, Table], inherited: bool = True) -> DataFrame:
    """``table_name, record_key, field_name, kind, period, depth`` of every orphan reference.

    depth 0 are direct orphans: no row of the target covers the reference at the record's time; kind is ``missing`` (no row with this id),
    ``removed`` (one ended before that time) or ``later``. Null, an empty string, ``null`` and ``undefined`` are no reference; a record
    without a time is checked for the id only. Records that refer to an orphaned record are inherited orphans (kind ``inherited``, depth 1,
    2, ...): semi-joins go down the graph from each round's newly orphaned records until none is added, so cycles end too. Repeated
    identical rows give one case; records with a null key can't be named and are left out; empty tables give no cases (an empty target
    makes every reference to it ``missing``)."""
    direct = {n: _direct(n, t, tables) for n, t in tables.items() if t.references}
    parents = {to for t in tables.values() for to in t.references.values()}
    if inherited:
        direct = {n: materialize(d, "orphans") if n in parents else d for n, d in direct.items()}
    found = list(direct.values())
    seen = {n: direct[n].select("record_key").distinct() for n in direct if n in parents}
    frontier, depth = dict(seen), 0
    while inherited and frontier:
        depth += 1
        new: dict[str, list[DataFrame]] = {}
        for name, t in tables.items():
            for i, (f, to) in enumerate(t.references.items()):
                if to in frontier:
                    hit = _referring(_rows(t), f"_f{i}", frontier[to])
                    new.setdefault(name, []).append(hit.select(F.lit(name).alias("table_name"), F.col("_key").alias("record_key"), F.lit(f).alias("field_name"), F.lit("inherited").alias("kind"), F.col("_time").alias("period"), F.lit(depth).alias("depth")).distinct().filter("record_key is not null"))
        frontier = {}
        for name, parts in new.items():
            rows = reduce(DataFrame.unionAll, parts)
            if name in parents:
                if name in seen:
                    rows = rows.join(seen[name], "record_key", "left_anti").select("table_name", "record_key", "field_name", "kind", "period", "depth")
                rows = materialize(rows, "orphans")
                if rows.isEmpty():
                    continue
                keys = rows.select("record_key").distinct()
                seen[name] = seen[name].union(keys) if name in seen else keys
                frontier[name] = keys
            found.append(rows)
    return reduce(DataFrame.unionAll, found)


def orphan_counts(cases: DataFrame) -> DataFrame:
    """Cases per table, field, period and kind, direct and inherited apart."""
    return cases.groupBy("table_name", "field_name", "period", "kind", (F.col("depth") > 0).alias("inherited")).agg(F.count(F.lit(1)).alias("n_cases"))
