"""Per-entity feature tables kept up to date by signed deltas.

A newer version of an event retracts the older one and inserts itself. Counts and totals are sums of signs; a maximum can only be wrong
where something retracted is at or after the latest insertion, so it is recomputed for those groups alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloframe.operators.ordered import with_previous
from veloframe.storage import materialize, parameters

#: An event id with at least this many rows, and at least one in HOT_SHARE of all, is ordered by a sort over the whole cluster instead of in one task.
HOT_ROWS = 1_000_000
HOT_SHARE = 200


def hot_keys(rows: DataFrame, key: str) -> list:
    """Keys that hold at least HOT_ROWS rows and one row in HOT_SHARE; at most HOT_SHARE of them can. One pass with a sketch of frequent items, merged
    map-side; an estimate never leaves out such a key."""
    n = rows.count()
    if n < HOT_ROWS:
        return []
    top = rows.agg(F.expr(f"approx_top_k(`{key}`, {2 * HOT_SHARE}, 65536)").alias("t")).first()["t"]
    return [x["item"] for x in top or [] if x["count"] >= max(HOT_ROWS, n // HOT_SHARE)]


def signed_deltas(rows: DataFrame, key: str, newest: str, columns: list[str]) -> DataFrame:
    """``key, columns..., _at, _sign``: +1 when a version of an event appears and -1 when a newer one takes its place.

    Versions are ordered by ``newest`` (nulls first); rows of an event that tie in it are redeliveries and count once. Rows whose key is
    null can't be superseded and are left out. ``_at`` is the ``newest`` of the row that causes the change. Versions of hot events are
    range-sorted over the cluster, those of all others meet in one shuffle by key."""
    rows = rows.filter(F.col(key).isNotNull()).select(key, *columns, F.col(newest).alias("_at"))
    hot = hot_keys(rows, key)
    is_hot = F.col(key).isin(*hot) if hot else F.lit(False)
    w = Window.partitionBy(key).orderBy(F.col("_at").asc_nulls_first())
    few = rows.filter(~is_hot).withColumn("_next", F.lead(F.struct(F.col("_at").alias("v")), 1).over(w))
    few = few.filter(F.col("_next").isNull() | ~F.col("_next.v").eqNullSafe(F.col("_at")))
    change = lambda sign, at: F.struct(F.lit(sign).alias("_sign"), at.alias("_at"))
    changes = F.when(F.col("_next").isNull(), F.array(change(1, F.col("_at")))).otherwise(F.array(change(1, F.col("_at")), change(-1, F.col("_next.v"))))
    out = few.select(key, *columns, F.explode(changes).alias("_c")).select(key, *columns, "_c._at", "_c._sign")
    if not hot:
        return out
    own = F.struct(*columns, "_at")
    seen = with_previous(rows.filter(is_hot).withColumn("_own", own), [key], ["_at"], "_own", "_before", "true")
    seen = seen.filter(F.col("_before").isNull() | ~F.col("_before._at").eqNullSafe(F.col("_at")))
    both = F.array_compact(F.array(F.struct(F.lit(1).alias("_sign"), F.col("_own").alias("r")), F.when(F.col("_before").isNotNull(), F.struct(F.lit(-1).alias("_sign"), F.col("_before").alias("r")))))
    many = seen.select(key, "_at", F.explode(both).alias("_c")).select(key, *(F.col(f"_c.r.{c}").alias(c) for c in columns), "_at", "_c._sign")
    return out.unionByName(many)


def _packing(ranges: list[tuple[int | None, int | None]], latest: list[str], schema: dict[str, str]) -> tuple[Callable[[Callable[[str], Column]], Column], Callable[[Column], Column]]:
    """The latest columns as one ordered number, so that maxima are kept in hash tables, and back. Numbers of up to 62 bits become a long, of
    up to 124 bits a decimal; other types stay a struct. The ranges are those of the values there are, so nothing is cut."""
    whole = all(schema[c] in ("tinyint", "smallint", "int", "bigint") for c in latest)
    lows = [lo or 0 for lo, _ in ranges]
    bits = [max((hi or 0) - (lo or 0), 1).bit_length() if whole else 0 for lo, hi in ranges]
    if not whole or sum(bits) > 124:
        return (lambda of: F.struct(*(of(c).alias(c) for c in latest))), (lambda v: v)
    kind = "bigint" if sum(bits) <= 62 else "decimal(38,0)"
    steps = [1 << sum(bits[i + 1 :]) for i in range(len(bits))]
    number = lambda x: F.expr(f"cast('{x}' as {kind})")

    def pack(of: Callable[[str], Column]) -> Column:
        out = number(0)
        for c, lo, step in zip(latest, lows, steps, strict=True):
            out = out + (of(c).cast(kind) - number(lo)) * number(step)
        return out.cast(kind)

    def unpack(v: Column) -> Column:
        parts, rest = [], v
        for c, lo, step in zip(latest, lows, steps, strict=True):
            part = F.call_function("div", rest, number(step)) if kind == "bigint" else F.floor(rest / number(step)).cast(kind)
            parts.append((part + number(lo)).cast(schema[c]).alias(c))
            rest = (rest - part.cast(kind) * number(step)).cast(kind)
        return F.when(v.isNotNull(), F.struct(*parts))

    return pack, unpack


def maintain(state: DataFrame | None, deltas: DataFrame, history: DataFrame, groups: list[str], key: str, latest: list[str], totals: tuple[str, ...] = ()) -> DataFrame:
    """The state ``groups..., n, last, total_<column>...`` after ``deltas``; ``last`` is a struct of the ``latest`` columns of the group's latest event,
    totals are sums of numeric columns (nulls add nothing).

    ``history``: all deltas so far, the new ones included; it is read only for groups in which a retraction affects the latest event.
    Events in which a ``latest`` column is null count, but are never the latest. Groups whose count falls to 0 disappear."""
    kinds = dict(deltas.dtypes)
    known = lambda of: _all_known([of(c) for c in latest])
    ends = [f(c).alias(f"{p}{i}") for i, c in enumerate(latest) for p, f in (("a", F.min), ("z", F.max))]
    whole = deltas.select(*latest) if state is None else deltas.select(*latest).unionByName(state.select(*(F.col(f"last.{c}").alias(c) for c in latest)))
    r = whole.agg(*ends).first()  # one row
    pack, unpack = _packing([(r[f"a{i}"], r[f"z{i}"]) for i in range(len(latest))], latest, kinds)
    when = F.when(known(F.col), pack(F.col))
    sums = [F.sum(F.col("_sign") * F.col(c)).alias(f"total_{c}") for c in totals]
    change = deltas.groupBy(*groups).agg(F.sum("_sign").cast("long").alias("n"), F.max(F.when(F.col("_sign") > 0, when)).alias("put"), F.max(F.when(F.col("_sign") < 0, when)).alias("cut"), *sums)
    if state is not None:
        old = lambda c: F.col(f"last.{c}")
        both = change.unionByName(state.select(*groups, "n", F.when(known(old), pack(old)).alias("put"), F.lit(None).cast(change.schema["cut"].dataType).alias("cut"), *(f"total_{c}" for c in totals)))
        change = both.groupBy(*groups).agg(F.sum("n").alias("n"), F.max("put").alias("put"), F.max("cut").alias("cut"), *(F.sum(f"total_{c}").alias(f"total_{c}") for c in totals))
    rest = ["n", *(f"total_{c}" for c in totals)]
    change = materialize(change.filter("n > 0"), "feature-changes")
    touched = F.col("cut").isNotNull() & (F.col("put").isNull() | (F.col("cut") >= F.col("put")))
    affected = change.filter(touched)
    on = [F.col(f"h.{g}").eqNullSafe(F.col(f"t.{g}")) for g in groups]
    again = history.alias("h").join(parameters(affected.select(*groups)).alias("t"), on, "left_semi")
    again = again.groupBy(*groups, key, when.alias("_v")).agg(F.sum("_sign").alias("net")).filter("net > 0")
    again = again.groupBy(*groups).agg(F.max("_v").alias("again"))
    joined = affected.alias("t").join(again.alias("h"), on, "left").select(*(F.col(f"t.{c}") for c in [*groups, *rest]), unpack(F.col("h.again")).alias("last"))
    sound = change.filter(~touched).select(*groups, *rest, unpack(F.col("put")).alias("last"))
    return materialize(sound.unionByName(joined), "features")


def _all_known(columns: list[Column]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return known


#: Length of an iteration, by which the distance between events of different iterations is measured: one simulated day.
ITERATION_NS = 86_400_000_000_000


def _totals(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c.startswith("total_")]


def feature_rows(state: DataFrame, entity: str, kind: str, iteration: str = "iteration", time: str = "time_ns") -> DataFrame:
    """One row per entity and kind of event with its distance from the end of the data, the latest event of all:
    ``entity, kind, n, last_iteration, last_time_ns, distance_ns, total_...`` (iterations apart count a simulated day each; null without a known time)."""
    end = state.agg(F.max("last").alias("end")).first()["end"]  # one row
    last = F.col("last")
    distance = F.lit(None).cast("long")
    if end is not None:
        distance = (F.lit(end[iteration]).cast("long") - last[iteration]) * F.lit(ITERATION_NS) + (F.lit(end[time]).cast("long") - last[time])
    return state.select(entity, kind, "n", last[iteration].alias("last_iteration"), last[time].alias("last_time_ns"), distance.alias("distance_ns"), *_totals(state))


def feature_table(state: DataFrame, entity: str, kind: str, iteration: str = "iteration", time: str = "time_ns") -> DataFrame:
    """One row per entity: totals over all kinds, and ``features``, an array with one struct per kind, ordered by kind (null first).

    Entities with a null id are nobody and are left out. The array is bounded by the number of kinds."""
    rows = feature_rows(state, entity, kind, iteration, time).filter(F.col(entity).isNotNull())
    totals = _totals(state)
    last = F.max(F.when(F.col("last_time_ns").isNotNull(), F.struct("last_iteration", "last_time_ns", "distance_ns")))
    per = rows.groupBy(entity).agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_kinds"), last.alias("l"), *(F.sum(c).alias(c) for c in totals), F.array_sort(F.collect_list(F.struct(kind, "n", "last_iteration", "last_time_ns", "distance_ns", *totals))).alias("features"))
    return per.select(entity, "n_events", "n_kinds", "l.last_iteration", "l.last_time_ns", "l.distance_ns", *totals, "features")
