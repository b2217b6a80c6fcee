"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloframe.operators.ordered import partition_summaries, range_sorted
from veloframe.storage import materialize


def _changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from that of the row before (the first row: True). Nulls equal nulls."""
    new = np.zeros(len(pdf), bool)
    for k in keys:
        codes = pd.factorize(pdf[k], use_na_sentinel=True)[0]
        new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return new


def _scan(pdf: pd.DataFrame, keys: list[str], carry: tuple | None) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, tuple]:
    """Island labels of a sorted block. carry: (key, greatest end, label of the open island) of what precedes, or None.

    Returns the block, the greatest end before each row (NaN-free; only valid where ``has``), ``has``, labels, and the new carry."""
    start, end = pdf["start_ns"].to_numpy(np.int64), pdf["end_ns"].to_numpy(np.int64)
    new = _changes(pdf, keys)
    key0 = tuple(None if pd.isna(v) else str(v) for v in pdf[keys].iloc[0])
    joins = carry is not None and carry[0] == key0
    group = np.cumsum(new)
    upto = pd.Series(end).groupby(group).cummax().to_numpy().copy()
    if joins:
        first = group == 1
        upto[first] = np.maximum(upto[first], carry[1])
    before = np.empty_like(upto)
    before[1:] = upto[:-1]
    has = ~new
    if joins:
        before[0], has[0] = carry[1], True
    opens = ~has | (start > np.where(has, before, 0))
    at = np.maximum.accumulate(np.where(opens, np.arange(len(start)), -1))
    label = np.where(at >= 0, start[np.maximum(at, 0)], carry[2] if joins else 0)
    keyn = tuple(None if pd.isna(v) else str(v) for v in pdf[keys].iloc[-1])
    return before, has & opens, label, (keyn, int(upto[-1]), int(label[-1]))


def _summaries(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = carry = pid = None
        for pdf in batches:
            if len(pdf):
                if first is None:
                    first, pid = tuple(None if pd.isna(v) else str(v) for v in pdf[keys].iloc[0]), int(pdf["_pid"].iloc[0])
                carry = _scan(pdf, keys, carry)[3]
        if first is not None:
            yield pd.DataFrame({"_pid": [pid], "first": [list(first)], "last": [list(carry[0])], "end": [carry[1]], "label": [carry[2]]})

    return run


def _combine(summaries: list) -> dict[int, tuple]:
    """The state carried into each partition, by an associative prefix combination of the summaries."""
    carried, state = {}, None
    for s in summaries:
        if state is not None:
            carried[s["_pid"]] = state
        first, last = tuple(s["first"]), tuple(s["last"])
        if state is not None and first == last == state[0]:  # the partition lies within one key that began before
            state = (last, max(state[1], s["end"]), state[2] if s["label"] <= state[1] else s["label"])
        else:
            state = (last, s["end"], s["label"])
    return carried


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Each distinct usable interval with the label of its island: ``keys..., start_ns, end_ns, n_rows, island_start_ns, gap_from_ns``.

    Usable: start and end given, end > start. Intervals that overlap or touch belong to one island, labelled by its first start;
    ``gap_from_ns`` is set on the first interval of every later island of a key: the end of the period before. Null keys are a key of their
    own; repeated rows are counted in ``n_rows``; no usable rows give an empty result; other columns are dropped.

    Rows are range-sorted by key and start over the cluster, each partition's greatest end is summarised, summaries are prefix-combined on
    the driver (one row a partition) and each partition is rescanned with the state that reaches it."""
    rows = df.select(*keys, F.col(start).cast("long").alias("start_ns"), F.col(end).cast("long").alias("end_ns")).filter("start_ns is not null and end_ns > start_ns")
    rows = rows.groupBy(*keys, "start_ns", "end_ns").agg(F.count(F.lit(1)).alias("n_rows"))  # repeats of one interval meet before the sort, which can't split them
    ordered = range_sorted(rows, [*keys, "start_ns", "end_ns"])
    names = list(keys)
    carried = _combine(partition_summaries(ordered, _summaries(names), "_pid int, first array<string>, last array<string>, end long, label long"))

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = known = None
        for pdf in batches:
            if len(pdf):
                if known is None:
                    known, carry = True, carried.get(int(pdf["_pid"].iloc[0]))
                before, gap, label, carry = _scan(pdf, names, carry)
                yield pdf.drop(columns="_pid").assign(island_start_ns=label, gap_from_ns=pd.array(np.where(gap, before, 0), "Int64").copy()).assign(gap_from_ns=lambda d, g=gap: d["gap_from_ns"].where(g))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "start_ns", "end_ns", "n_rows"]) + ", island_start_ns long, gap_from_ns long"
    result = materialize(ordered.mapInPandas(rescan, schema), "islands")
    ordered.unpersist()
    return result


def periods(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Continuous periods of ``islands(...)``: ``keys..., period_start_ns, period_end_ns, n_intervals``."""
    return labelled.groupBy(*keys, F.col("island_start_ns").alias("period_start_ns")).agg(F.max("end_ns").alias("period_end_ns"), F.sum("n_rows").alias("n_intervals"))


def gaps(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between consecutive periods of ``islands(...)``: ``keys..., gap_start_ns, gap_end_ns``."""
    return labelled.filter("gap_from_ns is not null").select(*keys, F.col("gap_from_ns").alias("gap_start_ns"), F.col("start_ns").alias("gap_end_ns"))


#: The single days that an opening day stands for.
DAYS = {"wkday": ["mon", "tue", "wed", "thu", "fri"], "wkend": ["sat", "sun"], "wk": ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]}


def single_days(df: DataFrame, day: str = "open_day") -> DataFrame:
    """One row per single day that ``day`` stands for, in any letter case; null means all seven; unknown names give no row."""
    d = F.lower(F.coalesce(F.col(day), F.lit("wk")))
    arrays = F.when(d.isin(*DAYS["wk"]), F.array(d))
    for name, days in DAYS.items():
        arrays = arrays.when(d == name, F.array(*map(F.lit, days)))
    return df.withColumn(day, F.explode(arrays))
