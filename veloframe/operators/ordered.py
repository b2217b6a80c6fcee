"""Globally sorted scans in two passes: range-sort, one summary per partition, a prefix combination of the summaries, and a rescan with
the state carried into each partition. A hot key may spread over any number of partitions, so no task has to hold a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloframe.storage import materialize


def range_sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with the partition's number in ``_pid``; kept on the executors' disks.

    Both passes must see the same partitions, so the sorted rows are persisted; a lost executor's partitions are rebuilt from the input
    with the same range bounds. The caller unpersists."""
    df = df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    return df.withColumn("_pid", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)


def partition_summaries(rows: DataFrame, summarise: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> list:
    """The summaries of all partitions in order. They are a fixed number of rows a partition, never a number that grows with its rows."""
    return sorted(rows.mapInPandas(summarise, schema).collect(), key=lambda r: r["_pid"])


def with_previous(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, keep: str) -> DataFrame:
    """The rows for which the SQL condition ``keep`` holds, with ``name``: ``column`` of the row before in ``order`` among those with the same
    ``keys`` (a null key is a key), null for the first one.

    A lag over a group of any size: rows are range-sorted over the cluster, each partition's last row is its summary, and every partition is
    scanned with the last row before it."""
    rows = range_sorted(df, [*keys, *order])
    last = rows.groupBy("_pid").agg(F.max_by(F.struct(*keys, column), F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in [*keys, *order]))).alias("s")).collect()  # one row a partition
    before: dict[int, tuple] = {}
    carry = None
    for r in sorted(last, key=lambda r: r["_pid"]):
        if carry is not None:
            before[r["_pid"]] = carry
        carry = tuple(x.asDict(recursive=True) if isinstance(x, T.Row) else x for x in r["s"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = started = None
        for b in batches:
            if not b.num_rows:
                continue
            k = [b.column(b.schema.get_field_index(c)).to_pylist() for c in keys]
            v = b.column(b.schema.get_field_index(column))
            if started is None:
                started, state = True, before.get(b.column(b.schema.get_field_index("_pid"))[0].as_py())
            own = list(zip(*k, strict=True)) if keys else [()] * b.num_rows
            values, out = v.to_pylist(), []
            for key, x in zip(own, values, strict=True):
                out.append(state[-1] if state is not None and state[:-1] == key else None)
                state = (*key, x)
            yield b.append_column(name, pa.array(out, v.type))

    schema = T.StructType([*rows.schema.fields, T.StructField(name, rows.schema[column].dataType)])
    found = materialize(rows.mapInArrow(scan, schema).drop("_pid").filter(keep), "previous")
    rows.unpersist()
    return found
