"""Event logs as streams: replay of log files, windowed and keyed state, with results like those of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veloframe.operators.events import SCHEMA
from veloframe.operators.traveltime import VEHICLE_EVENTS

#: The day on which simulated time begins in event-time columns.
EPOCH = "2000-01-01 00:00:00"


def replay(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet event files as a stream, ``files_per_batch`` files in each micro-batch, oldest first, with ``event_time``."""
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return with_event_time(df)


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", (F.lit(EPOCH).cast("timestamp_ntz").cast("timestamp") + F.make_dt_interval(secs=(F.col("time_ns") / 1e9).cast("decimal(18,6)"))))


def stream_observations(events: DataFrame, timeout: str | None = None) -> DataFrame:
    """Travel-time observations of a stream, ``mode, link, enter_ns, travel_ns, event_time``: per vehicle the mode and the last link entered are
    kept as state, which goes when it leaves traffic. Micro-batches must come in order of time; within one, rows are ordered by ``seq``.

    With ``timeout`` (a duration) a vehicle that never leaves traffic is forgotten once the watermark is that far past its last event."""
    rows = events.filter(F.col("type").isin(*VEHICLE_EVENTS) & F.col("vehicle").isNotNull()).select("vehicle", "time_ns", "seq", "type", "link", "network_mode", "event_time")
    if timeout:
        rows = rows.withWatermark("event_time", timeout)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mode, link, at = state.get if state.exists else (None, None, None)
        rows_ = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows_.itertuples(index=False):
            if r.type == "vehicle enters traffic":
                mode, link, at = r.network_mode, None, None
            elif r.type == "entered link":
                link, at = r.link, r.time_ns
            elif r.type == "left link":
                if link is not None:
                    out.append((mode, link, int(at), int(r.time_ns - at), r.event_time))
                link, at = None, None
            else:
                link, at, mode = None, None, None
        if mode is None and link is None:
            state.remove()
        else:
            state.update((mode, link, None if at is None else int(at)))
            if timeout:
                state.setTimeoutTimestamp(int(rows_["event_time"].max().timestamp() * 1000) + 1 + int(state.getCurrentWatermarkMs() > 0))
        if out:
            yield pd.DataFrame(out, columns=["mode", "link", "enter_ns", "travel_ns", "event_time"])

    return rows.groupBy("vehicle").applyInPandasWithState(fold, "mode string, link string, enter_ns long, travel_ns long, event_time timestamp", "mode string, link string, at long", "append", GroupStateTimeout.EventTimeTimeout if timeout else GroupStateTimeout.NoTimeout)


def windowed_means(observations: DataFrame, width: str = "15 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean travel time per mode, link and tumbling (or sliding) window of entering; observations later than ``late`` are dropped."""
    rows = observations.drop("event_time").withColumn("time_ns", F.col("enter_ns"))
    rows = with_event_time(rows).withWatermark("event_time", late)
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return rows.groupBy("mode", "link", w).agg(F.avg("travel_ns").alias("mean_ns"), F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key's events: ``key, session, n``; a pause longer than ``gap`` begins a new one."""
    return events.withWatermark("event_time", late).groupBy(key, F.session_window("event_time", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def subscribe(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Runs a handler per event type on every micro-batch (``*`` gets all events); returns the started query."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for kind, handle in handlers.items():
            handle(batch if kind == "*" else batch.filter(F.col("type") == kind), number)
        batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
