"""Link travel times from vehicle events: observations, bins with decay, interpolation, and lookup with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloframe.functions.times import bin_count, time_bin

VEHICLE_EVENTS = ["vehicle enters traffic", "entered link", "left link", "vehicle leaves traffic"]


def asof_mode(events: DataFrame) -> DataFrame:
    """The vehicle events with the network mode in force: that of the vehicle's last entry into traffic."""
    w = Window.partitionBy("vehicle").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    entered = F.when(F.col("type") == "vehicle enters traffic", F.col("network_mode"))
    return events.filter(F.col("type").isin(*VEHICLE_EVENTS)).withColumn("mode", F.last(entered, ignorenulls=True).over(w))


def observations(events: DataFrame) -> DataFrame:
    """``mode, link, enter_ns, travel_ns``: one row per left link that was entered right before by the same vehicle.

    The link is the one entered. Links of departure and arrival are never seen; a vehicle's events are ordered by ``seq``, one shuffle by
    vehicle serves mode and pairing; vehicles whose id is null are nobody."""
    w = Window.partitionBy("vehicle").orderBy("seq")
    rows = asof_mode(events.filter("vehicle is not null")).withColumn("before", F.lag(F.struct("type", "time_ns", "link")).over(w))
    seen = rows.filter((F.col("type") == "left link") & (F.col("before.type") == "entered link"))
    return seen.select("mode", F.col("before.link").alias("link"), F.col("before.time_ns").alias("enter_ns"), (F.col("time_ns") - F.col("before.time_ns")).alias("travel_ns"))


def binned(obs: DataFrame, bin_ns: int, max_ns: int) -> DataFrame:
    """``mode, link, bin, mean_ns, n``: means per bin of entering; partial sums meet before the shuffle, so hot links are no burden."""
    return obs.groupBy("mode", "link", time_bin(F.col("enter_ns"), bin_ns, max_ns).alias("bin")).agg(F.avg("travel_ns").alias("mean_ns"), F.count(F.lit(1)).alias("n"))


def dense(bins: DataFrame, keys: list[str], n_bins: int, value: str, default: Column) -> DataFrame:
    """Every bin of every key that has one; ``value`` is ``default`` where there is none."""
    every = bins.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    there = bins.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("bin").cast("long").alias("_bin"), *(c for c in bins.columns if c not in (*keys, "bin")))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("bin") == F.col("_bin")]
    return every.join(there, on, "left").drop(*(f"_{k}" for k in (*keys, "bin"))).withColumn(value, F.coalesce(F.col(value), default))


def decayed(bins: DataFrame, keys: list[str], bin_ns: int, value: str = "mean_ns") -> DataFrame:
    """After a slow bin times fall by at most a bin's width per bin: ``max(v_j + j bin) - i bin`` over the bins j up to i."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("bin").cast("long") * bin_ns
    return bins.withColumn(value, F.max(F.col(value) + at).over(w) - at)


def interpolated(bins: DataFrame, keys: list[str], bin_ns: int, value: str = "mean_ns") -> DataFrame:
    """Dense bins with the value of the next bin, for ``at_time``."""
    w = Window.partitionBy(*keys).orderBy("bin")
    return bins.withColumn("next_value", F.lead(value).over(w)).withColumn("previous_value", F.lag(value).over(w))


def at_time(t: Column, bin_ns: int, value: Column, previous: Column, following: Column, bin: Column) -> Column:
    """Linear between the middles of bins, constant before the first and after the last."""
    part = t / bin_ns - bin - 0.5
    before = F.when(previous.isNull(), value).otherwise(value + (value - previous) * part)
    after = F.when(following.isNull(), value).otherwise(value + (following - value) * part)
    return F.when(part < 0, before).otherwise(after)


def link_times(links: DataFrame, bins: DataFrame, mode: str, times: DataFrame, bin_ns: int, max_ns: int, max_speed: float | None = None) -> DataFrame:
    """``link, time_ns, travel_ns``: the binned time of a link, its free-speed time where nothing was observed, and at least what the
    vehicle's own top speed allows. times: ``link, time_ns``."""
    free = F.col("length_m") / F.col("freespeed") * 1e9
    rows = times.withColumn("bin", time_bin(F.col("time_ns"), bin_ns, max_ns).cast("long")).join(links.select(F.col("id").alias("link"), "length_m", "freespeed"), "link")
    seen = bins.filter(F.col("mode") == mode).select("link", F.col("bin").cast("long").alias("bin"), "mean_ns")
    value = F.coalesce("mean_ns", free)
    if max_speed and 0 < max_speed < float("inf"):
        value = F.greatest(value, F.col("length_m") / max_speed * 1e9)
    return rows.join(seen, ["link", "bin"], "left").select("link", "time_ns", value.alias("travel_ns"))


def travel_times(events: DataFrame, links: DataFrame, bin_ns: int, max_ns: int) -> DataFrame:
    """``mode, link, bin, mean_ns``: every bin of the observed links; bins without an observation have the free-speed time, then decay."""
    bins = binned(observations(events), bin_ns, max_ns)
    free = links.select(F.col("id").alias("link"), (F.col("length_m") / F.col("freespeed") * 1e9).alias("free_ns"))
    rows = dense(bins, ["mode", "link"], bin_count(max_ns, bin_ns), "mean_ns", F.lit(None).cast("double")).join(free, "link", "left")
    return decayed(rows.withColumn("mean_ns", F.coalesce("mean_ns", "free_ns")), ["mode", "link"], bin_ns).select("mode", "link", "bin", "mean_ns")
