"""Plane geometry and speeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veloframe.functions.times import NS


def distance(x0: Column, y0: Column, x1: Column, y1: Column, z0: Column | None = None, z1: Column | None = None) -> Column:
    """Euclidean distance; a missing z is 0."""
    dz = (z1 if z1 is not None else F.lit(0.0)) - (z0 if z0 is not None else F.lit(0.0))
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + dz * dz)


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def projected(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The point of a segment closest to a point, as a struct x, y; a segment without length is its beginning."""
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x0) * dx + (y - y0) * dy) / F.when(l2 > 0, l2)))).otherwise(0.0)
    return F.struct((x0 + t * dx).alias("x"), (y0 + t * dy).alias("y"))


def freespeed_time(length: Column, speed: Column) -> Column:
    """Seconds over a link at a positive, finite speed; else null."""
    return F.when((speed > 0) & (speed < F.lit(float("inf"))), length / F.when(speed > 0, speed))


def routing_time(length: Column, speed: Column) -> Column:
    """The same for routing: links of no length take none, and a link that can't be driven takes forever."""
    return F.when(length < 1e-9, 0.0).otherwise(F.coalesce(freespeed_time(length, speed), F.lit(float("inf"))))


def beeline_time_ns(distance_m: Column, factor: float, speed: float) -> Column:
    """Time of a leg that is teleported along the beeline times a factor."""
    return F.floor(distance_m * factor / speed * NS).cast("long")


def generalised_cost(time_s: Column, length: Column, time_factor: Column, distance_factor: Column) -> Column:
    return time_s * time_factor + length * distance_factor


def time_factor(travelling_per_hour: Column, performing_per_hour: Column) -> Column:
    """Cost per second: travelling costs its own disutility and the activity that is not performed."""
    return (-travelling_per_hour + performing_per_hour) / 3600


def distance_factor(distance_utility: Column, money_rate: Column, utility_of_money: Column) -> Column:
    return -distance_utility - money_rate * utility_of_money


def flow_capacity(capacity_per_hour: Column, sample: float = 1.0, ticks_per_second: int = 1) -> Column:
    """Vehicles a tick."""
    return capacity_per_hour * sample / 3600 / ticks_per_second


def storage_capacity(length: Column, lanes: Column, freespeed: Column, capacity_per_hour: Column, cell: float = 7.5, sample: float = 1.0, kinematic: bool = False) -> Column:
    """Vehicles a link holds: what fits on its lanes, and at least what flows through it in its free-speed time (and, with kinematic waves,
    in the time a gap needs to travel back at 15 km/h)."""
    flow = capacity_per_hour * sample / 3600
    base = F.greatest(flow, length * lanes * sample / cell)
    needed = (length / freespeed + (length / (15 / 3.6) if kinematic else F.lit(0.0))) * flow
    return F.greatest(base, needed)


def kinematic_inflow(lanes: Column, freespeed: Column, cell: float = 7.5, sample: float = 1.0, ticks_per_second: int = 1) -> Column:
    """The most vehicles that may enter a link per tick under kinematic waves."""
    return lanes / cell / (1 / F.lit(15 / 3.6) + 1 / freespeed) * sample / ticks_per_second
