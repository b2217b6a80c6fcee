"""Times as BIGINT nanoseconds since scenario midnight: they may pass 24 h, and null is an undefined time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
HOUR_NS, DAY_NS = 3600 * NS, 86_400 * NS


def parse_seconds(text: Column) -> Column:
    """Decimal seconds to nanoseconds, without going through floating point; digits beyond the ninth are cut off. Not a number: null."""
    t = F.trim(text)
    whole, frac = F.split_part(t, F.lit("."), F.lit(1)), F.split_part(t, F.lit("."), F.lit(2))
    ns = whole.try_cast("long") * NS + F.rpad(F.substring(frac, 1, 9), 9, "0").try_cast("long")
    return F.when(t.rlike(r"^\d+(\.\d*)?$"), ns)


def parse_time(text: Column) -> Column:
    """``HH:MM:SS[.frac]`` (hours without limit), decimal seconds, or seconds with an exponent; empty, ``undefined`` and others: null."""
    t = F.trim(text)
    clock = r"^(\d+):(\d{1,2}):(\d{1,2}(?:\.\d*)?)$"
    part = lambda i: F.regexp_extract(t, clock, i)
    hms = part(1).try_cast("long") * HOUR_NS + part(2).try_cast("long") * (60 * NS) + parse_seconds(part(3))
    exponent = F.when(t.rlike(r"^\d+(\.\d*)?[eE][+-]?\d+$"), F.floor(t.try_cast("double") * NS).cast("long"))
    return F.when(t.rlike(clock), hms).otherwise(F.coalesce(parse_seconds(t), exponent))


def _fraction(ns: Column) -> Column:
    rest = ns % NS
    return F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 9, "0"), "0+$", "")))


def format_seconds(ns: Column) -> Column:
    """Decimal seconds without trailing zeros."""
    return F.concat(F.call_function("div", ns, F.lit(NS)).cast("string"), _fraction(ns))


def format_hms(ns: Column) -> Column:
    """``hh:mm:ss`` with a fraction only where there is one; hours go on past 24."""
    s = F.call_function("div", ns, F.lit(NS))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.call_function("div", s, F.lit(3600))
    return F.concat(F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.call_function("div", s % 3600, F.lit(60))), F.lit(":"), two(s % 60), _fraction(ns))


def minus(a: Column, b: Column) -> Column:
    """a - b, at least 0; null if either is."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.greatest(a - b, F.lit(0)))


def to_tick(ns: Column, ticks_per_second: int = 1) -> Column:
    """The first tick not before a time."""
    return F.call_function("div", ns.cast("long") * ticks_per_second + (NS - 1), F.lit(NS))


def from_tick(tick: Column, ticks_per_second: int = 1) -> Column:
    """The nanosecond at which a tick begins, rounded down."""
    return F.call_function("div", tick.cast("long") * NS, F.lit(ticks_per_second))


def bin_count(max_ns: int, bin_ns: int) -> int:
    return max_ns // bin_ns + 1


def time_bin(ns: Column, bin_ns: int, max_ns: int) -> Column:
    """The bin of a time; the last bin is open-ended."""
    return F.least(F.call_function("div", ns, F.lit(bin_ns)), F.lit(bin_count(max_ns, bin_ns) - 1))


def checked_bin(bin_ns: int, ticks_per_second: int = 1) -> int:
    """A usable bin width: positive and a whole number of ticks."""
    if bin_ns <= 0 or bin_ns * ticks_per_second % NS:
        raise ValueError(f"a bin of {bin_ns} ns is not a whole number of ticks")
    return bin_ns
