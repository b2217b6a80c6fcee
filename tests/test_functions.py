import math

import pytest
from pyspark.sql import functions as F

from veloframe.functions import attributes, geometry, rng, times


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_times(spark):
    text = {"09:05:00": 32700, "9:05:00": 32700, "31:00:01.5": 111601.5, "12.000000001": 12.000000001, "0": 0, "3.6e1": 36, "undefined": None, "": None, "1:2": None, "00:00:00.1234567899": 0.123456789}
    for t, s in text.items():
        got = one(spark, v=times.parse_time(F.lit(t))).v
        assert got == (None if s is None else round(s * 1e9)), t
    ns = F.lit(111601_500_000_000)
    r = one(spark, a=times.format_hms(ns), b=times.format_seconds(ns), c=times.format_hms(F.lit(61_000_000_000)), d=times.format_seconds(F.lit(7_000_000_000)))
    assert tuple(r) == ("31:00:01.5", "111601.5", "00:01:01", "7")
    r = one(spark, up=times.to_tick(F.lit(1), 1), same=times.to_tick(F.lit(10**9), 1), tenth=times.to_tick(F.lit(150_000_000), 10), back=times.from_tick(F.lit(1), 3), less=times.minus(F.lit(1), F.lit(5)), none=times.minus(F.lit(None).cast("long"), F.lit(5)), last=times.time_bin(F.lit(10**15), 900 * 10**9, 86400 * 10**9))
    assert tuple(r) == (1, 1, 2, 333_333_333, 0, None, 96)
    with pytest.raises(ValueError):
        times.checked_bin(1_500_000_000, 1)
    assert times.checked_bin(1_500_000_000, 10)


def test_random_streams(spark):
    assert [rng.fnv1a64(x) for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    parts = (42).to_bytes(8, "little") + (2).to_bytes(8, "little") + b"ab" + (1).to_bytes(8, "little") + b"c"
    assert rng.seed(42, "ab", "c", b"tag") == rng.fnv1a64(b"tag" + parts) and rng.seed(42, "ab", "c") == rng.fnv1a64(rng.TAG + parts)
    s = rng.Stream(0)  # SplitMix64 of 0 is a published sequence
    assert s.s == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F, 0xF88BB8A8724C81EC]
    first = rng.Stream.of(42, "replanning.strategy", "7:agent-1").u64()
    assert rng.seed(42, "ab", "c") != rng.seed(42, "a", "bc")
    df = spark.createDataFrame([("7:agent-1",), (None,)], "s string").select("s", rng.uniform(42, "replanning.strategy", F.col("s")).alias("u"))
    assert {r.s: r.u for r in df.collect()} == {"7:agent-1": (first >> 11) * 2.0**-53, None: None}
    draws = [rng.Stream(i).below(7) for i in range(700)]
    assert set(draws) == set(range(7))


def test_attributes(spark):
    r = one(spark, a=attributes.reference(F.lit("null")), b=attributes.reference(F.lit(" v ")), m=attributes.modes(F.lit(" car,,bike , ")), l=attributes.route_links(F.lit("a\n  b\tc ")), t=attributes.route_text(F.array(F.lit("a"), F.lit("a"))), t2=attributes.route_text(F.array(F.lit("a"), F.lit("b"), F.lit("a"))))
    assert tuple(r) == (None, "v", ["car", "bike"], ["a", "b", "c"], "a", "a b a")
    r = one(spark, x=attributes.merged(F.create_map(F.lit("k"), F.lit("1"), F.lit("z"), F.lit("2")), F.create_map(F.lit("k"), F.lit("3"))), y=attributes.merged(F.lit(None).cast("map<string,string>"), F.create_map(F.lit("k"), F.lit("3"))))
    assert r.x == {"k": "3", "z": "2"} and r.y == {"k": "3"}
    t = lambda v, c: attributes.typed(F.lit(v), F.lit(c))
    r = one(spark, a=t("12", "java.lang.Integer"), b=t("x", "java.lang.Integer"), c=t("true", "java.lang.Boolean"), d=t("q", "some.Other"), e=t('{"car":"1"}', "a.b.PersonVehicles"))
    assert tuple(r) == ("12", None, "true", None, '{"car":"1"}')
    r = one(spark, a=attributes.is_interaction(F.lit("car interaction 2")), b=attributes.is_interaction_parameter(F.lit("car interaction 2")))
    assert tuple(r) == (True, False)


def test_geometry(spark):
    L = lambda *v: [F.lit(float(x)) for x in v]
    r = one(spark, d=geometry.distance(*L(0, 0, 3, 4)), p=geometry.projected(*L(5, 7, 0, 0, 10, 0)), q=geometry.projected(*L(-5, 7, 0, 0, 10, 0)), z=geometry.projected(*L(5, 7, 1, 1, 1, 1)), f=geometry.routing_time(*L(100, 0)), g=geometry.routing_time(*L(0, 0)), h=geometry.freespeed_time(*L(100, 10)), w=geometry.beeline_time_ns(F.lit(100.0), 1.3, 3 / 3.6))
    assert r.d == 5 and tuple(r.p) == (5, 0) and tuple(r.q) == (0, 0) and tuple(r.z) == (1, 1) and r.f == math.inf and r.g == 0 and r.h == 10 and r.w == 156_000_000_000
    r = one(spark, a=geometry.storage_capacity(*L(100, 1, 10, 3600)), b=geometry.storage_capacity(*L(1000, 1, 1, 3600)), c=geometry.storage_capacity(*L(100, 1, 10, 3600), kinematic=True), i=geometry.kinematic_inflow(*L(1, 10)))
    assert r.a == pytest.approx(100 / 7.5) and r.b == 1000 and r.c == pytest.approx(10 + 24) and r.i == pytest.approx(1 / 7.5 / (3.6 / 15 + 0.1))
