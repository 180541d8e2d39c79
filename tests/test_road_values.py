"""Road formulas against cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from roadspark.functions import road


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


L = F.lit


@pytest.mark.parametrize("sign,highway,want", [("90", "residential", 90.0), (None, "trunk_link", 110.0), (None, "secondary", 60.0), ("RU:urban", "tertiary_link", 50.0), (None, "unclassified", 20.0), (None, "footway", 30.0)])
def test_speed_limit(spark, sign, highway, want):
    assert value(spark, road.speed_limit(L(sign).cast("string"), L(highway))) == want


@pytest.mark.parametrize("highway,want", [("trunk", 110.0), ("service", 20.0), ("unclassified", 60.0), ("primary", 60.0)])
def test_legacy_limit(spark, highway, want):
    assert value(spark, road.speed_limit(L(None).cast("string"), L(highway), legacy=True)) == want


@pytest.mark.parametrize(
    "highway,sign,surface,smoothness,service,want",
    [
        ("motorway", None, None, None, None, 90.0), ("motorway", "de:motorway", None, None, None, 90.0), ("motorway", "DE:rural", None, None, None, 100.0), ("primary", "XX:urban", None, None, None, 50.0),
        ("primary", "none", "gravel", None, None, 40.0), ("primary", "70", "asphalt", "very_bad", None, 20.0), ("service", None, None, None, "alley", 7.5), ("footway", "50", None, None, None, None),
    ],
)
def test_car_profile(spark, highway, sign, surface, smoothness, service, want):
    text = lambda x: L(x).cast("string")
    assert value(spark, road.profile_speed(L(highway), text(sign), text(surface), text(None), text(smoothness), text(service))) == want


def test_allowed(spark):
    ask = lambda *v: value(spark, road.profile_allows(*[L(x).cast("string") for x in v]))
    assert [ask("primary", None, None), ask("primary", "permissive", "gate"), ask("primary", "destination", None), ask("primary", None, "bollard"), ask("steps", None, None)] == [True, True, False, False, False]


def test_turn_penalty(spark):
    # 60 km/h into a right angle from a minor road, 60 out: R 15, v = sqrt(0.6 * 9.81 * 15)
    v, u, arc = math.sqrt(0.6 * 9.81 * 15), 60 / 3.6, 15 * math.pi / 2
    want = (u - v) / 2 + arc / v + (u - v) / 1.5 - arc / u
    assert value(spark, road.turn_penalty(L(-90.0), L(2), L(60.0), L(60.0))) == pytest.approx(want) == pytest.approx(9.576, abs=1e-3)
    # straight on at one speed below the cornering speed: nothing; turning round: 15 s more
    assert value(spark, road.turn_penalty(L(0.0), L(2), L(30.0), L(30.0))) == 0.0
    assert value(spark, road.turn_penalty(L(180.0), L(2), L(30.0), L(30.0))) == 15.0
    # from a motorway the radius is 50 m, and 60 km/h need not slow down
    assert value(spark, road.turn_penalty(L(90.0), L(0), L(60.0), L(60.0))) == 0.0


def test_k_magic(spark):
    # 20 s at 50 + 19 km/h on one lane: 20 * 12.8 / 150^2 * 2^20
    assert value(spark, road.k_magic(L(50.0), L(1), L(20.0))) == math.floor(20 * (69 / 5 - 1) / 22500 * 2**20) == 11930
    assert value(spark, road.k_magic(L(-15.0), L(1), L(20.0))) == 10 and value(spark, road.k_magic(L(50.0), L(1), L(0.1))) == 596


@pytest.mark.parametrize("now,after,into,want", [(50, 0, 0, 238), (50, 0, 150, 119), (0, 50, 150, 119), (50, 0, 300, 0), (500, 500, 10, 1000)])
def test_interpolated_penalty(spark, now, after, into, want):
    assert value(spark, road.interpolated_penalty(L(100000).cast("long"), L(now).cast("long"), L(after).cast("long"), L(into), L(100).cast("long"))) == want


@pytest.mark.parametrize("progress,turn,want", [(0.0, 1.0, 0.0), (0.025, 1.0, 30.0), (0.5, 0.6, 60.0), (0.95, 1.0, 30.0), (0.95, 0.6, 36.0), (1.0, 1.0, 0.0)])
def test_speed_profile(spark, progress, turn, want):
    assert value(spark, road.speed_profile(L(progress), L(60.0), L(turn))) == pytest.approx(want)


@pytest.mark.parametrize("mode,cap,want", [("hurry", 110.0, 79.0), ("patient", 110.0, 67.15), ("patient", 70.0, 63.0), ("normal", 110.0, 72.68), ("normal", 70.0, 70.0)])
def test_driver_speed(spark, mode, cap, want):
    assert value(spark, road.driver_speed(L(60.0), L(mode), L(19.0), L(cap))) == pytest.approx(want)


def test_ranks_and_road_table(spark):
    assert [value(spark, road.importance(L(k))) for k in ("unclassified", "residential", "track", "path", "footway", "motorway_link")] == [5, 4, 2, 1, 1, 0]
    assert road.ROAD_DEFAULTS["motorway"][1] == 2 and road.ROAD_DEFAULTS["tertiary"][0] == 50 and len(road.ROAD_DEFAULTS) == 14


@pytest.mark.parametrize("kind,limit,ratio,want", [
    ("car_normal", 60.0, 0.0, 79 * 0.92), ("truck", 90.0, 0.2, 63.0), ("truck", 40.0, 0.2, 59 * 0.9), ("emergency", 40.0, 2.0, 90.0), ("emergency", 110.0, 0.0, 129.0), ("car_hurry", 60.0, 1.5, 25 * 0.98), ("tram", 60.0, 0.0, None)])
def test_agent_speed(spark, kind, limit, ratio, want):
    got = value(spark, road.agent_speed(L(kind), L(limit), L(19.0), L(ratio))[0])
    assert got == (None if want is None else pytest.approx(want))
