"""Road attributes as column expressions: tags, speeds, costs, congestion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag lists and defaults.
CANDIDATE_HIGHWAYS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service"]
CLOSED_ACCESS = ["private", "no", "customers", "delivery"]
CLOSED_BARRIERS = ["gate", "fence", "wall", "bollard", "block"]
# speed limit by class, without a signed one; other classes have the last value
SPEED_DEFAULTS = {
    "motorway": 110.0, "motorway_link": 110.0, "trunk": 110.0, "trunk_link": 110.0, "primary": 60.0, "primary_link": 60.0, "secondary": 60.0, "secondary_link": 60.0,
    "tertiary": 50.0, "tertiary_link": 50.0, "residential": 20.0, "living_street": 20.0, "service": 20.0, "unclassified": 20.0,
}
OTHER_SPEED = 30.0
SPEED_DEFAULTS_LEGACY = {"motorway": 110.0, "motorway_link": 110.0, "trunk": 110.0, "trunk_link": 110.0, "residential": 20.0, "living_street": 20.0, "service": 20.0}
OTHER_SPEED_LEGACY = 60.0
TOLERANCE_KMH = 19.0
SLOT_S, SLOTS = 300, 24
IMPORTANCE = {"motorway": 10, "trunk": 9, "primary": 8, "secondary": 7, "tertiary": 6, "unclassified": 5, "residential": 4, "service": 3, "track": 2, "path": 1, "footway": 1}
CLASS_CODES = {0: ["motorway", "trunk", "motorway_link"], 1: ["primary", "secondary", "primary_link"], 2: ["tertiary", "tertiary_link"]}
# class: speed km/h, lanes, seconds to turn right, go on, turn left, turn round
ROAD_DEFAULTS = {
    "motorway": (110, 2, 0, 0, 999, 999), "motorway_link": (80, 1, 0, 0, 5, 999), "trunk": (90, 2, 0, 0, 5, 999), "trunk_link": (70, 1, 0, 0, 5, 999),
    "primary": (60, 2, 1, 0, 4, 30), "primary_link": (50, 1, 1, 0, 4, 30), "secondary": (60, 2, 1, 0, 4, 30), "secondary_link": (50, 1, 1, 0, 4, 30),
    "tertiary": (50, 1, 1, 0, 3, 20), "tertiary_link": (40, 1, 1, 0, 3, 20), "residential": (20, 1, 0, 0, 2, 10), "living_street": (10, 1, 0, 0, 1, 5),
    "service": (20, 1, 0, 0, 2, 10), "unclassified": (30, 1, 0, 0, 2, 15),
}
OTHER_ROAD = (30, 1, 1, 0, 3, 20)
# zoom layers: first zoom, zoom behind the last, classes; the last one holds beyond its end too
LOD = [
    (0, 8, ["motorway", "motorway_link", "trunk", "trunk_link"]),
    (8, 11, ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"]),
    (11, 14, ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link"]),
    (14, 24, ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "residential", "living_street", "unclassified", "service"]),
]
# car profile: km/h by class, country signs (0: no limit), signs of any country, and caps by surface, track and smoothness
PROFILE_KMH = {
    "motorway": 90.0, "motorway_link": 45.0, "trunk": 85.0, "trunk_link": 40.0, "primary": 65.0, "primary_link": 30.0, "secondary": 55.0, "secondary_link": 25.0,
    "tertiary": 40.0, "tertiary_link": 20.0, "unclassified": 25.0, "residential": 25.0, "living_street": 10.0, "service": 15.0,
}
SIGNS = {
    "at:rural": 100.0, "at:trunk": 100.0, "be:motorway": 120.0, "be-bru:rural": 70.0, "be-bru:urban": 30.0, "be-vlg:rural": 70.0, "bg:motorway": 140.0, "by:urban": 60.0,
    "by:motorway": 110.0, "ca-on:rural": 80.0, "ch:rural": 80.0, "ch:trunk": 100.0, "ch:motorway": 120.0, "cz:trunk": 0.0, "cz:motorway": 0.0, "de:living_street": 7.0,
    "de:rural": 100.0, "de:motorway": 0.0, "dk:rural": 80.0, "es:trunk": 90.0, "fr:rural": 80.0, "gb:nsl_single": 96.56, "gb:nsl_dual": 112.65, "gb:motorway": 112.65,
    "nl:rural": 80.0, "nl:trunk": 100.0, "no:rural": 80.0, "no:motorway": 110.0, "ph:urban": 40.0, "ph:rural": 80.0, "ph:motorway": 100.0, "pl:rural": 100.0,
    "pl:expressway": 120.0, "pl:motorway": 140.0, "ro:trunk": 100.0, "ru:living_street": 20.0, "ru:urban": 60.0, "ru:motorway": 110.0, "uk:nsl_single": 96.56,
    "uk:nsl_dual": 112.65, "uk:motorway": 112.65, "za:urban": 60.0, "za:rural": 100.0, "none": 140.0,
}
ANY_COUNTRY = {"urban": 50.0, "rural": 90.0, "trunk": 110.0, "motorway": 130.0}
SURFACES = {
    "cement": 80.0, "compacted": 80.0, "fine_gravel": 80.0, "paving_stones": 60.0, "metal": 60.0, "bricks": 60.0, "grass": 40.0, "wood": 40.0, "sett": 40.0, "grass_paver": 40.0,
    "gravel": 40.0, "unpaved": 40.0, "ground": 40.0, "dirt": 40.0, "pebblestone": 40.0, "tartan": 40.0, "cobblestone": 30.0, "clay": 30.0, "earth": 20.0, "stone": 20.0,
    "rocky": 20.0, "sand": 20.0, "mud": 10.0,
}
#: Agent type -> (priority, share of the allowed speed, own top km/h, share of the speed kept in turns, passes limits and traffic).
AGENT_TYPES = {
    "car_normal": (0, 0.92, None, 0.6, False), "car_patient": (0, 0.85, None, 0.7, False), "car_hurry": (0, 0.98, None, 0.5, False),
    "emergency": (20, 1.0, 90.0, 0.7, True), "truck": (0, 0.90, 70.0, 0.5, False),
}
TRACKS = {"grade1": 60.0, "grade2": 40.0, "grade3": 30.0, "grade4": 25.0, "grade5": 20.0}
SMOOTHNESS = {"intermediate": 80.0, "bad": 40.0, "very_bad": 20.0, "horrible": 10.0, "very_horrible": 5.0, "impassable": 0.0}
SERVICE_SHARE = {"alley": 0.5, "parking": 0.5, "parking_aisle": 0.5, "driveway": 0.5, "drive-through": 0.5, "drive-thru": 0.5}
AVOIDED = ["area", "reversible", "impassable", "hov_lanes", "steps", "construction", "proposed", "abandoned", "platform", "raceway", "razed"]
PROFILE_CLOSED = ["no", "agricultural", "forestry", "emergency", "psv", "customers", "private", "delivery", "destination"]
PROFILE_OPEN = ["yes", "motorcar", "motor_vehicle", "vehicle", "permissive", "designated", "hov"]
PASSABLE_BARRIERS = ["cattle_grid", "border_control", "toll_booth", "sally_port", "gate", "lift_gate", "no", "entrance", "height_restrictor", "arch"]


def pick(key: Column, table: dict, other) -> Column:
    """``table[key]`` as one CASE; ``other`` for keys that are not in it."""
    items = list(table.items())
    first = F.when(key == items[0][0], items[0][1])
    return reduce(lambda c, kv: c.when(key == kv[0], kv[1]), items[1:], first).otherwise(other)


def is_candidate(highway: Column, access: Column, barrier: Column) -> Column:
    """Drivable class, and neither access nor barrier closes it; missing tags pass."""
    return highway.isin(CANDIDATE_HIGHWAYS) & F.coalesce(~access.isin(CLOSED_ACCESS), F.lit(True)) & F.coalesce(~barrier.isin(CLOSED_BARRIERS), F.lit(True))


def lanes(tag: Column) -> Column:
    """Whole numbers only; else null."""
    return F.when(tag.rlike("^[0-9]+$"), tag.cast("int"))


def oneway_code(tag: Column) -> Column:
    return F.when(tag == "yes", 1).when(tag == "-1", -1).otherwise(0)


def z_layer(layer: Column, bridge: Column, tunnel: Column) -> Column:
    return F.coalesce(F.expr("NULL").cast("int") if layer is None else F.try_to_number(layer, F.lit("S999")).cast("int"), F.when(bridge.isNotNull(), 1).when(tunnel.isNotNull(), -1).otherwise(0))


def is_ground(layer: Column, bridge: Column, tunnel: Column) -> Column:
    return bridge.isNull() & tunnel.isNull() & (F.coalesce(layer, F.lit("0")) == "0")


def speed_limit(maxspeed: Column, highway: Column, legacy: bool = False) -> Column:
    default = pick(highway, SPEED_DEFAULTS_LEGACY, OTHER_SPEED_LEGACY) if legacy else pick(highway, SPEED_DEFAULTS, OTHER_SPEED)
    return F.when(maxspeed.rlike("^[0-9]+$"), maxspeed.cast("double")).otherwise(default)


def signed_speed(maxspeed: Column) -> Column:
    """Signed limit: a number, a country sign, or a sign of any country; null where none holds."""
    sign = F.lower(maxspeed)
    named = F.coalesce(pick(sign, SIGNS, None), pick(F.substring_index(sign, ":", -1), ANY_COUNTRY, None))
    limit = F.when(maxspeed.rlike("^[0-9]+$"), maxspeed.cast("double")).otherwise(named)
    return F.when(limit > 0, limit)


def profile_speed(highway: Column, maxspeed: Column, surface: Column, tracktype: Column, smoothness: Column, service: Column) -> Column:
    """Speed of the car profile: the signed limit or else the class speed, under the caps of the surroundings; null off the profile's classes."""
    own = pick(highway, PROFILE_KMH, None)
    capped = F.least(F.coalesce(signed_speed(maxspeed), own), pick(surface, SURFACES, None), pick(tracktype, TRACKS, None), pick(smoothness, SMOOTHNESS, None))  # least skips nulls
    return F.when(own.isNotNull(), capped * pick(service, SERVICE_SHARE, 1.0))


def profile_allows(highway: Column, access: Column, barrier: Column, tags: Column | None = None) -> Column:
    """Class of the profile; no tag that is avoided (``tags``: a map of the other tags; ``no`` denies a tag); access open or not closed; barrier passable. Missing tags pass."""
    entry = F.coalesce(access.isin(PROFILE_OPEN) | ~access.isin(PROFILE_CLOSED), F.lit(True))
    allowed = highway.isin(list(PROFILE_KMH)) & entry & F.coalesce(barrier.isin(PASSABLE_BARRIERS), F.lit(True))
    if tags is None:
        return allowed
    return allowed & ~F.coalesce(F.exists(F.map_entries(tags), lambda e: e["key"].isin(AVOIDED) & (e["value"] != "no")), F.lit(False))


def travel_seconds(length_m: Column, speed_kmh: Column, tolerance: float = TOLERANCE_KMH) -> Column:
    """Seconds at the limit plus the tolerated excess."""
    return length_m / F.greatest((speed_kmh + tolerance) / 3.6, F.lit(0.1))


def directed_costs(seconds: Column, oneway: Column) -> tuple[Column, Column]:
    """(cost, reverse_cost); -1 against a one-way street."""
    return F.when(oneway == -1, -1.0).otherwise(seconds), F.when(oneway == 1, -1.0).otherwise(seconds)


def capacity(length_m: Column, n_lanes: Column) -> Column:
    return F.rint(length_m / 5.0).cast("long") * n_lanes


def congestion(load: Column, cap: Column) -> Column:
    return F.when(cap > 0, load / cap).otherwise(0.0)


def congestion_band(ratio: Column) -> Column:
    return F.when(ratio < 0.5, "low").when(ratio < 0.8, "moderate").otherwise("high")


def effective_speed(limit: Column, ratio: Column, alpha: float = 0.7, beta: float = 1.5, least: float = 5.0) -> Column:
    """Speed under load: free below half load, then falling, a tenth when full."""
    return (
        F.when(ratio < 0.5, limit)
        .when(ratio < 1.0, F.greatest(F.lit(least), limit * (1.0 - alpha * F.pow(ratio, beta))))
        .otherwise(F.greatest(F.lit(least), limit * 0.1))
    )


def class_code(highway: Column) -> Column:
    return reduce(lambda c, kv: c.when(highway.isin(kv[1]), kv[0]), list(CLASS_CODES.items())[1:], F.when(highway.isin(CLASS_CODES[0]), 0)).otherwise(3)


def importance(highway: Column) -> Column:
    return pick(highway, IMPORTANCE, 0)


def priority_band(priority: Column) -> Column:
    return F.when(priority >= 20, "emergency").when(priority >= 10, "public").otherwise("normal")


def turn_share(angle: Column) -> Column:
    """Share of the speed kept in a turn of that angle."""
    a = F.abs(angle)
    return F.when(a <= 30, 1.0).when(a <= 60, 0.6).when(a <= 120, 0.4).when(a <= 150, 0.2).otherwise(0.1)


def driver_speed(limit: Column, mode: Column, margin: Column, cap: Column) -> Column:
    """Target speed of a driver (hurry, patient, else normal): a share of limit and margin, at most the vehicle's cap, which patient drivers use to nine tenths."""
    most = limit + margin
    return F.when(mode == "hurry", F.least(most, cap)).when(mode == "patient", F.least(most * 0.85, cap * 0.9)).otherwise(F.least(most * 0.92, cap))


def agent_speed(agent_type: Column, limit: Column, margin: Column, ratio: Column) -> tuple[Column, Column]:
    """(speed, speed in turns) of an agent type: its share of the limit under load and the margin, at most its own top speed.

    Emergency agents are not slowed by load, and their top speed holds on slower streets too. Null for other types.
    """
    of = lambda k: pick(agent_type, {n: v[k] for n, v in AGENT_TYPES.items()}, None)
    top, passes = pick(agent_type, {n: v[2] for n, v in AGENT_TYPES.items() if v[2] is not None}, None), of(4)
    allowed = F.when(passes, limit).otherwise(effective_speed(limit, ratio)) + margin
    target = F.when(passes, F.greatest(allowed, top)).otherwise(F.least(allowed, top)) * of(1)  # both skip nulls
    return target, target * of(3)


def turn_penalty(angle: Column, class_in: Column, speed_in: Column, speed_out: Column) -> Column:
    """Seconds that a manoeuvre takes beyond its arc at the speed of arrival.

    Brake to the cornering speed (2 m/s2), drive the arc, speed up (1.5 m/s2). The arc's radius
    is 50 m from roads of class 0 and 15 m from others; grip 0.6; speeds from 1 m/s, in the
    corner from 1.3 m/s. Over 150 degrees 15 s more.
    """
    v_in, v_out = F.greatest(speed_in / 3.6, F.lit(1.0)), F.greatest(speed_out / 3.6, F.lit(1.0))
    radius = F.when(class_in == 0, 50.0).otherwise(15.0)
    v = F.greatest(F.least(v_in, v_out, F.sqrt(radius * (0.6 * 9.81))), F.lit(1.3))
    arc = radius * F.radians(F.abs(angle))
    lost = (v_in - v) / 2.0 + arc / v + (v_out - v) / 1.5 - arc / v_in
    return F.greatest(lost, F.lit(0.0)) + F.when(F.abs(angle) > 150, 15.0).otherwise(0.0)


def k_magic(speed_kmh: Column, n_lanes: Column, seconds: Column) -> Column:
    """Fixed-point congestion factor (20 bits) from the free speed, tolerance included, the class's lanes and the free time; 10 where that is not above 0."""
    room = n_lanes * 150.0
    k = F.greatest(seconds, F.lit(1.0)) * ((speed_kmh + TOLERANCE_KMH) / 5.0 - 1.0) / (room * room) * (1 << 20)
    return F.when(k <= 0, F.lit(10).cast("long")).otherwise(F.floor(k).cast("long"))


def default_lanes(highway: Column) -> Column:
    return pick(highway, {k: v[1] for k, v in ROAD_DEFAULTS.items()}, OTHER_ROAD[1])


def volume_penalty(k: Column, volume: Column, base: Column) -> Column:
    """(k * volume^2) >> 20, at most ten times the base."""
    return F.least(F.shiftright(k * volume * volume, 20), base * 10)


def slot_of(seconds: Column) -> Column:
    """Absolute 300-second slot."""
    return F.floor(seconds / SLOT_S).cast("long")


def interpolated_penalty(k: Column, now: Column, after: Column, into: Column, base: Column) -> Column:
    """Penalty between two slots, ``into`` seconds into the first: k * volume^2 of both, interpolated (signed, floored), >> 20; at most ten times the base."""
    first, second = k * now * now, k * after * after
    between = first + F.floor((second - first) * into / SLOT_S).cast("long")
    return F.least(F.shiftright(between, 20), base * 10)


def speed_profile(progress: Column, target: Column, turn: Column) -> Column:
    """Speed on an edge: up from 0 over the first 5 %, down to 0 over the last 10 %; before a turn (``turn`` below 1) its share in place of the latter."""
    return F.when(progress < 0.05, target * progress / 0.05).when((progress > 0.9) & (turn < 1.0), target * turn).when(progress > 0.9, target * (1.0 - progress) / 0.1).otherwise(target)
