"""Geometry as column expressions: points are two columns, lines are arrays of (lon, lat) structs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius (m), Web-Mercator half width (m), metres of one degree used for shares along a line.
EARTH_M = 6371000.0
MERCATOR_M = 20037508.342789244
DEGREE_M = 111139.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(EARTH_M) * 2.0 * F.asin(F.sqrt(a))


def equirectangular_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(EARTH_M) * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2.0))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing, 0..360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def azimuth_deg(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar azimuth, 0..360; null for equal points."""
    az = F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + 360.0, F.lit(360.0))
    return F.when((x1 == x2) & (y1 == y2), None).otherwise(az)


def turn_angle(az_in: Column, az_out: Column) -> Column:
    """Signed turn, (-180, 180]."""
    d = az_out - az_in
    return F.when(d > 180.0, d - 360.0).when(d <= -180.0, d + 360.0).otherwise(d)


def turn_type(angle: Column, same_edge: Column) -> Column:
    """0 straight (up to 20 degrees), 1 right, 2 left, 3 U-turn (same edge, beyond 150)."""
    return F.when(same_edge & (F.abs(angle) > 150), 3).when(F.abs(angle) <= 20, 0).when(angle > 20, 1).otherwise(2)


def interpolate(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def project_share(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Share of segment a-b at the point nearest to p, clamped to 0..1; longitudes scaled by cos(lat of p)."""
    k = F.cos(F.radians(py))
    dx, dy = (bx - ax) * k, by - ay
    n = dx * dx + dy * dy
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * k * dx + (py - ay) * dy) / n)))


def segment_distance_deg(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of p to segment a-b in degrees of latitude."""
    t, k = project_share(px, py, ax, ay, bx, by), F.cos(F.radians(py))
    return F.sqrt(F.pow((ax + (bx - ax) * t - px) * k, 2.0) + F.pow(ay + (by - ay) * t - py, 2.0))


def grid_key(x: Column, size: float = 1e-5) -> Column:
    """Whole-number key of the grid line nearest to x."""
    return F.rint(x / size).cast("long")


def snap(x: Column, size: float = 1e-5) -> Column:
    return grid_key(x, size) * size


def cell(x: Column, size: float) -> Column:
    """Number of the cell of that size that holds x."""
    return F.floor(x / size).cast("long")


def mercator_x(lon: Column) -> Column:
    return lon * (MERCATOR_M / 180.0)


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan((lat + 90.0) * (math.pi / 360.0))) / (math.pi / 180.0) * (MERCATOR_M / 180.0)


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    r = F.radians(lat)
    return F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))


def tile_key(lon: Column, lat: Column) -> Column:
    """``lon_lat`` with two decimals."""
    return F.format_string("%.2f_%.2f", lon, lat)


def morton(x: Column, y: Column) -> Column:
    """Interleaved bits of two 16-bit numbers."""
    code = F.lit(0).cast("long")
    for i in range(16):
        code = code + F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i) + F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i + 1)
    return code


def unit16(v: Column, low: Column, high: Column) -> Column:
    """v as a 16-bit share of [low, high], clamped."""
    share = F.when(high > low, (v - low) / (high - low)).otherwise(0.0)
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * 65535.0).cast("long")


def boxes_meet(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two (min_x, min_y, max_x, max_y) boxes overlap or touch."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def covers(outer: tuple[Column, Column, Column, Column], inner: tuple[Column, Column, Column, Column]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def segment_meets_box(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Exact segment/box test: the boxes meet, and the corners of the box are not all on one side of the line."""
    sides = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx in (x0, x1) for cy in (y0, y1)]
    boxes = boxes_meet((F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)), (x0, y0, x1, y1))
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def line_wkt(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), F.concat_ws(", ", F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))), F.lit(")"))


def wkt_line(text: Column) -> Column:
    """LINESTRING text as an array of (lon, lat)."""
    inner = F.split(F.regexp_extract(text, r"^LINESTRING\s*\((.*)\)$", 1), r",\s*")
    return F.transform(inner, lambda p: F.struct(F.element_at(F.split(p, " "), 1).cast("double").alias("lon"), F.element_at(F.split(p, " "), 2).cast("double").alias("lat")))


def pairs(points: Column) -> Column:
    """Neighbouring points of a line as (a, b) structs."""
    return F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))


def line_length_m(points: Column) -> Column:
    return F.aggregate(pairs(points), F.lit(0.0), lambda s, p: s + haversine_m(p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"]))


def steps(lon1: Column, lat1: Column, lon2: Column, lat2: Column, longest_m: float = 50.0) -> Column:
    """Equal steps of at most ``longest_m`` that a segment is cut into; one at least."""
    return F.greatest(F.ceil(haversine_m(lon1, lat1, lon2, lat2) / longest_m), F.lit(1)).cast("long")


def subdivide(points: Column, most: int = 20) -> Column:
    """The line as lines of at most ``most`` points each (two at least); neighbours share a point."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1)), F.lit(most - 1))
    return F.transform(starts, lambda i: F.slice(points, i, F.lit(most)))


def segmentize(points: Column, longest_m: float = 50.0) -> Column:
    """The line with points added so that no step is longer than ``longest_m``."""

    def counted(p: Column) -> Column:
        n = steps(p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"], longest_m).cast("int")
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), n.alias("n"))

    def cut(p: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), p["n"] - 1),
            lambda k: F.struct(interpolate(p["a"]["lon"], p["b"]["lon"], k / p["n"]).alias("lon"), interpolate(p["a"]["lat"], p["b"]["lat"], k / p["n"]).alias("lat")),
        )

    # the number of parts is computed once a step, not once a part
    counts = F.transform(pairs(points), counted)
    return F.when(F.size(points) < 2, points).otherwise(F.concat(F.flatten(F.transform(counts, cut)), F.slice(points, F.size(points), F.lit(1))))


def clip_from(points: Column, lon: Column, lat: Column) -> Column:
    """The part of a line that lies ahead of a position: (at, line).

    ``at`` is the number of the nearest segment (the first one on ties, from 0); ``line`` begins
    at the position's projection on it and goes on with the vertices after it. Null for lines
    with fewer than two points.
    """
    measured = F.transform(
        pairs(points),
        lambda p, i: F.struct(
            F.round(segment_distance_deg(lon, lat, p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"]), 12).alias("d"), i.alias("i"),
            project_share(lon, lat, p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"]).alias("t"), p["a"].alias("a"), p["b"].alias("b"),
        ),
    )
    # bound once through a one-element array, so that the minimum is not searched for again in every use
    cut = F.transform(
        F.array(F.array_min(measured)),
        lambda m: F.struct(
            m["i"].alias("at"),
            F.concat(
                F.array(F.struct(interpolate(m["a"]["lon"], m["b"]["lon"], m["t"]).alias("lon"), interpolate(m["a"]["lat"], m["b"]["lat"], m["t"]).alias("lat"))),
                F.slice(points, m["i"] + 2, F.size(points)),
            ).alias("line"),
        ),
    )
    return F.when(F.size(points) >= 2, F.get(cut, F.lit(0)))
