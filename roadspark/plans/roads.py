"""Projections, filters and scalar functions over roads (inventory B and H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import geo, road
from roadspark.operators import mapping
from roadspark.plans.registry import query
from roadspark.sources.fixtures import Tables

c = F.col


@query("b01_candidate_roads", """
SELECT way_id, highway, access, barrier FROM w_way
WHERE highway IN ('motorway','motorway_link','trunk','trunk_link','primary','primary_link','secondary','secondary_link','tertiary','tertiary_link','unclassified','residential','living_street','service')
  AND (access IS NULL OR access NOT IN ('private','no','customers','delivery')) AND (barrier IS NULL OR barrier NOT IN ('gate','fence','wall','bollard','block'))""")
def candidate_roads(t: Tables) -> DataFrame:
    return t.w_way.filter(road.is_candidate(c("highway"), c("access"), c("barrier"))).select("way_id", "highway", "access", "barrier")


@query("b02_b06_tag_decode", """
SELECT way_id, access AS access_tag, barrier IS NOT NULL AS has_barrier,
       CASE WHEN regexp_matches(lanes, '^[0-9]+$') THEN CAST(lanes AS INTEGER) END AS lanes_n, coalesce(CASE WHEN regexp_matches(lanes, '^[0-9]+$') THEN CAST(lanes AS INTEGER) END, 1) AS lanes_used,
       CASE oneway WHEN 'yes' THEN 1 WHEN '-1' THEN -1 ELSE 0 END AS oneway_code,
       coalesce(try_cast(layer AS INTEGER), CASE WHEN bridge IS NOT NULL THEN 1 WHEN tunnel IS NOT NULL THEN -1 ELSE 0 END) AS z,
       bridge IS NULL AND tunnel IS NULL AND coalesce(layer, '0') = '0' AS ground FROM w_way""")
def tag_decode(t: Tables) -> DataFrame:
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), c(k).alias("v")) for k in ("access", "barrier", "lanes", "oneway", "layer", "bridge", "tunnel")]), lambda e: e["v"].isNotNull()))
    g = lambda k: F.element_at(c("tags"), k)
    n = road.lanes(g("lanes"))
    return t.w_way.select("way_id", tags.alias("tags")).select(
        "way_id", g("access").alias("access_tag"), F.map_contains_key("tags", "barrier").alias("has_barrier"), n.alias("lanes_n"), F.coalesce(n, F.lit(1)).alias("lanes_used"),
        road.oneway_code(g("oneway")).alias("oneway_code"), road.z_layer(g("layer"), g("bridge"), g("tunnel")).alias("z"), road.is_ground(g("layer"), g("bridge"), g("tunnel")).alias("ground"),
    )


@query("b07_speed_limit", """
SELECT way_id, CASE WHEN regexp_matches(maxspeed, '^[0-9]+$') THEN CAST(maxspeed AS DOUBLE)
         WHEN highway IN ('motorway', 'motorway_link', 'trunk', 'trunk_link') THEN 110e0 WHEN highway IN ('primary', 'primary_link', 'secondary', 'secondary_link') THEN 60e0
         WHEN highway IN ('tertiary', 'tertiary_link') THEN 50e0 WHEN highway IN ('residential', 'living_street', 'service', 'unclassified') THEN 20e0 ELSE 30e0 END AS limit_kmh,
       CASE WHEN regexp_matches(maxspeed, '^[0-9]+$') THEN CAST(maxspeed AS DOUBLE) WHEN highway IN ('motorway', 'motorway_link', 'trunk', 'trunk_link') THEN 110e0
         WHEN highway IN ('residential', 'living_street', 'service') THEN 20e0 ELSE 60e0 END AS limit_legacy FROM w_way""")
def speed_limits(t: Tables) -> DataFrame:
    return t.w_way.select("way_id", road.speed_limit(c("maxspeed"), c("highway")).alias("limit_kmh"), road.speed_limit(c("maxspeed"), c("highway"), legacy=True).alias("limit_legacy"))


def _values(table: dict) -> str:
    return ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in table.items())


def _words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SIGN_CASES = ["DE:rural", "de:motorway", "RU:urban", "FR:urban", "none", "XX:trunk", "walk"]
_SURFACE_CASES, _TRACK_CASES, _SMOOTH_CASES, _SERVICE_CASES = ["asphalt", "gravel", "mud", "cement"], ["grade1", "grade3"], ["good", "bad", "impassable"], ["alley", "crossover"]

#: Surroundings that the ways do not carry are dealt out by id; other country signs too.
_PROFILE_WAYS = f"""SELECT way_id, highway, access, barrier, CASE WHEN way_id % 3 = 0 THEN [{_words(_SIGN_CASES)}][way_id // 3 % {len(_SIGN_CASES)} + 1] ELSE maxspeed END AS sign,
  CASE WHEN way_id % 4 < 2 THEN [{_words(_SURFACE_CASES)}][way_id // 4 % 4 + 1] END AS surface, CASE WHEN way_id % 13 = 0 THEN [{_words(_TRACK_CASES)}][way_id // 13 % 2 + 1] END AS tracktype,
  CASE WHEN way_id % 11 = 0 THEN [{_words(_SMOOTH_CASES)}][way_id // 11 % 3 + 1] END AS smoothness, CASE WHEN highway = 'service' THEN [{_words(_SERVICE_CASES)}][way_id // 8 % 2 + 1] END AS service FROM w_way"""


@query("b08_car_profile_speed", f"""
WITH w AS ({_PROFILE_WAYS}), k(k, v) AS (VALUES {_values(road.PROFILE_KMH)}), g(k, v) AS (VALUES {_values(road.SIGNS)}), a(k, v) AS (VALUES {_values(road.ANY_COUNTRY)}),
 u(k, v) AS (VALUES {_values(road.SURFACES)}), r(k, v) AS (VALUES {_values(road.TRACKS)}), m(k, v) AS (VALUES {_values(road.SMOOTHNESS)}), f(k, v) AS (VALUES {_values(road.SERVICE_SHARE)}),
 s AS (SELECT w.*, k.v AS own, CASE WHEN regexp_matches(sign, '^[0-9]+$') THEN try_cast(sign AS DOUBLE) ELSE coalesce(g.v, a.v) END AS signed
       FROM w LEFT JOIN k ON k.k = highway LEFT JOIN g ON g.k = lower(sign) LEFT JOIN a ON a.k = list_last(string_split(lower(sign), ':')))
SELECT way_id, CASE WHEN own IS NOT NULL THEN least(CASE WHEN signed > 0 THEN signed ELSE own END, u.v, r.v, m.v) * coalesce(f.v, 1e0) END AS profile_kmh,
       own IS NOT NULL AND NOT (way_id % 29 = 0 OR way_id % 31 = 3) AND (access IS NULL OR access NOT IN ({_words(road.PROFILE_CLOSED)})) AND (barrier IS NULL OR barrier IN ({_words(road.PASSABLE_BARRIERS)})) AS allowed
FROM s LEFT JOIN u ON u.k = surface LEFT JOIN r ON r.k = tracktype LEFT JOIN m ON m.k = smoothness LEFT JOIN f ON f.k = service""")
def car_profile(t: Tables) -> DataFrame:
    """Class speed or signed speed (country signs decoded), capped by the surroundings; allowed roads."""
    one = lambda words, of: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(c("way_id") / of) % len(words) + 1).cast("int"))
    w, i = t.w_way, c("way_id")
    sign = F.when(i % 3 == 0, one(_SIGN_CASES, 3)).otherwise(c("maxspeed"))
    around = (F.when(i % 4 < 2, one(_SURFACE_CASES, 4)), F.when(i % 13 == 0, one(_TRACK_CASES, 13)), F.when(i % 11 == 0, one(_SMOOTH_CASES, 11)), F.when(c("highway") == "service", one(_SERVICE_CASES, 8)))
    # some ways carry tags that are avoided, and some deny one
    tags = F.when(i % 29 == 0, F.create_map(F.lit("area"), F.lit("yes"))).when(i % 31 == 3, F.create_map(F.lit("surface"), F.lit("gravel"), F.lit("construction"), F.lit("minor"))).when(i % 31 == 4, F.create_map(F.lit("area"), F.lit("no")))
    return w.select("way_id", road.profile_speed(c("highway"), sign, *around).alias("profile_kmh"), road.profile_allows(c("highway"), c("access"), c("barrier"), tags).alias("allowed"))


def costed(t: Tables) -> DataFrame:
    """Edges with length, speed, seconds, both costs, whole-second weight, lanes and capacity."""
    a = t.g_node.select(c("node_id").alias("source_id"), c("lon").alias("ax"), c("lat").alias("ay")).hint("merge")  # grows with the streets
    b = t.g_node.select(c("node_id").alias("target_id"), c("lon").alias("bx"), c("lat").alias("b_y")).hint("merge")
    e = t.g_edge.join(a, "source_id").join(b, "target_id")
    e = e.withColumn("length_m", geo.haversine_m(c("ax"), c("ay"), c("bx"), c("b_y"))).withColumn("speed", road.speed_limit(c("maxspeed"), c("highway")))
    e = e.withColumn("secs", road.travel_seconds(c("length_m"), c("speed")))
    cost, back = road.directed_costs(c("secs"), c("oneway"))
    return e.withColumns({"cost": cost, "reverse_cost": back, "w": F.greatest(F.round("secs").cast("long"), F.lit(1)), "n_lanes": F.coalesce("lanes", F.lit(1))})


@query("b10_b12_edge_costs", """
SELECT edge_id, round(length_m, 4) AS length_m, round(cost, 6) AS cost, round(reverse_cost, 6) AS reverse_cost,
       round(CASE WHEN oneway = -1 THEN -1e0 ELSE length_m / greatest(speed / 3.6e0, 1e-1) END, 6) AS cost_legacy,
       CAST(round_even(length_m / 5e0, 0) AS BIGINT) * coalesce(lanes, 1) AS capacity, round(length_m / (speed / 3.6e0), 6) AS base_seconds FROM g_cost""")
def edge_costs(t: Tables) -> DataFrame:
    e = costed(t)
    legacy = road.directed_costs(road.travel_seconds(c("length_m"), c("speed"), 0.0), c("oneway"))[0]
    return e.select(
        "edge_id", F.round("length_m", 4).alias("length_m"), F.round("cost", 6).alias("cost"), F.round("reverse_cost", 6).alias("reverse_cost"), F.round(legacy, 6).alias("cost_legacy"),
        road.capacity(c("length_m"), c("n_lanes")).alias("capacity"), F.round(c("length_m") / (c("speed") / 3.6), 6).alias("base_seconds"),
    )


_LOAD_SQL = """
SELECT edge_id, n, cap, ratio, CASE WHEN ratio < 0.5e0 THEN 'low' WHEN ratio < 0.8e0 THEN 'moderate' ELSE 'high' END AS band,
       round(CASE WHEN ratio < 0.5e0 THEN speed WHEN ratio < 1e0 THEN greatest(5e0, speed * (1e0 - 0.7e0 * power(ratio, 1.5e0))) ELSE greatest(5e0, speed * 0.1e0) END, 6) AS effective_kmh
FROM (SELECT g.edge_id, g.speed, coalesce(l.n, 0) AS n, CAST(round_even(length_m / 5e0, 0) AS BIGINT) * coalesce(lanes, 1) AS cap,
             CASE WHEN CAST(round_even(length_m / 5e0, 0) AS BIGINT) * coalesce(lanes, 1) > 0 THEN coalesce(l.n, 0) / (CAST(round_even(length_m / 5e0, 0) AS BIGINT) * coalesce(lanes, 1))::DOUBLE ELSE 0e0 END AS ratio
      FROM g_cost g LEFT JOIN (SELECT l_partkey * 10 + 2 AS edge_id, count(*) AS n FROM lineitem GROUP BY 1) l ON l.edge_id = g.edge_id) x"""


def loaded(t: Tables) -> DataFrame:
    """Edges with a load fed from outside, congestion ratio, band and effective speed."""
    load = t.lineitem.groupBy((c("l_partkey") * 10 + 2).alias("edge_id")).agg(F.count("*").alias("n"))
    e = costed(t).join(load, "edge_id", "left").select("edge_id", "speed", "length_m", F.coalesce("n", F.lit(0)).alias("n"), road.capacity(c("length_m"), c("n_lanes")).alias("cap"))
    e = e.withColumn("ratio", road.congestion(c("n"), c("cap")))
    return e.select("edge_id", "n", "cap", "ratio", road.congestion_band(c("ratio")).alias("band"), F.round(road.effective_speed(c("speed"), c("ratio")), 6).alias("effective_kmh"))


query("b13_b15_k06_congestion", _LOAD_SQL)(loaded)

query("d02_k07_congestion_stats", f"""
SELECT count(*) AS edges, count(*) FILTER (n > 0) AS loaded, count(*) FILTER (n > cap) AS over_capacity, round(avg(ratio), 6) AS avg_ratio, round(max(ratio), 6) AS max_ratio FROM ({_LOAD_SQL}) y""")(
    lambda t: loaded(t).agg(F.count("*").alias("edges"), F.count_if(c("n") > 0).alias("loaded"), F.count_if(c("n") > c("cap")).alias("over_capacity"), F.round(F.avg("ratio"), 6).alias("avg_ratio"), F.round(F.max("ratio"), 6).alias("max_ratio"))
)

BOX = (37.35, 55.46, 37.42, 55.5)


def in_box(t: Tables, keep: bool = True) -> DataFrame:
    box = tuple(F.lit(v) for v in BOX)
    inside = geo.boxes_meet((c("min_lon"), c("min_lat"), c("max_lon"), c("max_lat")), box)
    return t.w_box.filter(inside if keep else ~inside).select("way_id", c("n_points").cast("long").alias("n_points"))


_IN_BOX = "min_lon <= 37.42e0 AND max_lon >= 37.35e0 AND min_lat <= 55.5e0 AND max_lat >= 55.46e0"
query("b16_bbox_filter", f"SELECT way_id, n_points FROM w_box WHERE {_IN_BOX}")(in_box)
query("b17_bbox_delete", f"SELECT way_id, n_points FROM w_box WHERE NOT ({_IN_BOX})")(lambda t: in_box(t, False))


@query("b16_exact_box_test", """
SELECT edge_id FROM (SELECT edge_id, ax, ay, bx, b_y, 37.351e0 AS x0, 55.461e0 AS y0, 37.4193e0 AS x1, 55.4987e0 AS y1 FROM g_cost) q
WHERE least(ax, bx) <= x1 AND greatest(ax, bx) >= x0 AND least(ay, b_y) <= y1 AND greatest(ay, b_y) >= y0
  AND least((bx-ax)*(y0-ay)-(b_y-ay)*(x0-ax), (bx-ax)*(y1-ay)-(b_y-ay)*(x0-ax), (bx-ax)*(y0-ay)-(b_y-ay)*(x1-ax), (bx-ax)*(y1-ay)-(b_y-ay)*(x1-ax)) <= 0
  AND greatest((bx-ax)*(y0-ay)-(b_y-ay)*(x0-ax), (bx-ax)*(y1-ay)-(b_y-ay)*(x0-ax), (bx-ax)*(y0-ay)-(b_y-ay)*(x1-ax), (bx-ax)*(y1-ay)-(b_y-ay)*(x1-ax)) >= 0""")
def exact_box(t: Tables) -> DataFrame:
    return costed(t).filter(geo.segment_meets_box(c("ax"), c("ay"), c("bx"), c("b_y"), F.lit(37.351), F.lit(55.461), F.lit(37.4193), F.lit(55.4987))).select("edge_id")


ZOOMS = [5, 10, 12, 16, 24, 30]


@query("b18_f01_zoom_lod", f"""
WITH z(zoom) AS (VALUES {", ".join(f"({z}::BIGINT)" for z in ZOOMS)}), l(low, high, classes) AS (VALUES {", ".join(f"({a}, {b}, [{_words(k)}])" for a, b, k in road.LOD)}),
 s AS (SELECT zoom, classes FROM z JOIN l ON (zoom >= low AND zoom < high) OR (zoom >= high AND high = (SELECT max(high) FROM l)))
SELECT zoom, way_id, CASE highway WHEN 'motorway' THEN 10 WHEN 'trunk' THEN 9 WHEN 'primary' THEN 8 WHEN 'secondary' THEN 7 WHEN 'tertiary' THEN 6 WHEN 'unclassified' THEN 5 WHEN 'residential' THEN 4
         WHEN 'service' THEN 3 WHEN 'track' THEN 2 WHEN 'path' THEN 1 WHEN 'footway' THEN 1 ELSE 0 END AS importance
FROM w_way JOIN s ON list_contains(classes, highway) OR list_contains(classes, 'ALL')""")
def zoom_lod(t: Tables) -> DataFrame:
    """Classes shown at a zoom, with the last layer beyond its end; rows rank by importance."""
    spark = t.w_way.sparkSession
    lod = spark.createDataFrame(road.LOD, "low int, high int, classes array<string>")
    last = max(high for _, high, _ in road.LOD)
    within = (c("zoom") >= c("low")) & ((c("zoom") < c("high")) | (c("high") == last))
    zooms = spark.createDataFrame([(z,) for z in ZOOMS], "zoom long").join(F.broadcast(lod), within)
    ways = t.w_way.join(F.broadcast(zooms), F.array_contains("classes", c("highway")) | F.array_contains("classes", F.lit("ALL")))  # one row a zoom
    return ways.select("zoom", "way_id", road.importance(c("highway")).alias("importance"))


@query("b19_b20_h18_tiles", """
SELECT event_id, z, x, y, (z BETWEEN 0 AND 18 AND x >= 0 AND y >= 0 AND x < power(2e0, z) AND y < power(2e0, z)) AS valid,
       round(x / power(2e0, z) * 360e0 - 180e0, 6) AS west, round(degrees(atan(sinh(pi() * (1e0 - 2e0 * y / power(2e0, z))))), 6) AS north,
       round(greatest(lon - 3e-2, 37.35e0), 6) AS clip_w, round(least(lon + 3e-2, 37.42e0), 6) AS clip_e, greatest(lon - 3e-2, 37.35e0) < least(lon + 3e-2, 37.42e0) AS clip_valid,
       lon - 3e-2 < 37.35e0 OR lon + 3e-2 > 37.42e0 AS was_clipped
FROM (SELECT event_id, lon, lat, event_id % 20 AS z, CAST(floor((lon + 180e0) / 360e0 * power(2e0, event_id % 20)) AS BIGINT) AS x,
             CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * power(2e0, event_id % 20)) AS BIGINT) AS y FROM e_fix) q""")
def tiles(t: Tables) -> DataFrame:
    z = c("event_id") % 20
    f = t.e_fix.select("event_id", "lon", z.alias("z"), geo.tile_x(c("lon"), z).alias("x"), geo.tile_y(c("lat"), z).alias("y"))
    side = F.pow(F.lit(2.0), c("z"))
    w, e = F.greatest(c("lon") - 0.03, F.lit(37.35)), F.least(c("lon") + 0.03, F.lit(37.42))
    return f.select(
        "event_id", "z", "x", "y", (c("z").between(0, 18) & (c("x") >= 0) & (c("y") >= 0) & (c("x") < side) & (c("y") < side)).alias("valid"),
        F.round(geo.tile_lon(c("x"), c("z")), 6).alias("west"), F.round(geo.tile_lat(c("y"), c("z")), 6).alias("north"),
        F.round(w, 6).alias("clip_w"), F.round(e, 6).alias("clip_e"), (w < e).alias("clip_valid"), ((c("lon") - 0.03 < 37.35) | (c("lon") + 0.03 > 37.42)).alias("was_clipped"),
    )


@query("b21_cached_regions", "SELECT DISTINCT w.way_id FROM w_way w WHERE EXISTS (SELECT 1 FROM e_tile_event e WHERE e.tile_no = w.way_id AND e.status = 'complete')")
def cached(t: Tables) -> DataFrame:
    done = t.e_tile_event.filter("status = 'complete'").select(c("tile_no").alias("way_id"))
    return t.w_way.select("way_id").join(done, "way_id", "left_semi")


@query("b22_b23_road_class", f"""
WITH r(k, kmh, n, turn_right, straight_on, turn_left, turn_round) AS (VALUES {", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in road.ROAD_DEFAULTS.items())})
SELECT way_id, CASE WHEN highway IN ('motorway', 'trunk', 'motorway_link') THEN 0 WHEN highway IN ('primary', 'secondary', 'primary_link') THEN 1 WHEN highway IN ('tertiary', 'tertiary_link') THEN 2 ELSE 3 END AS class_code,
       coalesce(kmh, 30) AS default_kmh, coalesce(n, 1) AS default_lanes, coalesce(turn_right, 1) AS turn_right, coalesce(straight_on, 0) AS straight_on, coalesce(turn_left, 3) AS turn_left, coalesce(turn_round, 20) AS turn_round
FROM w_way LEFT JOIN r ON r.k = highway""")
def road_class(t: Tables) -> DataFrame:
    names = ["default_kmh", "default_lanes", "turn_right", "straight_on", "turn_left", "turn_round"]
    table = t.w_way.sparkSession.createDataFrame([(k, *v) for k, v in road.ROAD_DEFAULTS.items()], "highway string, " + ", ".join(f"{n} int" for n in names))
    ways = t.w_way.join(F.broadcast(table), "highway", "left")  # a table of fixed size
    return ways.select("way_id", road.class_code(c("highway")).alias("class_code"), *[F.coalesce(n, F.lit(v)).alias(n) for n, v in zip(names, road.OTHER_ROAD)])


@query("b24_b26_b28_driver_speed", """
SELECT event_id, mode, CASE WHEN pr >= 20 THEN 'emergency' WHEN pr >= 10 THEN 'public' ELSE 'normal' END AS band, pr < 20 AS sees_congestion,
       round(CASE mode WHEN 'hurry' THEN least(60e0 + margin, cap) WHEN 'patient' THEN least((60e0 + margin) * 0.85e0, cap * 0.9e0) ELSE least((60e0 + margin) * 0.92e0, cap) END, 6) AS target_kmh,
       CASE WHEN abs(angle) <= 30 THEN 1e0 WHEN abs(angle) <= 60 THEN 0.6e0 WHEN abs(angle) <= 120 THEN 0.4e0 WHEN abs(angle) <= 150 THEN 0.2e0 ELSE 0.1e0 END AS turn_share
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'patient' WHEN 1 THEN 'normal' ELSE 'hurry' END AS mode, CASE event_id % 5 WHEN 0 THEN 70e0 WHEN 1 THEN 90e0 ELSE 110e0 END AS cap, event_id % 30 AS pr, event_id % 361 - 180 AS angle,
             CASE event_id % 3 WHEN 0 THEN 19e0 WHEN 1 THEN 9e0 ELSE 60e0 * 0.1e0 END AS margin FROM events) q""")
def drivers(t: Tables) -> DataFrame:
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c("event_id") % n + 1).cast("int"))
    margins = t.events.sparkSession.createDataFrame([(0, 19.0, 0.0), (1, 9.0, 0.0), (2, 0.0, 0.1)], "region int, absolute double, share double")
    e = t.events.select("event_id", (c("event_id") % 3).cast("int").alias("region"), pick(4, "patient", "normal", "hurry", "hurry").alias("mode"), pick(5, 70.0, 90.0, 110.0, 110.0, 110.0).alias("cap"), (c("event_id") % 30).alias("pr"), (c("event_id") % 361 - 180).alias("angle"))
    e = e.join(F.broadcast(margins), "region").withColumn("margin", c("absolute") + c("share") * 60.0)
    return e.select(
        "event_id", "mode", road.priority_band(c("pr")).alias("band"), (c("pr") < 20).alias("sees_congestion"),
        F.round(road.driver_speed(F.lit(60.0), c("mode"), c("margin"), c("cap")), 6).alias("target_kmh"), road.turn_share(c("angle")).alias("turn_share"),
    )


AGENTS = list(road.AGENT_TYPES)
_AGENTS = ", ".join(f"({i}, '{k}', {p}, {share}e0, {'NULL' if top is None else top}, {turn}e0, {passes})" for i, (k, (p, share, top, turn, passes)) in enumerate(road.AGENT_TYPES.items()))


@query("b25_agent_speed", f"""
WITH y(i, agent_type, priority, share, top, turn, passes) AS (VALUES {_AGENTS}),
 q AS (SELECT event_id, user_id % 5 AS i, CASE event_id % 4 WHEN 0 THEN 40e0 WHEN 1 THEN 60e0 WHEN 2 THEN 90e0 ELSE 110e0 END AS kmh, (event_id % 13) / 10e0 AS ratio, event_id % 3 AS region FROM events),
 a AS (SELECT q.*, y.*, CASE WHEN passes OR ratio < 0.5e0 THEN kmh WHEN ratio < 1 THEN greatest(5e0, kmh * (1e0 - 0.7e0 * power(ratio, 1.5e0))) ELSE greatest(5e0, kmh * 0.1e0) END + CASE region WHEN 0 THEN 19e0 WHEN 1 THEN 9e0 ELSE kmh * 0.1e0 END AS allowed FROM q JOIN y ON y.i = q.i)
SELECT event_id, agent_type, CASE WHEN priority >= 20 THEN 'emergency' WHEN priority >= 10 THEN 'public' ELSE 'normal' END AS band,
       round(CASE WHEN passes THEN greatest(allowed, top) ELSE least(allowed, top) END * share, 6) AS target_kmh, round(CASE WHEN passes THEN greatest(allowed, top) ELSE least(allowed, top) END * share * turn, 6) AS turn_kmh FROM a""")
def agents(t: Tables) -> DataFrame:
    """Target speeds by agent type, with margins by region, under load."""
    kind = F.element_at(F.array(*[F.lit(k) for k in AGENTS]), (c("user_id") % len(AGENTS) + 1).cast("int"))
    kmh = F.element_at(F.array(*[F.lit(v) for v in (40.0, 60.0, 90.0, 110.0)]), (c("event_id") % 4 + 1).cast("int"))
    e = t.events.select("event_id", kind.alias("agent_type"), kmh.alias("kmh"), ((c("event_id") % 13) / 10.0).alias("ratio"), (c("event_id") % 3).alias("region"))
    margin = F.when(c("region") == 0, 19.0).when(c("region") == 1, 9.0).otherwise(c("kmh") * 0.1)
    target, turn = road.agent_speed(c("agent_type"), c("kmh"), margin, c("ratio"))
    priority = road.pick(c("agent_type"), {k: v[0] for k, v in road.AGENT_TYPES.items()}, 0)
    return e.select("event_id", "agent_type", road.priority_band(priority).alias("band"), F.round(target, 6).alias("target_kmh"), F.round(turn, 6).alias("turn_kmh"))


@query("b27_g03_legal_directions", "SELECT edge_id, s, t, w FROM g_arc")
def arcs(t: Tables) -> DataFrame:
    """Directed arcs: forward where cost > 0, backward where reverse_cost > 0."""
    e = costed(t)
    forward = e.filter("cost > 0").select("edge_id", c("source_id").alias("s"), c("target_id").alias("t"), "w")
    return forward.union(e.filter("reverse_cost > 0").select("edge_id", "target_id", "source_id", "w"))


@query("b29_constraint_report", """
SELECT count(*) FILTER (lat NOT BETWEEN 55.46e0 AND 90e0 OR lon NOT BETWEEN -180e0 AND 180e0) AS bad_position, count(*) FILTER (NOT length_m > 0) AS bad_length, count(*) FILTER (NOT speed > 25) AS bad_speed,
       count(*) FILTER (lanes IS NULL OR lanes <= 0) AS bad_lanes, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) x) AS repeated_keys
FROM (SELECT ay AS lat, ax AS lon, length_m, speed, lanes FROM g_cost) y""")
def constraints(t: Tables) -> DataFrame:
    e = costed(t).agg(
        F.count_if(~c("ay").between(55.46, 90.0) | ~c("ax").between(-180.0, 180.0)).alias("bad_position"), F.count_if(~(c("length_m") > 0)).alias("bad_length"),
        F.count_if(~(c("speed") > 25)).alias("bad_speed"), F.count_if(c("lanes").isNull() | (c("lanes") <= 0)).alias("bad_lanes"),
    )
    repeated = t.lineitem.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").agg(F.count("*").alias("repeated_keys"))
    return e.crossJoin(repeated)  # one row each


_HAV = "6371000e0 * 2e0 * asin(sqrt(power(sin(radians(y2 - y1) / 2e0), 2e0) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2e0), 2e0)))"


def hops(t: Tables) -> DataFrame:
    """Neighbouring vertices of ways."""
    w = Window.partitionBy("way_id").orderBy("seq")
    return t.w_vertex.select("way_id", "seq", c("lon").alias("x1"), c("lat").alias("y1"), F.lead("lon").over(w).alias("x2"), F.lead("lat").over(w).alias("y2")).filter("x2 IS NOT NULL")


_HOPS = "(SELECT * FROM (SELECT way_id, seq, lon AS x1, lat AS y1, lead(lon) OVER (PARTITION BY way_id ORDER BY seq) AS x2, lead(lat) OVER (PARTITION BY way_id ORDER BY seq) AS y2 FROM w_vertex) q WHERE x2 IS NOT NULL) h"


@query("h01_h05_distances", f"""
SELECT way_id, seq, round({_HAV}, 4) AS metres, round(6371000e0 * sqrt(power(radians(x2 - x1) * cos(radians((y1 + y2) / 2e0)), 2e0) + power(radians(y2 - y1), 2e0)), 4) AS flat_metres,
       CASE WHEN x1 = x2 AND y1 = y2 THEN NULL ELSE round((degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 360e0) % 360e0, 4) END AS bearing,
       CASE WHEN x1 = x2 AND y1 = y2 THEN NULL ELSE round((degrees(atan2(x2 - x1, y2 - y1)) + 360e0) % 360e0, 4) END AS azimuth FROM {_HOPS}""")
def distances(t: Tables) -> DataFrame:
    p = [c(k) for k in ("x1", "y1", "x2", "y2")]
    same = (c("x1") == c("x2")) & (c("y1") == c("y2"))
    return hops(t).select(
        "way_id", "seq", F.round(geo.haversine_m(*p), 4).alias("metres"), F.round(geo.equirectangular_m(*p), 4).alias("flat_metres"),
        F.when(~same, F.round(geo.bearing_deg(*p), 4)).alias("bearing"), F.round(geo.azimuth_deg(*p), 4).alias("azimuth"),
    )


@query("h08_h10_project_point", """
SELECT event_id, round(t, 6) AS share, round(37.36e0 + (37.43e0 - 37.36e0) * t, 6) AS plon, round(55.46e0 + (55.59e0 - 55.46e0) * t, 6) AS plat
FROM (SELECT event_id, least(1e0, greatest(0e0, ((lon - 37.36e0) * cos(radians(lat)) * (37.43e0 - 37.36e0) * cos(radians(lat)) + (lat - 55.46e0) * (55.59e0 - 55.46e0))
      / (power((37.43e0 - 37.36e0) * cos(radians(lat)), 2e0) + power(55.59e0 - 55.46e0, 2e0)))) AS t FROM e_fix) q""")
def project(t: Tables) -> DataFrame:
    ax, ay, bx, by = (F.lit(v) for v in (37.36, 55.46, 37.43, 55.59))
    f = t.e_fix.select("event_id", geo.project_share(c("lon"), c("lat"), ax, ay, bx, by).alias("t"))
    return f.select("event_id", F.round("t", 6).alias("share"), F.round(geo.interpolate(ax, bx, c("t")), 6).alias("plon"), F.round(geo.interpolate(ay, by, c("t")), 6).alias("plat"))


@query("h13_h20_h21_grid_keys", """
SELECT node_id, kx, ky, cx, cy, format('{:.2f}_{:.2f}', cx * 5e-2, cy * 5e-2) AS tile_key, m::BIGINT AS morton,
       round(mx, 3) AS merc_x, round(my, 3) AS merc_y
FROM (SELECT node_id, CAST(round_even(lon / 1e-5, 0) AS BIGINT) AS kx, CAST(round_even(lat / 1e-5, 0) AS BIGINT) AS ky, CAST(floor(lon / 5e-2) AS BIGINT) AS cx, CAST(floor(lat / 5e-2) AS BIGINT) AS cy,
      lon * (20037508.342789244e0 / 180e0) AS mx, ln(tan((lat + 90e0) * (pi() / 360e0))) / (pi() / 180e0) * (20037508.342789244e0 / 180e0) AS my,
      list_sum(list_transform(range(16), lambda i: (((ux >> i) & 1) << (2 * i)) + (((uy >> i) & 1) << (2 * i + 1)))) AS m
      FROM (SELECT *, CAST(floor(least(1e0, greatest(0e0, (lon - 37.3e0) / (37.5e0 - 37.3e0))) * 65535e0) AS BIGINT) AS ux, CAST(floor(least(1e0, greatest(0e0, (lat - 55.45e0) / (55.95e0 - 55.45e0))) * 65535e0) AS BIGINT) AS uy FROM g_node) n) q""")
def grid_keys(t: Tables) -> DataFrame:
    ux, uy = geo.unit16(c("lon"), F.lit(37.3), F.lit(37.5)), geo.unit16(c("lat"), F.lit(55.45), F.lit(55.95))
    n = t.g_node.select("node_id", "lon", "lat", geo.cell(c("lon"), 0.05).alias("cx"), geo.cell(c("lat"), 0.05).alias("cy"), ux.alias("ux"), uy.alias("uy"))
    return n.select(
        "node_id", geo.grid_key(c("lon")).alias("kx"), geo.grid_key(c("lat")).alias("ky"), "cx", "cy", geo.tile_key(c("cx") * 0.05, c("cy") * 0.05).alias("tile_key"),
        geo.morton(c("ux"), c("uy")).alias("morton"), F.round(geo.mercator_x(c("lon")), 3).alias("merc_x"), F.round(geo.mercator_y(c("lat")), 3).alias("merc_y"),
    )


def lines(t: Tables) -> DataFrame:
    """Vertices of a way gathered in order."""
    return t.w_vertex.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


@query("h03_h12_h15_h16_lines", f"""
WITH l AS (SELECT way_id, count(*) AS n, round(arg_min(lon, seq), 6) AS first_lon, round(arg_max(lon, seq), 6) AS last_lon, round(avg(lon), 6) AS mid_lon, round(avg(lat), 6) AS mid_lat,
             round(arg_max(lat, seq), 6) AS reversed_first_lat FROM w_vertex GROUP BY way_id),
     m AS (SELECT way_id, sum({_HAV}) AS len, sum(greatest(ceil({_HAV} / 50e0), 1)) AS parts FROM {_HOPS} GROUP BY way_id)
SELECT l.*, round(coalesce(m.len, 0), 3) AS length_m, CAST(coalesce(m.parts, 0) + 1 AS BIGINT) AS n_segmentized FROM l LEFT JOIN m ON m.way_id = l.way_id""")
def line_functions(t: Tables) -> DataFrame:
    """Ends, means, length and points at steps of 50 m: one window and one aggregate over the vertices, dealt by way once. The array forms are in functions/geo.py."""
    along = Window.partitionBy("way_id").orderBy("seq")
    v = t.w_vertex.select("way_id", "seq", "lon", "lat", F.lead("lon").over(along).alias("x"), F.lead("lat").over(along).alias("y"))
    hop = lambda f: F.coalesce(F.sum(F.when(c("x").isNotNull(), f(c("lon"), c("lat"), c("x"), c("y")))), F.lit(0))
    return v.groupBy("way_id").agg(
        F.count("*").alias("n"), F.round(F.min_by("lon", "seq"), 6).alias("first_lon"), F.round(F.max_by("lon", "seq"), 6).alias("last_lon"), F.round(F.avg("lon"), 6).alias("mid_lon"), F.round(F.avg("lat"), 6).alias("mid_lat"),
        F.round(F.max_by("lat", "seq"), 6).alias("reversed_first_lat"), F.round(hop(geo.haversine_m), 3).alias("length_m"), (hop(geo.steps) + 1).cast("long").alias("n_segmentized"),
    )


@query("h14_line_parts", f"""
WITH h AS (SELECT way_id, x1, y1, x2, y2, n, CAST(sum(n) OVER (PARTITION BY way_id ORDER BY seq) - n AS BIGINT) AS before FROM (SELECT h.*, CAST(greatest(ceil({_HAV} / 50e0), 1) AS BIGINT) AS n FROM {_HOPS}) q),
 p AS (SELECT way_id, total, unnest(range(0, total, 19)) AS i FROM (SELECT way_id, CAST(sum(n) AS BIGINT) AS total FROM h GROUP BY way_id) s)
SELECT p.way_id, i // 19 AS part, least(20, total - i + 1) AS n_points, round(x1 + (x2 - x1) * ((i - before) / CAST(n AS DOUBLE)) + 1e-9, 6) AS lon, round(y1 + (y2 - y1) * ((i - before) / CAST(n AS DOUBLE)) + 1e-9, 6) AS lat
FROM p JOIN h ON h.way_id = p.way_id AND i >= before AND i < before + n""")
def parts_of_lines(t: Tables) -> DataFrame:
    """Lines at steps of 50 m, in parts of at most 20 points. On a lattice many points lie half-way between two last digits; a billionth moves them off."""
    return mapping.line_parts(hops(t)).select("way_id", "part", "n_points", F.round(c("lon") + 1e-9, 6).alias("lon"), F.round(c("lat") + 1e-9, 6).alias("lat"))


@query("h31_wkt", "SELECT way_id, count(*) AS n, count(*) AS n_read, round(min(lon), 6) AS min_lon FROM w_vertex GROUP BY way_id")
def wkt(t: Tables) -> DataFrame:
    back = lines(t).select("way_id", F.size("line").cast("long").alias("n"), geo.wkt_line(geo.line_wkt(c("line"))).alias("read"))
    return back.select("way_id", "n", F.size("read").cast("long").alias("n_read"), F.round(F.array_min(F.transform("read", lambda p: p["lon"])), 6).alias("min_lon"))


_LANES = "CASE highway WHEN 'motorway' THEN 2 WHEN 'primary' THEN 2 ELSE 1 END * 150e0"
K_MAGIC = f"CASE WHEN greatest(secs, 1e0) * ((speed + 19e0) / 5e0 - 1e0) <= 0 THEN 10 ELSE CAST(floor(greatest(secs, 1e0) * ((speed + 19e0) / 5e0 - 1e0) / ({_LANES} * {_LANES}) * 1048576e0) AS BIGINT) END"


@query("h22_h25_factors", f"""
SELECT edge_id, k_magic, least((k_magic * v * v) >> 20, w * 10) AS penalty,
  round(CASE WHEN p < 0.05e0 THEN speed * p / 0.05e0 WHEN p > 0.9e0 AND turn < 1 THEN speed * turn WHEN p > 0.9e0 THEN speed * (1e0 - p) / 0.1e0 ELSE speed END, 6) AS profile_kmh
FROM (SELECT edge_id, w, speed, edge_id % 50 AS v, (edge_id % 100) / 100e0 AS p, CASE WHEN edge_id % 3 = 0 THEN 0.4e0 ELSE 1e0 END AS turn, {K_MAGIC} AS k_magic FROM g_cost) q""")
def factors(t: Tables) -> DataFrame:
    e = costed(t).withColumn("k_magic", road.k_magic(c("speed"), road.default_lanes(c("highway")), c("secs")))
    turn = F.when(c("edge_id") % 3 == 0, 0.4).otherwise(1.0)
    return e.select(
        "edge_id", "k_magic", road.volume_penalty(c("k_magic"), c("edge_id") % 50, c("w")).alias("penalty"),
        F.round(road.speed_profile((c("edge_id") % 100) / 100.0, c("speed"), turn), 6).alias("profile_kmh"),
    )


@query("h29_n03_route_rows", """
SELECT event_id, round(r, 6) AS route_km, CASE WHEN e > 0 AND success = 1 THEN round(r / e, 6) ELSE 0e0 END AS tortuosity, CASE WHEN r > 0 AND success = 1 THEN round(duration_ms / r, 6) ELSE 0e0 END AS sei_ms_km,
       round(num_waypoints * k * e, 6) AS complexity, error_type
FROM (SELECT *, e_dist_km AS e, e_dist_km * (1e0 + (event_id % 7) / 10e0) AS r FROM e_request) q""")
def route_rows(t: Tables) -> DataFrame:
    q = t.e_request.withColumn("r", c("e_dist_km") * (1.0 + (c("event_id") % 7) / 10.0))
    ok = c("success") == 1
    return q.select(
        "event_id", F.round("r", 6).alias("route_km"), F.when((c("e_dist_km") > 0) & ok, F.round(c("r") / c("e_dist_km"), 6)).otherwise(0.0).alias("tortuosity"),
        F.when((c("r") > 0) & ok, F.round(c("duration_ms") / c("r"), 6)).otherwise(0.0).alias("sei_ms_km"), F.round(c("num_waypoints") * c("k") * c("e_dist_km"), 6).alias("complexity"), "error_type",
    )
