"""Traffic, trajectories, tiles, sources and streams' batch twins (inventory A, C, J, K, L, M, O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import geo, road
from roadspark.operators import alternatives, graph, mapping, tables, traffic
from roadspark.plans.network import REQUESTS, _ROOT, requests, root
from roadspark.plans.registry import query
from roadspark.plans.roads import arcs, costed, lines
from roadspark.sources import osm
from roadspark.sources.fixtures import Tables

c = F.col
sec = traffic.epoch_s


# ----------------------------------------------------------------- K: volumes
def volumes(t: Tables) -> DataFrame:
    return traffic.book(t.e_booking.select("node_id", sec("ts").alias("seconds"), "delta"))


_VOL = "SELECT node_id, CAST(floor(epoch(ts) / 300e0) AS BIGINT) AS slot, CAST(greatest(sum(delta), 0) AS BIGINT) AS volume FROM e_booking GROUP BY ALL"
query("k01_k02_volumes", _VOL)(volumes)


@query("k03_advance_clock", f"""
SELECT node_id, slot, volume, slot % 24 AS ring FROM ({_VOL}) v WHERE slot >= (SELECT CAST(floor(max(epoch(ts)) / 300e0) AS BIGINT) - 100 FROM e_booking)""")
def advance(t: Tables) -> DataFrame:
    now = t.e_booking.agg((road.slot_of(F.max(sec("ts"))) - 100).alias("now"))
    v = volumes(t).crossJoin(F.broadcast(now))  # one row
    return traffic.advance(v, c("now")).select("node_id", "slot", "volume", "ring")


@query("k05_h26_penalties", f"""
WITH v AS (SELECT node_id, slot, volume * 40 AS volume FROM ({_VOL}) z)
SELECT event_id, least((p0 + CAST(floor((p1 - p0) * into_s / 300e0) AS BIGINT)) >> 20, 1000) AS penalty FROM (
  SELECT b.event_id, into_s, 100000 * coalesce(v0.volume, 0) * coalesce(v0.volume, 0) AS p0, 100000 * coalesce(v1.volume, 0) * coalesce(v1.volume, 0) AS p1
  FROM (SELECT event_id, node_id, CAST(floor(epoch(ts)) AS BIGINT) // 300 AS slot, CAST(floor(epoch(ts)) AS BIGINT) % 300 AS into_s FROM e_booking) b
  LEFT JOIN v v0 ON v0.node_id = b.node_id AND v0.slot = b.slot LEFT JOIN v v1 ON v1.node_id = b.node_id AND v1.slot = b.slot + 1) x""")
def penalties(t: Tables) -> DataFrame:
    """Penalty of each booking's node at its time, with 40 vehicles to a booking."""
    v = volumes(t).withColumn("volume", c("volume") * 40)
    visits = t.e_booking.select("event_id", "node_id", F.floor(sec("ts")).cast("long").alias("at"), F.lit(100000).cast("long").alias("k_magic"))
    return traffic.with_penalty(visits, v, F.lit(100)).select("event_id", "penalty")


@query("k08_reroute_candidates", """
WITH l AS (SELECT l_partkey AS edge, count(*) / 40e0 AS load FROM lineitem GROUP BY 1)
SELECT way_id, round(max(load), 4) AS worst FROM w_node w JOIN l ON l.edge = w.node_id WHERE seq <= 3 GROUP BY way_id HAVING round(max(load), 4) > 0.8e0""")
def reroute(t: Tables) -> DataFrame:
    """Agents whose next three edges hold one beyond 0.8 of its load."""
    load = t.lineitem.groupBy(c("l_partkey").alias("edge")).agg((F.count("*") / 40.0).alias("load"))
    ahead = t.w_node.filter("seq <= 3").select("way_id", c("node_id").alias("edge")).join(load, "edge")
    return ahead.groupBy("way_id").agg(F.round(F.max("load"), 4).alias("worst")).filter("worst > 0.8")


# -------------------------------------------------------------- L: trajectories
_STEPS = """(SELECT *, 6371000e0 * 2e0 * asin(sqrt(power(sin(radians(lat - lat0) / 2e0), 2e0) + cos(radians(lat0)) * cos(radians(lat)) * power(sin(radians(lon - lon0) / 2e0), 2e0))) AS metres, sec - sec0 AS dt
FROM (SELECT *, epoch(ts) AS sec, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(epoch(ts)) OVER w AS sec0, lag(is_running) OVER w AS run0 FROM e_fix WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id)) q WHERE sec0 IS NOT NULL) s"""


@query("l01_e08_teleports", f"SELECT event_id, agent_id, round(metres, 3) AS metres FROM {_STEPS} WHERE run0 AND is_running AND metres > 5e0 / 3.6e0 * dt * 1.5e0")
def teleports(t: Tables) -> DataFrame:
    return traffic.teleports(t.e_fix, most_kmh=5.0).select("event_id", "agent_id", F.round("metres", 3).alias("metres"))


@query("l02_step_speeds", f"""
SELECT event_id, round(metres, 3) AS metres, round(dt, 3) AS dt, CASE WHEN dt > 0 THEN round(metres / dt, 6) END AS mps,
 CASE WHEN lon0 <> lon OR lat0 <> lat THEN round((degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) + 360e0) % 360e0, 4) END AS bearing FROM {_STEPS}""")
def step_speeds(t: Tables) -> DataFrame:
    return traffic.steps(t.e_fix).select("event_id", F.round("metres", 3).alias("metres"), F.round("dt", 3).alias("dt"), F.round("mps", 6).alias("mps"), F.round("bearing", 4).alias("bearing"))


@query("l03_o11_trips", """
WITH s AS (SELECT *, epoch(ts) AS sec FROM e_fix),
b AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY agent_id ORDER BY ts, event_id) > 36000 THEN 1 WHEN lag(sec) OVER (PARTITION BY agent_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b FROM s),
r AS (SELECT *, sum(b) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS trip FROM b)
SELECT agent_id, CAST(trip AS BIGINT) AS trip, count(*) AS fixes, round(max(sec) - min(sec), 3) AS elapsed_s, round(max(speed_kmh), 4) AS top_kmh FROM r GROUP BY agent_id, trip""")
def trips(t: Tables) -> DataFrame:
    s = traffic.sessions(t.e_fix, 36000)
    return s.groupBy("agent_id", "trip").agg(F.count("*").alias("fixes"), F.round(F.max("sec") - F.min("sec"), 3).alias("elapsed_s"), F.round(F.max("speed_kmh"), 4).alias("top_kmh"))


_LEGS = """(SELECT way_id AS route_id, seq, eta, eta + cost AS next_eta, x0, y0, x1, y1 FROM (
 SELECT way_id, seq, cost, sum(cost) OVER (PARTITION BY way_id ORDER BY seq) - cost AS eta, x0, y0, x1, y1 FROM (
 SELECT way_id, seq, lon AS x0, lat AS y0, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1, abs(lead(node_id) OVER w - node_id) AS cost FROM w_vertex WINDOW w AS (PARTITION BY way_id ORDER BY seq)) a WHERE x1 IS NOT NULL) b) l"""


@query("l04_c22_positions", f"""
SELECT route_id, CAST(x AS BIGINT) AS at, seq, round((x - eta) / (next_eta - eta)::DOUBLE, 6) AS share, round(x0 + (x1 - x0) * ((x - eta) / (next_eta - eta)::DOUBLE), 6) AS lon FROM {_LEGS} JOIN (VALUES (100), (900), (2500)) v(x) ON eta <= x AND x < next_eta""")
def positions(t: Tables) -> DataFrame:
    """Where each route's agent is at given times."""
    w = Window.partitionBy("way_id").orderBy("seq")
    l = t.w_vertex.select(c("way_id").alias("route_id"), "way_id", "seq", c("lon").alias("x0"), c("lat").alias("y0"), F.lead("lon").over(w).alias("x1"), F.lead("lat").over(w).alias("y1"), F.abs(F.lead("node_id").over(w) - c("node_id")).alias("cost")).filter("x1 IS NOT NULL")
    l = l.withColumn("next_eta", F.sum("cost").over(w)).withColumn("eta", c("next_eta") - c("cost"))
    at = t.part.sparkSession.createDataFrame([(100,), (900,), (2500,)], "at long")
    p = traffic.positions_at(l.drop("way_id"), F.broadcast(at), 500)  # three times
    return p.select("route_id", "at", "seq", F.round("share", 6).alias("share"), F.round("lon", 6).alias("lon"))


@query("l05_expected_speed", """
SELECT event_id, round(CASE WHEN p < 0.05e0 THEN 60e0 * p / 0.05e0 WHEN p > 0.9e0 AND turns THEN 60e0 * 0.6e0 WHEN p > 0.9e0 THEN 60e0 * (1e0 - p) / 0.1e0 ELSE 60e0 END, 6) AS expected_kmh
FROM (SELECT event_id, (event_id % 1000) / 1000e0 AS p, event_id % 2 = 0 AS turns FROM e_fix) q""")
def expected(t: Tables) -> DataFrame:
    return t.e_fix.select("event_id", F.round(road.speed_profile((c("event_id") % 1000) / 1000.0, F.lit(60.0), F.when(c("event_id") % 2 == 0, 0.6).otherwise(1.0)), 6).alias("expected_kmh"))


@query("l06_o08_agents_now", """
SELECT edge_id, count(*) AS agents, round(avg(speed_kmh), 4) AS mean_kmh FROM (SELECT agent_id, arg_max(event_id % 97, (ts, event_id)) AS edge_id, arg_max(speed_kmh, (ts, event_id)) AS speed_kmh FROM e_fix GROUP BY agent_id) q GROUP BY edge_id""")
def agents_now(t: Tables) -> DataFrame:
    last = t.e_fix.groupBy("agent_id").agg(F.max_by(F.struct((c("event_id") % 97).alias("edge_id"), "speed_kmh"), F.struct("ts", "event_id")).alias("l"))
    return last.groupBy("l.edge_id").agg(F.count("*").alias("agents"), F.round(F.avg("l.speed_kmh"), 4).alias("mean_kmh"))


# --------------------------------------------------------------------- M: tiles
@query("m01_m05_missing_tiles", """
WITH g AS (SELECT i, j, round(37.3e0 + i * 1e-2, 6) AS x0, round(55.45e0 + j * 1e-2, 6) AS y0 FROM range(0, 20) a(i), range(0, 10) b(j)),
 done AS (SELECT DISTINCT tile_no FROM (SELECT tile_no, arg_max(status, (ts, event_id)) AS s FROM e_tile_event GROUP BY 1) q WHERE s = 'complete')
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, x0, y0 FROM g WHERE i * 10 + j NOT IN (SELECT tile_no FROM done)""")
def missing_tiles(t: Tables) -> DataFrame:
    """Tiles of an area that are not complete yet."""
    spark = t.part.sparkSession
    g = spark.range(200).select(F.floor(c("id") / 10).alias("i"), (c("id") % 10).alias("j"), c("id").alias("tile_no"))
    last = t.e_tile_event.groupBy("tile_no").agg(F.max_by("status", F.struct("ts", "event_id")).alias("s")).filter("s = 'complete'")
    g = g.join(last.select("tile_no"), "tile_no", "left_anti")
    return g.select("i", "j", F.round(37.3 + c("i") * 1e-2, 6).alias("x0"), F.round(55.45 + c("j") * 1e-2, 6).alias("y0"))


@query("m03_tile_states", """
SELECT tile_no, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (status = 'downloading') AS attempts, max(ts) FILTER (status = 'complete') AS downloaded_at,
       CASE WHEN arg_max(status, (ts, event_id)) = 'complete' AND arg_max(ways_count, (ts, event_id)) = 0 THEN 'empty' ELSE arg_max(status, (ts, event_id)) END AS shown FROM e_tile_event GROUP BY tile_no""")
def tile_states(t: Tables) -> DataFrame:
    at = F.struct("ts", "event_id")
    s = t.e_tile_event.groupBy("tile_no").agg(F.max_by("status", at).alias("status"), F.count_if(c("status") == "downloading").alias("attempts"), F.max(F.when(c("status") == "complete", c("ts"))).alias("downloaded_at"), F.max_by("ways_count", at).alias("n"))
    return s.select("tile_no", "status", "attempts", "downloaded_at", F.when((c("status") == "complete") & (c("n") == 0), "empty").otherwise(c("status")).alias("shown"))


@query("m04_stuck_tiles", """
WITH l AS (SELECT tile_no, arg_max(status, (ts, event_id)) AS status, max(epoch(ts)) AS last_s FROM e_tile_event GROUP BY 1)
SELECT tile_no, CASE WHEN status IN ('downloading', 'pending') AND last_s < (SELECT max(epoch(ts)) FROM e_tile_event) - 300 THEN 'failed' ELSE status END AS status FROM l""")
def stuck(t: Tables) -> DataFrame:
    l = t.e_tile_event.groupBy("tile_no").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max(sec("ts")).alias("at"))
    now = t.e_tile_event.agg(F.max(sec("ts")).alias("now"))
    return l.crossJoin(F.broadcast(now)).select("tile_no", F.when(c("status").isin("downloading", "pending") & (c("at") < c("now") - 300), "failed").otherwise(c("status")).alias("status"))  # one row


@query("m06_m07_tile_features", """
SELECT zoom, x, y, count(*) AS features, CAST(max(importance) AS INTEGER) AS top, CAST(min(qx) AS BIGINT) AS min_qx, CAST(max(qx) AS BIGINT) AS max_qx, CAST(min(qy) AS BIGINT) AS min_qy, CAST(max(qy) AS BIGINT) AS max_qy FROM (
 SELECT v.zoom, x, y, CASE highway WHEN 'motorway' THEN 10 WHEN 'primary' THEN 8 WHEN 'tertiary' THEN 6 ELSE 4 END AS importance,
   greatest(-256, least(4352, floor(((ax + 180e0) / 360e0 * n - x) * 4096e0))) AS qx,
   greatest(-256, least(4352, floor(((1e0 - ln(tan(radians(ay)) + 1e0 / cos(radians(ay))) / pi()) / 2e0 * n - y) * 4096e0))) AS qy
 FROM (SELECT *, power(2e0, zoom) AS n FROM g_cost, (VALUES (12::BIGINT), (14::BIGINT)) z(zoom)) v, LATERAL (SELECT unnest(range(CAST(floor((least(ax, bx) + 180e0) / 360e0 * n - 0.0625e0) AS BIGINT), CAST(floor((greatest(ax, bx) + 180e0) / 360e0 * n + 0.0625e0) AS BIGINT) + 1)) AS x) a,
   LATERAL (SELECT unnest(range(CAST(floor((1e0 - ln(tan(radians(greatest(ay, b_y))) + 1e0 / cos(radians(greatest(ay, b_y)))) / pi()) / 2e0 * n - 0.0625e0) AS BIGINT), CAST(floor((1e0 - ln(tan(radians(least(ay, b_y))) + 1e0 / cos(radians(least(ay, b_y)))) / pi()) / 2e0 * n + 0.0625e0) AS BIGINT) + 1)) AS y) b) q GROUP BY zoom, x, y""")
def tile_features(t: Tables) -> DataFrame:
    """Features for every tile at once: assigned with a margin of 256 of 4096 units, coordinates in tile units."""
    import math

    e = costed(t).withColumn("zoom", F.explode(F.array(F.lit(12).cast("long"), F.lit(14).cast("long")))).withColumn("n", F.pow(F.lit(2.0), c("zoom")))
    fx = lambda lon: (lon + 180.0) / 360.0 * c("n")
    fy = lambda lat: (1.0 - F.ln(F.tan(F.radians(lat)) + 1.0 / F.cos(F.radians(lat))) / math.pi) / 2.0 * c("n")
    cut = lambda v: F.floor(v).cast("long")
    e = e.withColumn("x", F.explode(F.sequence(cut(fx(F.least("ax", "bx")) - 0.0625), cut(fx(F.greatest("ax", "bx")) + 0.0625))))
    e = e.withColumn("y", F.explode(F.sequence(cut(fy(F.greatest("ay", "b_y")) - 0.0625), cut(fy(F.least("ay", "b_y")) + 0.0625))))
    unit = lambda at, tile: F.greatest(F.lit(-256), F.least(F.lit(4352), F.floor((at - c(tile)) * 4096.0)))
    qx, qy = unit(fx(c("ax")), "x"), unit(fy(c("ay")), "y")
    return e.groupBy("zoom", "x", "y").agg(F.count("*").alias("features"), F.max(road.importance(c("highway"))).alias("top"), F.min(qx).cast("long").alias("min_qx"), F.max(qx).cast("long").alias("max_qx"), F.min(qy).cast("long").alias("min_qy"), F.max(qy).cast("long").alias("max_qy"))


@query("m08_a12_a13_geojson", """
SELECT highway, count(*) AS feature_count, CAST(sum(n) AS BIGINT) AS points FROM (SELECT w.way_id, highway, count(*) AS n FROM w_vertex v JOIN w_way w ON w.way_id = v.way_id GROUP BY ALL HAVING count(*) >= 2) q GROUP BY highway""")
def geojson(t: Tables) -> DataFrame:
    """Feature collections of each road class; the query parses them again and counts."""
    w = lines(t).filter(F.size("line") >= 2).join(t.w_way.select("way_id", "highway"), "way_id")
    props = F.create_map(F.lit("highway"), c("highway"), F.lit("id"), c("way_id").cast("string"))
    f = w.select("way_id", "highway", osm.feature(c("way_id"), c("line"), props, F.create_map(F.lit("surface"), F.lit("asphalt"))).alias("f"))
    read = f.select("highway", F.from_json("f", "geometry struct<coordinates:array<array<double>>>, properties map<string,string>").alias("j"))
    return read.groupBy(c("j.properties")["highway"].alias("highway")).agg(F.count("*").alias("feature_count"), F.sum(F.size("j.geometry.coordinates")).alias("points"))


@query("c01_c03_ways_in_tiles", """
WITH z AS (SELECT CAST(floor(lon / 2e-2) AS BIGINT) AS cx, CAST(floor(lat / 2e-2) AS BIGINT) AS cy FROM g_node JOIN g_restriction ON via_node = node_id GROUP BY ALL)
SELECT DISTINCT b.way_id FROM w_box b JOIN z ON b.min_lon <= (z.cx + 1) * 2e-2 AND b.max_lon >= z.cx * 2e-2 AND b.min_lat <= (z.cy + 1) * 2e-2 AND b.max_lat >= z.cy * 2e-2""")
def ways_in_tiles(t: Tables) -> DataFrame:
    """Ways that meet any listed tile (those with turn restrictions): the tiles in a way's box are counted. Touching counts."""
    size = 2e-2
    z = t.g_node.join(t.g_restriction.select(c("via_node").alias("node_id")), "node_id", "left_semi").select(geo.cell(c("lon"), size).alias("cx"), geo.cell(c("lat"), size).alias("cy")).distinct()

    def first(k: str) -> Column:
        """The first tile whose far side is not before ``k``: the comparison decides, not the division."""
        g = geo.cell(c(k), size)
        return g - (c(k) <= g * size).cast("int") + (c(k) > (g + 1) * size).cast("int")

    def last(k: str) -> Column:
        g = geo.cell(c(k), size)
        return g + (c(k) >= (g + 1) * size).cast("int") - (c(k) < g * size).cast("int")

    b = t.w_box.repartition(tables.tasks_for(t.orders, 200_000), "way_id")  # boxes are small, but give four corners each
    b = b.select("way_id", first("min_lon").alias("x0"), first("min_lat").alias("y0"), last("max_lon").alias("x1"), last("max_lat").alias("y1"))
    return mapping.meets_cells(b, z, "way_id")


@query("c19_c23_distant_and_listed", """
SELECT n.node_id, sqrt(power(n.lon - r.lon, 2e0) + power(n.lat - r.lat, 2e0)) > 5e-2 AS distant FROM g_node n, (SELECT lon, lat FROM g_node WHERE node_id = 0) r WHERE n.node_id IN (SELECT o_custkey FROM orders)""")
def distant(t: Tables) -> DataFrame:
    one = t.g_node.filter("node_id = 0").select(c("lon").alias("x"), c("lat").alias("y"))
    listed = t.g_node.join(t.orders.select(c("o_custkey").alias("node_id")), "node_id", "left_semi")
    return listed.join(F.broadcast(one), F.lit(True)).select("node_id", (F.sqrt(F.pow(c("lon") - c("x"), 2.0) + F.pow(c("lat") - c("y"), 2.0)) > 5e-2).alias("distant"))  # one row


# ------------------------------------------------------------------- J: legs
_PATHS = "(SELECT p_partkey AS path_id, k AS seq, p_partkey + k AS node, CASE WHEN k < 5 THEN p_partkey + k + 1 END AS nxt FROM part, range(0, 6) r(k) WHERE p_partkey % 100 < 95) p"


@query("j09_c14_c15_leg_table", f"""
SELECT path_id, CAST(seq AS BIGINT) AS seq, edge_id, oneway = -1 AS backward, round(length_m, 3) AS length_m, speed AS limit_kmh, round(0.8e0 * speed, 4) AS effective_kmh, round(sum(length_m / (0.8e0 * speed / 3.6e0)) OVER (PARTITION BY path_id ORDER BY seq), 4) AS eta
FROM {_PATHS} JOIN g_cost g ON g.kind = 1 AND g.source_id = p.node AND p.nxt IS NOT NULL""")
def leg_table(t: Tables) -> DataFrame:
    """Consecutive path rows with their edges, orientation, speeds and ETAs."""
    p = t.part.filter("p_partkey % 100 < 95").select(c("p_partkey").alias("path_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: c("p_partkey") + k)).alias("seq", "node"))
    w = Window.partitionBy("path_id").orderBy("seq")
    p = p.withColumn("nxt", F.lead("node").over(w)).filter("nxt IS NOT NULL")
    e = costed(t).filter("kind = 1").select(c("source_id").alias("node"), "edge_id", "oneway", "length_m", "speed")
    eff = 0.8 * c("speed")
    return p.join(e, "node").select(
        "path_id", c("seq").cast("long").alias("seq"), "edge_id", (c("oneway") == -1).alias("backward"), F.round("length_m", 3).alias("length_m"), c("speed").alias("limit_kmh"), F.round(eff, 4).alias("effective_kmh"),
        F.round(F.sum(c("length_m") / (eff / 3.6)).over(w), 4).alias("eta"),
    )


@query("j10_route_cache", "SELECT l_partkey % 50 AS from_node, l_suppkey % 20 AS to_node, count(*) AS access_count, max(l_orderkey) AS last_route FROM lineitem GROUP BY ALL")
def route_cache(t: Tables) -> DataFrame:
    log = t.lineitem.select((c("l_partkey") % 50).alias("from_node"), (c("l_suppkey") % 20).alias("to_node"), c("l_orderkey").alias("at"), c("l_orderkey").alias("route"))
    return tables.accumulate(log, ["from_node", "to_node"], "at", "route").select("from_node", "to_node", "access_count", c("payload").alias("last_route"))


@query("j11_route_switch", """
SELECT request_id, CAST(min(x * 1000 + y) // 1000 AS BIGINT) AS at_old, CAST(min(x * 1000 + y) % 1000 AS BIGINT) AS at_new FROM (
 SELECT o.request_id, p.seq AS x, q.seq AS y FROM (SELECT request_id, min(route_id) AS a, max(route_id) AS b FROM r_route_edge GROUP BY 1 HAVING min(route_id) < max(route_id)) o
 JOIN w_node p ON p.way_id = o.a AND p.seq >= 2 JOIN w_node q ON q.way_id = o.b AND q.node_id % 40 = p.node_id % 40) s GROUP BY request_id""")
def route_switch(t: Tables) -> DataFrame:
    """First remaining edge of the old route that the new one has too, and its place there."""
    o = t.r_route_edge.groupBy("request_id").agg(F.min("route_id").alias("a"), F.max("route_id").alias("b")).filter("a < b")
    street = (c("node_id") % 40).alias("street")
    old = t.w_node.filter("seq >= 2").select(c("way_id").alias("a"), c("seq").alias("x"), street)
    new = t.w_node.select(c("way_id").alias("b"), c("seq").alias("y"), street)
    return o.join(old, "a").join(new, ["b", "street"]).groupBy("request_id").agg(F.min(F.struct("x", "y")).alias("m")).select("request_id", c("m.x").alias("at_old"), c("m.y").alias("at_new"))


@query("j06_multi_stop", f"""
WITH RECURSIVE l(leg, src, dst) AS (SELECT * FROM (SELECT 0::BIGINT, r, r + 10 FROM (SELECT CAST({_ROOT} AS BIGINT) AS r FROM part) q UNION ALL SELECT 1, r + 10, r + 30 FROM (SELECT CAST({_ROOT} AS BIGINT) AS r FROM part) q UNION ALL SELECT 2, r + 30, r - 55 FROM (SELECT CAST({_ROOT} AS BIGINT) AS r FROM part) q) z),
d(src, node, dist) USING KEY (src, node) AS (SELECT src, src, 0::BIGINT FROM l
  UNION SELECT d.src, a.t, CAST(min(d.dist + a.w) AS BIGINT) FROM d JOIN g_arc a ON a.s = d.node LEFT JOIN recurring.d r ON r.src = d.src AND r.node = a.t WHERE r.dist IS NULL OR d.dist + a.w < r.dist GROUP BY d.src, a.t)
SELECT leg, l.src, l.dst, dist AS cost, CAST(sum(dist) OVER (ORDER BY leg) AS BIGINT) AS arrival FROM l LEFT JOIN d ON d.src = l.src AND d.node = l.dst""")
def multi_stop(t: Tables) -> DataFrame:
    """Legs of a tour: all of them searched in one batch, times chained."""
    spark = t.part.sparkSession
    stops = spark.createDataFrame([(0, 0, 10), (1, 10, 30), (2, 30, -55)], "leg long, a long, b long")
    legs = stops.join(F.broadcast(root(t)), F.lit(True)).select("leg", (c("src") + c("a")).alias("src"), (c("src") + c("b")).alias("dst"))
    d = graph.distances(arcs(t).select("s", "t", "w"), legs.select("src").distinct(), targets=legs.select("src", "dst")).select("src", c("node").alias("dst"), c("g").alias("cost"))
    return legs.join(d, ["src", "dst"], "left").select("leg", "src", "dst", "cost", F.sum("cost").over(Window.orderBy("leg")).alias("arrival"))


@query("j07_j08_k_routes")
def k_routes(t: Tables) -> DataFrame:
    """Up to two routes for each request near the depot, used streets five times as dear the second time."""
    r = requests(t).filter(c("request_id").isin(REQUESTS[:2]))
    k = alternatives.k_routes(arcs(t).select("s", "t", "w"), r, 2)
    return k.groupBy("request_id", "route").agg(F.count("*").alias("legs"), F.sum("w").alias("cost"))


# ---------------------------------------------------------------- I: noding
_CUTS = "(SELECT way_id, seq, node_id, count(*) OVER (PARTITION BY way_id) AS n, min(way_id) OVER (PARTITION BY node_id) < max(way_id) OVER (PARTITION BY node_id) AS shared FROM w_node)"
_PIECES = f"SELECT way_id, count(*) FILTER (seq > 1 AND seq < n AND shared) + 1 AS pieces FROM {_CUTS} GROUP BY way_id"


@query("i01_shared_vertices", _PIECES)
def shared_vertices(t: Tables) -> DataFrame:
    """Noding (a): the number of pieces of every way, cut against every other way."""
    return noded(t.w_node)


@query("i01_c08_pieces", f"""
SELECT way_id, CAST(piece AS BIGINT) AS piece, min(node_id) FILTER (seq = a) AS from_node, min(node_id) FILTER (seq = b) AS to_node, CAST(b - a + 1 AS BIGINT) AS n_points FROM (
 SELECT p.way_id, p.piece, p.a, p.b, v.seq, v.node_id FROM (SELECT way_id, seq AS a, lead(seq) OVER w AS b, row_number() OVER w AS piece FROM {_CUTS} WHERE seq = 1 OR seq = n OR shared WINDOW w AS (PARTITION BY way_id ORDER BY seq)) p
 JOIN w_node v ON v.way_id = p.way_id AND v.seq IN (p.a, p.b) WHERE p.b IS NOT NULL) q GROUP BY way_id, piece, a, b""")
def pieces(t: Tables) -> DataFrame:
    """Noding (a) as rows: the pieces of every way between its cuts. A piece carries its way (C8), so nothing is matched back by position."""
    w = t.w_node
    uses = w.groupBy("node_id").agg((F.min("way_id") < F.max("way_id")).alias("shared"))
    ends = w.groupBy("way_id").agg(F.max("seq").alias("n"))
    cuts = w.join(uses, "node_id").join(ends, "way_id").filter("seq = 1 OR seq = n OR shared")
    along = Window.partitionBy("way_id").orderBy("seq")
    cuts = cuts.select("way_id", F.row_number().over(along).cast("long").alias("piece"), c("node_id").alias("from_node"), F.lead("node_id").over(along).alias("to_node"), (F.lead("seq").over(along) - c("seq") + 1).alias("n_points"))
    return cuts.filter("n_points IS NOT NULL")


def noded(w: DataFrame) -> DataFrame:
    """Ways are cut at inner vertices that other ways use too."""
    # two distinct ways at a node show in the least and the greatest; both are reduced before the shuffle
    uses = w.groupBy("node_id").agg((F.min("way_id") < F.max("way_id")).alias("shared"))
    n = w.groupBy("way_id").agg(F.count("*").alias("n"))
    j = w.join(uses, "node_id").join(n, "way_id")
    return j.groupBy("way_id").agg((F.count_if((c("seq") > 1) & (c("seq") < c("n")) & c("shared")) + 1).alias("pieces"))


_DIAG = "(SELECT edge_id, z_layer AS z, ax, ay, bx + (edge_id % 3) * 1e-3 AS bx, b_y + (edge_id % 5) * 1e-3 AS b_y FROM g_cost)"


#: Junctions whose streets a task nodes.
NODES_A_TASK = 5_000


@query("i01_crossings", f"""
SELECT e1, e2, round(t, 6) AS t, round(u, 6) AS u FROM (SELECT a.edge_id AS e1, b.edge_id AS e2, ((b.ax - a.ax) * (b.b_y - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / det AS t, ((b.ax - a.ax) * (a.b_y - a.ay) - (b.ay - a.ay) * (a.bx - a.ax)) / det AS u
 FROM {_DIAG} a JOIN {_DIAG} b ON a.z = b.z AND a.edge_id < b.edge_id AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) AND greatest(a.ax, a.bx) >= least(b.ax, b.bx) AND least(a.ay, a.b_y) <= greatest(b.ay, b.b_y) AND greatest(a.ay, a.b_y) >= least(b.ay, b.b_y),
 LATERAL (SELECT (a.bx - a.ax) * (b.b_y - b.ay) - (a.b_y - a.ay) * (b.bx - b.ax) AS det) d WHERE abs(det) > 1e-9) q WHERE t > 1e-4 AND t < 0.9999e0 AND u > 1e-4 AND u < 0.9999e0""")
def crossings(t: Tables) -> DataFrame:
    """Noding (b): where streets of one layer cross, found in shared cells; shares along both."""
    size = 2e-3
    s = costed(t).select("edge_id", c("z_layer").alias("z"), "ax", "ay", (c("bx") + (c("edge_id") % 3) * 1e-3).alias("bx"), (c("b_y") + (c("edge_id") % 5) * 1e-3).alias("b_y"))
    span = lambda a, b: F.explode(F.sequence(geo.cell(F.least(a, b), size), geo.cell(F.greatest(a, b), size)))
    s = s.withColumn("cx", span("ax", "bx")).withColumn("cy", span("ay", "b_y")).repartition(tables.tasks_for(t.part, NODES_A_TASK), "z", "cx", "cy")
    a = s.select("z", "cx", "cy", *[c(k).alias(f"{k}1") for k in ("edge_id", "ax", "ay", "bx", "b_y")])
    b = s.select("z", "cx", "cy", *[c(k).alias(f"{k}2") for k in ("edge_id", "ax", "ay", "bx", "b_y")])
    # boxes that meet share the cell where their common box begins; there a pair is taken, once
    least = lambda v, w, k: F.least(c(f"{v}{k}"), c(f"{w}{k}"))
    first = lambda v, w: geo.cell(F.greatest(least(v, w, 1), least(v, w, 2)), size)
    j = a.join(b, ["z", "cx", "cy"]).filter("edge_id1 < edge_id2").filter((c("cx") == first("ax", "bx")) & (c("cy") == first("ay", "b_y")))
    dx1, dy1, dx2, dy2 = c("bx1") - c("ax1"), c("b_y1") - c("ay1"), c("bx2") - c("ax2"), c("b_y2") - c("ay2")
    det = dx1 * dy2 - dy1 * dx2
    ox, oy = c("ax2") - c("ax1"), c("ay2") - c("ay1")
    j = j.filter(F.abs(det) > 1e-9).select(c("edge_id1").alias("e1"), c("edge_id2").alias("e2"), ((ox * dy2 - oy * dx2) / det).alias("t"), ((ox * dy1 - oy * dx1) / det).alias("u"))
    return j.filter("t > 1e-4 AND t < 0.9999 AND u > 1e-4 AND u < 0.9999").select("e1", "e2", F.round("t", 6).alias("t"), F.round("u", 6).alias("u"))


@query("i01_crossing_pieces", f"""
WITH x AS (SELECT e1, e2, t, u FROM (SELECT a.edge_id AS e1, b.edge_id AS e2, ((b.ax - a.ax) * (b.b_y - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / det AS t, ((b.ax - a.ax) * (a.b_y - a.ay) - (b.ay - a.ay) * (a.bx - a.ax)) / det AS u
 FROM {_DIAG} a JOIN {_DIAG} b ON a.z = b.z AND a.edge_id < b.edge_id AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) AND greatest(a.ax, a.bx) >= least(b.ax, b.bx) AND least(a.ay, a.b_y) <= greatest(b.ay, b.b_y) AND greatest(a.ay, a.b_y) >= least(b.ay, b.b_y),
 LATERAL (SELECT (a.bx - a.ax) * (b.b_y - b.ay) - (a.b_y - a.ay) * (b.bx - b.ax) AS det) d WHERE abs(det) > 1e-9) q WHERE t > 1e-4 AND t < 0.9999e0 AND u > 1e-4 AND u < 0.9999e0),
 k AS (SELECT e1 AS edge_id, round(t, 6) AS share FROM x UNION SELECT e2, round(u, 6) FROM x UNION SELECT edge_id, 0e0 FROM g_edge UNION SELECT edge_id, 1e0 FROM g_edge)
SELECT edge_id, share AS from_share, upto AS to_share FROM (SELECT edge_id, share, lead(share) OVER (PARTITION BY edge_id ORDER BY share) AS upto FROM k) p WHERE upto IS NOT NULL""")
def crossing_pieces(t: Tables) -> DataFrame:
    """Noding (b) as rows: the pieces of every street between its crossings, as shares along it; the street's id stays on them."""
    x = crossings(t)
    cuts = x.select(c("e1").alias("edge_id"), c("t").alias("share")).union(x.select("e2", "u"))
    cuts = cuts.union(t.g_edge.select("edge_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))))).repartition(tables.tasks_for(t.part, NODES_A_TASK), "edge_id").distinct()
    upto = F.lead("share").over(Window.partitionBy("edge_id").orderBy("share"))
    return cuts.select("edge_id", c("share").alias("from_share"), upto.alias("to_share")).filter("to_share IS NOT NULL")


# ----------------------------------------------------------------- A: elements
def elements(t: Tables) -> DataFrame:
    """The network as map elements, as they come from an element document."""
    none = lambda kind: F.lit(None).cast(kind)
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), c(k).alias("v")) for k in ("highway", "access", "barrier", "lanes", "maxspeed")]), lambda e: e["v"].isNotNull()))
    nodes = t.w_node.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda p: p["node_id"]).alias("nodes"))
    members = "array<struct<type:string,ref:bigint,role:string>>"
    ways = t.w_way.join(nodes, "way_id").select(F.lit("way").alias("type"), c("way_id").alias("id"), none("double").alias("lat"), none("double").alias("lon"), "nodes", tags.alias("tags"), none(members).alias("members"))
    points = t.g_node.select(F.lit("node").alias("type"), c("node_id").alias("id"), "lat", "lon", none("array<bigint>").alias("nodes"), F.when(c("node_id") % 31 == 0, F.create_map(F.lit("barrier"), F.lit("gate"))).otherwise(F.create_map().cast("map<string,string>")).alias("tags"), none(members).alias("members"))
    rel = t.g_restriction.select(
        F.lit("relation").alias("type"), c("rel_id").alias("id"), none("double").alias("lat"), none("double").alias("lon"), none("array<bigint>").alias("nodes"), F.create_map(F.lit("type"), F.lit("restriction"), F.lit("restriction"), c("restriction")).alias("tags"),
        F.array(*[F.struct(F.lit(k).alias("type"), c(r).alias("ref"), F.lit(o).alias("role")) for k, r, o in (("way", "from_edge", "from"), ("node", "via_node", "via"), ("way", "to_edge", "to"))]).alias("members"))
    return ways.unionByName(points).unionByName(rel)


@query("a02_element_split", """
SELECT DISTINCT 'way' AS kind, way_id AS id FROM w_node WHERE way_id IN (SELECT way_id FROM w_way) UNION ALL SELECT 'barrier', node_id FROM g_node WHERE node_id % 31 = 0 UNION ALL SELECT 'restriction', rel_id FROM g_restriction""")
def element_split(t: Tables) -> DataFrame:
    ways, barriers, restrictions = (df.select(F.lit(kind).alias("kind"), "id") for kind, df in zip(("way", "barrier", "restriction"), osm.split_elements(elements(t))))
    return ways.union(barriers).union(restrictions)


@query("a03_extract", """
SELECT 'node' AS type, node_id AS id FROM g_node WHERE lon BETWEEN 37.31e0 AND 37.3355e0 AND lat BETWEEN 55.44e0 AND 55.4595e0 AND node_id % 31 = 0
UNION ALL SELECT 'way', way_id FROM w_way w WHERE highway IN ('motorway','trunk','primary','secondary','residential','service','tertiary_link') AND way_id IN (SELECT way_id FROM w_vertex WHERE lon BETWEEN 37.31e0 AND 37.3355e0 AND lat BETWEEN 55.44e0 AND 55.4595e0)
UNION ALL SELECT 'way', way_id FROM w_way w WHERE highway = 'footway' AND barrier = 'gate' AND way_id IN (SELECT way_id FROM w_vertex WHERE lon BETWEEN 37.31e0 AND 37.3355e0 AND lat BETWEEN 55.44e0 AND 55.4595e0)
UNION ALL SELECT 'relation', rel_id FROM g_restriction""")
def element_extract(t: Tables) -> DataFrame:
    return osm.extract(elements(t), (37.31, 55.44, 37.3355, 55.4595)).select("type", "id")


@query("a04_way_assembly", """
SELECT v.way_id AS osm_id, count(*) AS points, round(arg_min(lon, seq), 6) AS first_lon, any_value(CASE WHEN regexp_matches(lanes, '^[0-9]+$') THEN CAST(lanes AS INTEGER) END) AS lanes FROM w_vertex v JOIN w_way w ON w.way_id = v.way_id GROUP BY v.way_id HAVING count(*) >= 2""")
def way_assembly(t: Tables) -> DataFrame:
    e = elements(t)
    ways, _, _ = osm.split_elements(e)
    return osm.assemble_ways(ways, osm.node_coordinates(e)).select("osm_id", F.size("geom").cast("long").alias("points"), F.round(F.element_at("geom", 1)["lon"], 6).alias("first_lon"), "lanes")


@query("a11_graph_snapshot", "SELECT edge_id, round(ax, 6) AS lon0, round(b_y, 6) AS lat1, CAST(round_even(length_m / 5e0, 0) AS BIGINT) * coalesce(lanes, 1) AS capacity FROM g_cost WHERE length_m > 0 ORDER BY edge_id")
def snapshot(t: Tables) -> DataFrame:
    return costed(t).filter("length_m > 0").orderBy("edge_id").select("edge_id", F.round("ax", 6).alias("lon0"), F.round("b_y", 6).alias("lat1"), road.capacity(c("length_m"), c("n_lanes")).alias("capacity"))


# ------------------------------------------------- O: batch twins of the streams
@query("o02_o03_rates", """
SELECT CAST(floor(epoch(ts) / 300e0) AS BIGINT) AS slot, count(*) AS requests, round(100e0 * avg(success), 6) AS success_pct, round(sum(duration_ms) / sum(edges_found), 9) AS ms_per_edge FROM e_request GROUP BY 1""")
def rates(t: Tables) -> DataFrame:
    q = t.e_request.groupBy(road.slot_of(sec("ts")).alias("slot"))
    return q.agg(F.count("*").alias("requests"), F.round(100.0 * F.avg("success"), 6).alias("success_pct"), F.round(F.sum("duration_ms") / F.sum("edges_found"), 9).alias("ms_per_edge"))


@query("o02_sliding_rate", """
SELECT CAST(s AS BIGINT) AS starts, round(sum(duration_ms) / sum(edges_found), 9) AS ms_per_edge FROM e_request, LATERAL (SELECT unnest(range(CAST(floor(epoch(ts) / 15e0) AS BIGINT) - 3, CAST(floor(epoch(ts) / 15e0) AS BIGINT) + 1)) * 15 AS s) x GROUP BY 1""")
def sliding(t: Tables) -> DataFrame:
    """One-minute windows every 15 seconds."""
    w = F.explode(F.sequence(F.floor(sec("ts") / 15).cast("long") - 3, F.floor(sec("ts") / 15).cast("long")))
    return t.e_request.select(w.alias("k"), "duration_ms", "edges_found").groupBy((c("k") * 15).alias("starts")).agg(F.round(F.sum("duration_ms") / F.sum("edges_found"), 9).alias("ms_per_edge"))


@query("o04_latency_histogram", """
SELECT le, count(*) FILTER (duration_ms <= le) AS n FROM e_request, (VALUES (5e0), (10e0), (25e0), (50e0), (100e0), (250e0), (1e9)) v(le) GROUP BY le""")
def latency_histogram(t: Tables) -> DataFrame:
    """Cumulative buckets in one pass."""
    les = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 1e9]
    one = t.e_request.agg(*[F.count_if(c("duration_ms") <= v).alias(f"n{k}") for k, v in enumerate(les)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("le"), c(f"n{k}").alias("n")) for k, v in enumerate(les)])).alias("b")).select("b.le", "b.n")


@query("o05_efficiency", """
SELECT k, round(avg(edges_found), 6) AS mean_edges, round(sum(edges_found) / sum(duration_ms), 9) AS edges_per_ms, count(*) FILTER (success = 0) AS failed FROM e_request GROUP BY k""")
def efficiency(t: Tables) -> DataFrame:
    return t.e_request.groupBy("k").agg(F.round(F.avg("edges_found"), 6).alias("mean_edges"), F.round(F.sum("edges_found") / F.sum("duration_ms"), 9).alias("edges_per_ms"), F.count_if(c("success") == 0).alias("failed"))


@query("o06_log_counts", """
SELECT event_type AS logger, CAST(floor(epoch(ts) / 3600e0) AS BIGINT) AS hour, count(*) AS n, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) > 90) AS errors FROM events GROUP BY ALL""")
def log_counts(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.floor(sec("ts") / 3600).cast("long").alias("hour"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy(c("event_type").alias("logger"), "hour").agg(F.count("*").alias("n"), F.count_if(c("k") > 90).alias("errors"))


@query("o09_h32_progress", """
SELECT tile_no, count(*) AS steps, round(100e0 * count(*) FILTER (status = 'complete') / count(*), 6) AS progress_pct, round(count(*) FILTER (status = 'complete') / greatest(max(epoch(ts)) - min(epoch(ts)), 1e0), 9) AS per_s,
 CASE WHEN count(*) FILTER (status = 'complete') > 0 THEN round((count(*) - count(*) FILTER (status = 'complete')) * greatest(max(epoch(ts)) - min(epoch(ts)), 1e0) / count(*) FILTER (status = 'complete'), 3) END AS eta_s FROM e_tile_event GROUP BY tile_no""")
def progress(t: Tables) -> DataFrame:
    done, n = F.count_if(c("status") == "complete"), F.count("*")
    took = F.greatest(F.max(sec("ts")) - F.min(sec("ts")), F.lit(1.0))
    return t.e_tile_event.groupBy("tile_no").agg(n.alias("steps"), F.round(100.0 * done / n, 6).alias("progress_pct"), F.round(done / took, 9).alias("per_s"), F.when(done > 0, F.round((n - done) * took / done, 3)).alias("eta_s"))
