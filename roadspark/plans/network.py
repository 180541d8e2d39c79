"""Building the routing graph and routing on it (inventory C, I, J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.functions import geo, road
from roadspark.operators import graph, tables
from roadspark.plans.registry import query
from roadspark.plans.roads import arcs, costed
from roadspark.sources.fixtures import Tables

c = F.col

_ROOT = "CASE WHEN max(p_partkey) > 15000 THEN 10050 WHEN max(p_partkey) > 1500 THEN 1010 ELSE 10 END"


def root(t: Tables) -> DataFrame:
    """The depot: a junction in the main component at every data size."""
    return t.part.selectExpr("p_partkey").agg(F.expr(_ROOT).cast("long").alias("src"))


def _reach(seed: str, cost: str = "a.w", arc: str = "g_arc", s: str = "s", t: str = "t") -> str:
    return f"""d(node, dist) USING KEY (node) AS (
  SELECT CAST(node AS BIGINT), CAST(0 AS BIGINT) FROM ({seed}) z
  UNION SELECT a.{t}, CAST(min(d.dist + {cost}) AS BIGINT) FROM d JOIN {arc} a ON a.{s} = d.node LEFT JOIN recurring.d r ON r.node = a.{t}
  WHERE r.dist IS NULL OR d.dist + {cost} < r.dist GROUP BY a.{t})"""


_SEED = f"SELECT {_ROOT} AS node FROM part"


@query("i12_depot_times", f"WITH RECURSIVE {_reach(_SEED)} SELECT node, dist AS g FROM d")
def depot_times(t: Tables) -> DataFrame:
    """Fastest times from a depot to every junction."""
    return graph.distances(arcs(t).select("s", "t", "w"), root(t)).select("node", "g")


@query("i12_depot_radius", f"WITH RECURSIVE {_reach(_SEED)} SELECT node, dist AS g FROM d WHERE dist <= 120")
def depot_radius(t: Tables) -> DataFrame:
    return graph.distances(arcs(t).select("s", "t", "w"), root(t), limit=120).select("node", "g")


@query("i05_weak_components", """
WITH RECURSIVE b AS (SELECT source_id AS s, target_id AS t FROM g_edge UNION SELECT target_id, source_id FROM g_edge),
k(node, label) USING KEY (node) AS (SELECT node, node FROM (SELECT s AS node FROM b UNION SELECT t FROM b) z
  UNION SELECT b.t, min(k.label) FROM k JOIN b ON b.s = k.node JOIN recurring.k r ON r.node = b.t WHERE k.label < r.label GROUP BY b.t)
SELECT node, label AS component FROM k""")
def weak(t: Tables) -> DataFrame:
    return graph.weak_components(t.g_edge.select(c("source_id").alias("s"), c("target_id").alias("t")))


@query("d08_d09_component_sizes", """
WITH RECURSIVE b AS (SELECT source_id AS s, target_id AS t FROM g_edge UNION SELECT target_id, source_id FROM g_edge),
k(node, label) USING KEY (node) AS (SELECT node, node FROM (SELECT s AS node FROM b UNION SELECT t FROM b) z
  UNION SELECT b.t, min(k.label) FROM k JOIN b ON b.s = k.node JOIN recurring.k r ON r.node = b.t WHERE k.label < r.label GROUP BY b.t)
SELECT label AS component, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS share, count(*) / (sum(count(*)) OVER ())::DOUBLE < 0.95e0 AS warn FROM k GROUP BY label ORDER BY n DESC, component LIMIT 5""")
def component_sizes(t: Tables) -> DataFrame:
    """Sizes, shares, and a warning where a component holds less than 95 %."""
    n = weak(t).groupBy("component").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())
    return n.select("component", "n", F.round(100.0 * c("n") / whole, 4).alias("share"), (c("n") / whole < 0.95).alias("warn")).orderBy(c("n").desc(), "component").limit(5)


@query("i04_i06_main_component", f"""
WITH RECURSIVE {_reach(_SEED)},
 b(node, dist) USING KEY (node) AS (SELECT CAST(node AS BIGINT), CAST(0 AS BIGINT) FROM ({_SEED}) z
  UNION SELECT a.s, CAST(min(b.dist + a.w) AS BIGINT) FROM b JOIN g_arc a ON a.t = b.node LEFT JOIN recurring.b r ON r.node = a.s WHERE r.dist IS NULL OR b.dist + a.w < r.dist GROUP BY a.s)
SELECT e.edge_id FROM g_edge e JOIN (SELECT d.node FROM d JOIN b ON b.node = d.node) x ON x.node = e.source_id JOIN (SELECT d.node FROM d JOIN b ON b.node = d.node) y ON y.node = e.target_id""")
def main_component(t: Tables) -> DataFrame:
    """Edges inside the strong component that holds the depot."""
    a, src = arcs(t).select("s", "t"), root(t)
    there = graph.reachable(a, src)
    back = graph.reachable(a.select(c("t").alias("s"), c("s").alias("t")), src)
    inside = there.join(back, ["src", "node"]).select("node")
    return graph.keep_nodes(t.g_edge, inside).select("edge_id")


def segments(t: Tables) -> DataFrame:
    """Directed segments: nodes of the line graph."""
    e = costed(t)
    forward = e.filter("cost > 0").select((c("edge_id") * 2).alias("seg"), "edge_id", c("source_id").alias("entry"), c("target_id").alias("exit"), "highway", "speed", "secs", geo.azimuth_deg(c("ax"), c("ay"), c("bx"), c("b_y")).alias("az"))
    back = e.filter("reverse_cost > 0").select((c("edge_id") * 2 + 1).alias("seg"), "edge_id", c("target_id").alias("entry"), c("source_id").alias("exit"), "highway", "speed", "secs", geo.azimuth_deg(c("bx"), c("b_y"), c("ax"), c("ay")).alias("az"))
    return forward.union(back)


def _from_ends(s: DataFrame) -> DataFrame:
    return s.select(c("seg").alias("f_seg"), c("edge_id").alias("f_edge"), c("exit").alias("junction"), c("highway").alias("f_class"), c("az").alias("f_az"), c("speed").alias("f_speed"))


def maneuvers(t: Tables) -> DataFrame:
    """Manoeuvres between segments that meet, with angle, type, penalty and weight."""
    s = segments(t)
    return _maneuvers(_from_ends(s), s)


def _maneuvers(f: DataFrame, s: DataFrame, keep: Column | None = None) -> DataFrame:
    """Manoeuvres from the ends ``f`` to the segments ``s``, those that ``keep`` names."""
    x = s.select(c("seg").alias("t_seg"), c("edge_id").alias("t_edge"), c("entry").alias("junction"), c("az").alias("t_az"), c("speed").alias("t_speed"), c("secs").alias("t_secs"))
    m = f.join(x, "junction")
    m = m if keep is None else m.filter(keep)
    same = c("f_edge") == c("t_edge")
    m = m.filter(~(same & c("f_class").isin("motorway", "trunk", "motorway_link", "trunk_link"))).withColumn("angle", F.round(geo.turn_angle(c("f_az"), c("t_az")), 4))
    penalty = road.turn_penalty(c("angle"), road.class_code(c("f_class")), c("f_speed"), c("t_speed"))
    return m.select("f_seg", "t_seg", "f_edge", "t_edge", "junction", "angle", geo.turn_type(c("angle"), same).alias("turn"), F.round(penalty, 4).alias("penalty"), F.round(c("t_secs") + penalty).cast("long").alias("weight"))


_SEG = """seg AS (SELECT edge_id * 2 AS seg, edge_id, source_id AS entry, target_id AS ex, highway, speed, secs, (degrees(atan2(bx - ax, b_y - ay)) + 360e0) % 360e0 AS az FROM g_cost WHERE oneway <> -1
 UNION ALL SELECT edge_id * 2 + 1, edge_id, target_id, source_id, highway, speed, secs, (degrees(atan2(ax - bx, ay - b_y)) + 360e0) % 360e0 FROM g_cost WHERE oneway <> 1),
 man0 AS (SELECT f.seg AS f_seg, x.seg AS t_seg, f.edge_id AS f_edge, x.edge_id AS t_edge, f.ex AS junction, greatest(f.speed / 3.6e0, 1e0) AS vi, greatest(x.speed / 3.6e0, 1e0) AS vo, x.secs, f.edge_id = x.edge_id AS same,
   CASE WHEN f.highway IN ('motorway', 'trunk', 'motorway_link') THEN 50e0 ELSE 15e0 END AS r,
   round(CASE WHEN x.az - f.az > 180 THEN x.az - f.az - 360e0 WHEN x.az - f.az <= -180 THEN x.az - f.az + 360e0 ELSE x.az - f.az END, 4) AS angle
   FROM seg f JOIN seg x ON f.ex = x.entry WHERE NOT (f.edge_id = x.edge_id AND f.highway IN ('motorway', 'trunk', 'motorway_link', 'trunk_link'))),
 man1 AS (SELECT *, greatest(least(vi, vo, sqrt(r * (0.6e0 * 9.81e0))), 1.3e0) AS v, r * radians(abs(angle)) AS arc FROM man0),
 man AS (SELECT *, CASE WHEN same AND abs(angle) > 150 THEN 3 WHEN abs(angle) <= 20 THEN 0 WHEN angle > 20 THEN 1 ELSE 2 END AS turn,
   greatest((vi - v) / 2e0 + arc / v + (vo - v) / 1.5e0 - arc / vi, 0e0) + CASE WHEN abs(angle) > 150 THEN 15e0 ELSE 0e0 END AS pen FROM man1)"""


query("i07_c04_line_graph", f"WITH {_SEG} SELECT f_seg, t_seg, f_edge, t_edge, junction, angle, turn, round(pen, 4) AS penalty, CAST(round(secs + pen) AS BIGINT) AS weight FROM man")(maneuvers)


def restriction_members(t: Tables) -> DataFrame:
    """Restrictions as relations with members (type, ref, role)."""
    m = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), c(ref).alias("ref"), F.lit(role).alias("role"))
    return t.g_restriction.select("rel_id", "restriction", F.array(m("way", "from_edge", "from"), m("n", "via_node", "via"), m("way", "to_edge", "to")).alias("members"))


def restriction_triples(relations: DataFrame) -> DataFrame:
    """(rel_id, restriction, from_edge, via_node, to_edge) for every from/via/to of a relation.

    Member types are read by their first letter, in either case.
    """
    m = relations.select("rel_id", "restriction", F.posexplode("members").alias("pos", "m")).select("rel_id", "restriction", F.upper(F.substring("m.type", 1, 1)).alias("k"), "m.ref", "m.role")
    role = lambda name, kind, out: m.filter((c("role") == name) & (c("k") == kind)).select("rel_id", c("ref").alias(out))
    heads = m.select("rel_id", "restriction").distinct()
    return heads.join(role("from", "W", "from_edge"), "rel_id").join(role("via", "N", "via_node"), "rel_id").join(role("to", "W", "to_edge"), "rel_id")


def allowed(t: Tables) -> DataFrame:
    """Manoeuvres that no prohibition forbids and no mandatory turn overrides."""
    r = restriction_triples(restriction_members(t))
    at = [c("from_edge").alias("f_edge"), c("via_node").alias("junction")]
    no = r.filter(c("restriction").startswith("no_")).groupBy(*at).agg(F.collect_set("to_edge").alias("no"))
    only = r.filter(c("restriction").startswith("only_")).groupBy(*at).agg(F.min("to_edge").alias("must"), F.max("to_edge").alias("must_too"))
    # both are laid beside the ends of segments, so that the far more manoeuvres are dealt once, by junction
    s = segments(t)
    f = _from_ends(s).join(no, ["f_edge", "junction"], "left").join(only, ["f_edge", "junction"], "left")
    keep = ~F.coalesce(F.array_contains("no", c("t_edge")), F.lit(False)) & (c("must").isNull() | (c("must") == c("t_edge")) & (c("must_too") == c("t_edge")))
    return _maneuvers(f, s, keep)


@query("i08_c05_c07_restricted", f"""
WITH {_SEG}, m AS (SELECT f_seg, t_seg, f_edge, t_edge, junction FROM man)
SELECT f_seg, t_seg FROM m
WHERE NOT EXISTS (SELECT 1 FROM g_restriction r WHERE r.restriction LIKE 'no_%' AND r.from_edge = m.f_edge AND r.via_node = m.junction AND r.to_edge = m.t_edge)
  AND NOT EXISTS (SELECT 1 FROM g_restriction r WHERE r.restriction LIKE 'only_%' AND r.from_edge = m.f_edge AND r.via_node = m.junction AND r.to_edge <> m.t_edge)""")
def restricted(t: Tables) -> DataFrame:
    return allowed(t).select("f_seg", "t_seg")


@query("i02_c09_topology", """
WITH v AS (SELECT DISTINCT CAST(round_even(lon / 1e-5, 0) AS BIGINT) AS kx, CAST(round_even(lat / 1e-5, 0) AS BIGINT) AS ky FROM (SELECT ax AS lon, ay AS lat FROM g_cost UNION ALL SELECT bx, b_y FROM g_cost) q)
SELECT edge_id, CAST(round_even(ax / 1e-5, 0) AS BIGINT) AS sx, CAST(round_even(ay / 1e-5, 0) AS BIGINT) AS sy, CAST(round_even(bx / 1e-5, 0) AS BIGINT) AS tx, CAST(round_even(b_y / 1e-5, 0) AS BIGINT) AS ty FROM g_cost""")
def topology(t: Tables) -> DataFrame:
    """Vertices are snapped end points; each edge finds both of its ends among them."""
    e = costed(t).select("edge_id", geo.grid_key(c("ax")).alias("sx"), geo.grid_key(c("ay")).alias("sy"), geo.grid_key(c("bx")).alias("tx"), geo.grid_key(c("b_y")).alias("ty"))
    v = e.select(c("sx").alias("kx"), c("sy").alias("ky")).union(e.select("tx", "ty")).distinct().select("kx", "ky", F.xxhash64("kx", "ky").alias("vertex"))
    s = v.select(c("kx").alias("sx"), c("ky").alias("sy"), c("vertex").alias("source"))
    x = v.select(c("kx").alias("tx"), c("ky").alias("ty"), c("vertex").alias("target"))
    return e.join(s, ["sx", "sy"]).join(x, ["tx", "ty"]).select("edge_id", "sx", "sy", "tx", "ty")


@query("i11_cell_raster", """
WITH p AS (SELECT edge_id, k, CAST(floor((ax + (bx - ax) * k / n) / 1e-3) AS BIGINT) AS cx, CAST(floor((ay + (b_y - ay) * k / n) / 1e-3) AS BIGINT) AS cy
  FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, CAST(greatest(ceil(greatest(abs(bx - ax), abs(b_y - ay)) / 5e-4), 1) AS BIGINT) AS n FROM g_cost) q) r)
SELECT edge_id, k, cx, cy FROM (SELECT *, lag(cx) OVER (PARTITION BY edge_id ORDER BY k) AS px, lag(cy) OVER (PARTITION BY edge_id ORDER BY k) AS py FROM p) z WHERE px IS NULL OR px <> cx OR py <> cy""")
def raster(t: Tables) -> DataFrame:
    """Grid cells along each edge, half a cell a step, without repeats."""
    n = F.greatest(F.ceil(F.greatest(F.abs(c("bx") - c("ax")), F.abs(c("b_y") - c("ay"))) / 5e-4), F.lit(1)).cast("long")
    p = costed(t).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), c("n"))))
    at = lambda a, b: geo.cell(c(a) + (c(b) - c(a)) * c("k") / c("n"), 1e-3)
    p = p.select("edge_id", "k", at("ax", "bx").alias("cx"), at("ay", "b_y").alias("cy"))
    w = Window.partitionBy("edge_id").orderBy("k")
    p = p.withColumns({"px": F.lag("cx").over(w), "py": F.lag("cy").over(w)})
    return p.filter("px IS NULL OR px <> cx OR py <> cy").select("edge_id", "k", "cx", "cy")


@query("a09_a10_adjacency_sink", """
SELECT s AS node_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t, w) AS targets, CAST(sum(w) AS BIGINT) AS weights, count(*) AS degree FROM g_arc GROUP BY s""")
def adjacency_sink(t: Tables) -> DataFrame:
    """Adjacency rows as written to the snapshot: targets and weights of each node."""
    a = arcs(t).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("out"))
    return a.select(
        c("s").alias("node_id"), F.concat_ws(",", F.transform("out", lambda o: o["t"].cast("string"))).alias("targets"),
        F.aggregate("out", F.lit(0).cast("long"), lambda x, o: x + o["w"]).alias("weights"), F.size("out").cast("long").alias("degree"),
    )


REQUESTS = [10, 30, 55]
_REQ = f"""q AS (SELECT CAST(k AS BIGINT) AS request_id, CAST({_ROOT} AS BIGINT) AS src, CAST({_ROOT} AS BIGINT) + k * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS dst FROM part, (VALUES (0), (10), (30), (55), (1000000)) v(k) GROUP BY k)"""


def requests(t: Tables) -> DataFrame:
    k = t.part.sparkSession.createDataFrame([(x,) for x in (0, 10, 30, 55, 1000000)], "request_id long")
    return k.crossJoin(F.broadcast(root(t))).select("request_id", "src", (c("src") + c("request_id") * F.when(c("request_id") % 2 == 0, 1).otherwise(-1)).alias("dst"))  # one depot row


@query("j01_j03_routes", f"""
WITH RECURSIVE {_reach(_SEED)}, {_REQ}
SELECT request_id, src, dst, CASE WHEN src = dst THEN 'trivial' WHEN n.node_id IS NULL THEN 'invalid' WHEN d.dist IS NULL THEN 'unreachable' ELSE 'ok' END AS status, CASE WHEN src = dst THEN 0 ELSE d.dist END AS cost
FROM q LEFT JOIN d ON d.node = q.dst LEFT JOIN g_node n ON n.node_id = q.dst""")
def routes(t: Tables) -> DataFrame:
    """All requests in one batch: distances once for each distinct start."""
    q = requests(t)
    d = graph.distances(arcs(t).select("s", "t", "w"), q.select("src").distinct(), targets=q.join(t.g_node.select(c("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")).select("src", c("node").alias("dst"), "g")
    known = t.g_node.select(c("node_id").alias("dst"), F.lit(True).alias("known"))
    q = q.join(d, ["src", "dst"], "left").join(known, "dst", "left")
    same = c("src") == c("dst")
    status = F.when(same, "trivial").when(c("known").isNull(), "invalid").when(c("g").isNull(), "unreachable").otherwise("ok")
    return q.select("request_id", "src", "dst", status.alias("status"), F.when(same, F.lit(0).cast("long")).otherwise(c("g")).alias("cost"))


@query("j02_path_costs", f"""
WITH RECURSIVE {_reach(_SEED)}, {_REQ}
SELECT request_id, d.dist AS cost, 0::BIGINT AS first_eta, true AS monotone FROM q JOIN d ON d.node = q.dst""")
def paths(t: Tables) -> DataFrame:
    """Paths by walking parents; the query reports each path's cost, first ETA, and that ETAs rise."""
    q = requests(t)
    tree = graph.distances(arcs(t).select("s", "t", "w"), q.select("src").distinct(), targets=q.join(t.g_node.select(c("node_id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    walk = graph.walk_back(tree, q)
    etas = F.array_sort(F.collect_list(F.struct("g", "node")))
    p = walk.groupBy("request_id").agg(F.max("g").alias("cost"), F.min("g").alias("first_eta"), etas.alias("p"), F.max_by("g", "hop").alias("h"))
    up = F.forall(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.coalesce(F.get("p", i)["g"] > F.get("p", i - 1)["g"], F.lit(True)))
    return p.select("request_id", "cost", "first_eta", up.alias("monotone"))


_FIX = "(SELECT event_id, lon + 7e-4 AS lon, lat + 3e-4 AS lat FROM e_fix)"


@query("c11_nearest_node", f"""
SELECT event_id, node_id, round(m, 4) AS metres FROM (SELECT f.event_id, n.node_id, m, row_number() OVER (PARTITION BY f.event_id ORDER BY round(m, 6), n.node_id) AS r
FROM {_FIX} f JOIN g_node n ON abs(n.lon - f.lon) <= 4e-3 AND abs(n.lat - f.lat) <= 4e-3,
LATERAL (SELECT 6371000e0 * 2e0 * asin(sqrt(power(sin(radians(n.lat - f.lat) / 2e0), 2e0) + cos(radians(f.lat)) * cos(radians(n.lat)) * power(sin(radians(n.lon - f.lon) / 2e0), 2e0))) AS m) x WHERE m <= 200e0) y WHERE r = 1""")
def nearest_node(t: Tables) -> DataFrame:
    """C11: nearest junction within 200 m, by joining each fix to its own and the neighbouring cells."""
    size, gate = 4e-3, 200.0
    f = t.e_fix.select("event_id", (c("lon") + 7e-4).alias("x"), (c("lat") + 3e-4).alias("y"))
    near = F.sequence(F.lit(-1), F.lit(1))
    f = f.withColumns({"cx": F.explode(F.transform(near, lambda d: geo.cell(c("x"), size) + d))}).withColumn("cy", F.explode(F.transform(near, lambda d: geo.cell(c("y"), size) + d)))
    n = t.g_node.select("node_id", "lon", "lat", geo.cell(c("lon"), size).alias("cx"), geo.cell(c("lat"), size).alias("cy"))
    m = f.join(n, ["cx", "cy"]).withColumn("m", geo.haversine_m(c("x"), c("y"), c("lon"), c("lat"))).filter(c("m") <= gate)
    best = m.groupBy("event_id").agg(F.min(F.struct(F.round("m", 6).alias("k"), "node_id", "m")).alias("b"))
    return best.select("event_id", "b.node_id", F.round("b.m", 4).alias("metres"))


@query("c12_c13_nearest_edge", f"""
SELECT event_id, edge_id, round(t, 4) AS share, CASE WHEN t <= 0.5e0 THEN source_id ELSE target_id END AS node_id FROM (
 SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(power((ax + (bx - ax) * t - lon) * kx, 2e0) + power(ay + (b_y - ay) * t - lat, 2e0), 14), edge_id) AS r FROM (
  SELECT f.event_id, f.lon, f.lat, e.*, cos(radians(f.lat)) AS kx, least(1e0, greatest(0e0, ((f.lon - ax) * cos(radians(f.lat)) * (bx - ax) * cos(radians(f.lat)) + (f.lat - ay) * (b_y - ay)) / (power((bx - ax) * cos(radians(f.lat)), 2e0) + power(b_y - ay, 2e0)))) AS t
  FROM {_FIX} f JOIN g_cost e ON least(ax, bx) <= f.lon + 3e-3 AND greatest(ax, bx) >= f.lon - 3e-3 AND least(ay, b_y) <= f.lat + 3e-3 AND greatest(ay, b_y) >= f.lat - 3e-3) q) s WHERE r = 1""")
def nearest_edge(t: Tables) -> DataFrame:
    """Nearest street of a fix within the box around it, share along it, and the nearer end.

    Streets are listed in every cell from which their box is near, so a fix looks into its own cell only and is dealt once.
    """
    size, pad = 3e-3, 3e-3
    f = t.e_fix.select("event_id", (c("lon") + 7e-4).alias("px"), (c("lat") + 3e-4).alias("py"))
    span = lambda lo, hi: F.explode(F.sequence(geo.cell(lo, size), geo.cell(hi, size)))
    e = costed(t).select("edge_id", "source_id", "target_id", "ax", "ay", "bx", "b_y")
    far = pad + 1e-9  # the exact test follows
    e = e.withColumn("cx", span(F.least("ax", "bx") - far, F.greatest("ax", "bx") + far)).withColumn("cy", span(F.least("ay", "b_y") - far, F.greatest("ay", "b_y") + far))
    n = tables.tasks_for(t.events, 20_000)
    f = f.withColumns({"cx": geo.cell(c("px"), size), "cy": geo.cell(c("py"), size)}).repartition(n, "cx", "cy")
    near_box = geo.boxes_meet((F.least("ax", "bx"), F.least("ay", "b_y"), F.greatest("ax", "bx"), F.greatest("ay", "b_y")), (c("px") - pad, c("py") - pad, c("px") + pad, c("py") + pad))
    j = f.join(e.repartition(n, "cx", "cy").hint("merge"), ["cx", "cy"]).filter(near_box)
    p = [c(k) for k in ("px", "py", "ax", "ay", "bx", "b_y")]
    key = F.round(F.pow(geo.segment_distance_deg(*p), 2.0), 14)
    best = j.groupBy("event_id").agg(F.min(F.struct(key.alias("k"), c("edge_id"), geo.project_share(*p).alias("t"), c("source_id"), c("target_id"))).alias("b"))
    return best.select("event_id", "b.edge_id", F.round("b.t", 4).alias("share"), F.when(c("b.t") <= 0.5, c("b.source_id")).otherwise(c("b.target_id")).alias("node_id"))


@query("c17_request_box", """
SELECT q.rid, count(*) AS edges FROM (SELECT edge_id AS rid, ax, ay, bx, b_y, greatest(1.5e-2, 0.3e0 * sqrt(power(bx - ax, 2e0) + power(b_y - ay, 2e0))) AS pad FROM g_cost WHERE kind >= 3) q
JOIN g_cost e ON least(e.ax, e.bx) <= greatest(q.ax, q.bx) + pad AND greatest(e.ax, e.bx) >= least(q.ax, q.bx) - pad AND least(e.ay, e.b_y) <= greatest(q.ay, q.b_y) + pad AND greatest(e.ay, e.b_y) >= least(q.ay, q.b_y) - pad GROUP BY q.rid""")
def request_box(t: Tables) -> DataFrame:
    """C17: edges near the box of each request (from end to end of an express link), joined on coarse cells and then tested."""
    size = 2e-2
    e = costed(t)
    pad = F.greatest(F.lit(1.5e-2), 0.3 * F.sqrt(F.pow(c("bx") - c("ax"), 2.0) + F.pow(c("b_y") - c("ay"), 2.0)))
    q = e.filter("kind >= 3").select(
        c("edge_id").alias("rid"), (F.least("ax", "bx") - pad).alias("x0"), (F.least("ay", "b_y") - pad).alias("y0"), (F.greatest("ax", "bx") + pad).alias("x1"), (F.greatest("ay", "b_y") + pad).alias("y1"))
    b = e.select("edge_id", F.least("ax", "bx").alias("u0"), F.least("ay", "b_y").alias("v0"), F.greatest("ax", "bx").alias("u1"), F.greatest("ay", "b_y").alias("v1"))
    cells = lambda df, x0, y0, x1, y1: df.withColumn("cx", F.explode(F.sequence(geo.cell(c(x0), size), geo.cell(c(x1), size)))).withColumn("cy", F.explode(F.sequence(geo.cell(c(y0), size), geo.cell(c(y1), size))))
    j = cells(q, "x0", "y0", "x1", "y1").join(cells(b, "u0", "v0", "u1", "v1"), ["cx", "cy"])
    # a pair may share several cells; it counts in the first one only
    first = (c("cx") == geo.cell(F.greatest("x0", "u0"), size)) & (c("cy") == geo.cell(F.greatest("y0", "v0"), size))
    meet = geo.boxes_meet((c("u0"), c("v0"), c("u1"), c("v1")), (c("x0"), c("y0"), c("x1"), c("y1")))
    return j.filter(first & meet).groupBy("rid").agg(F.count("*").alias("edges"))


@query("i16_i17_landmark_bounds", f"""
WITH RECURSIVE {_reach(_SEED)},
 b(node, dist) USING KEY (node) AS (SELECT CAST(node AS BIGINT), CAST(0 AS BIGINT) FROM ({_SEED}) z
  UNION SELECT a.s, CAST(min(b.dist + a.w) AS BIGINT) FROM b JOIN g_arc a ON a.t = b.node LEFT JOIN recurring.b r ON r.node = a.s WHERE r.dist IS NULL OR b.dist + a.w < r.dist GROUP BY a.s),
 l AS (SELECT d.node, least(d.dist, 65534) AS d_from, least(b.dist, 65534) AS d_to FROM d JOIN b ON b.node = d.node)
SELECT e.edge_id AS request_id, greatest(x.d_to - y.d_to, y.d_from - x.d_from, 0) AS bound FROM g_edge e JOIN l x ON x.node = e.source_id JOIN l y ON y.node = e.target_id""")
def bounds(t: Tables) -> DataFrame:
    """Landmark table with the depot as landmark, and lower bounds for the ends of all edges."""
    a = arcs(t).select("s", "t", "w")
    table = graph.landmark_table(a, [root(t).first().src])
    pairs = t.g_edge.select(c("edge_id").alias("request_id"), c("source_id").alias("src"), c("target_id").alias("dst"))
    return graph.landmark_bounds(table, pairs).select("request_id", "bound")
