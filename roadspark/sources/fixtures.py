"""A road network, its traffic and its logs, read out of the star-schema tables.

Each view is SQL that Spark and DuckDB both understand, so a query's SQL twin can
inline the same views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    # lattice of junctions, 100 wide
    "g_node": """
SELECT p_partkey AS node_id, 37.3e0 + (p_partkey % 100) * 2e-3 AS lon,
       55.45e0 + CAST(floor(p_partkey / 100e0) AS BIGINT) * 2e-3 AS lat FROM part""",
    # streets between them, with express links
    "g_edge": """
SELECT d.s * 10 + d.kind AS edge_id, d.s AS source_id, d.t AS target_id, d.kind AS kind,
       CASE d.kind WHEN 1 THEN 'residential' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'primary' ELSE 'motorway' END AS highway,
       CASE WHEN p_size % 7 = 0 THEN 1 WHEN p_size % 7 = 1 THEN -1 ELSE 0 END AS oneway,
       CASE WHEN p_size % 3 = 0 THEN CAST(20 + p_size AS VARCHAR(8)) WHEN p_size % 3 = 1 THEN 'RU:urban' END AS maxspeed,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE 1 + p_size % 4 END AS lanes,
       CASE WHEN p_size % 13 = 0 THEN 1 ELSE 0 END AS z_layer
FROM (SELECT p_partkey AS s, p_partkey + 1 AS t, 1 AS kind FROM part WHERE p_partkey % 100 < 99
      UNION ALL SELECT p_partkey, p_partkey + 100, 2 FROM part
      UNION ALL SELECT p_partkey, p_partkey + 10, 3 FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 100 < 90
      UNION ALL SELECT p_partkey, p_partkey + 1000, 4 FROM part
        WHERE p_partkey % 10 = 0 AND CAST(floor(p_partkey / 100e0) AS BIGINT) % 10 = 0) d
JOIN part p ON p.p_partkey = d.s JOIN g_node n ON n.node_id = d.t""",
    # edges with cost attributes: endpoints, length, speed, seconds both ways, whole-second weight
    "g_cost": """
SELECT y.*, CASE WHEN oneway = -1 THEN -1e0 ELSE secs END AS cost, CASE WHEN oneway = 1 THEN -1e0 ELSE secs END AS reverse_cost,
       greatest(CAST(round(secs) AS BIGINT), 1) AS w
FROM (SELECT x.*, length_m / greatest((speed + 19e0) / 3.6e0, 1e-1) AS secs
FROM (SELECT e.*, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS b_y,
             6371000e0 * 2e0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2e0), 2e0) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2e0), 2e0))) AS length_m,
             CASE WHEN maxspeed IS NOT NULL AND maxspeed <> 'RU:urban' THEN CAST(regexp_replace(maxspeed, '[^0-9]', '') AS DOUBLE)
                  ELSE CASE highway WHEN 'motorway' THEN 110e0 WHEN 'primary' THEN 60e0 WHEN 'tertiary' THEN 50e0 WHEN 'residential' THEN 20e0 ELSE 30e0 END END AS speed
      FROM g_edge e JOIN g_node a ON a.node_id = e.source_id JOIN g_node b ON b.node_id = e.target_id) x) y""",
    # legal directions
    "g_arc": """
SELECT edge_id, source_id AS s, target_id AS t, w FROM g_cost WHERE oneway <> -1
UNION ALL SELECT edge_id, target_id, source_id, w FROM g_cost WHERE oneway <> 1""",
    "g_restriction": """
SELECT p_partkey AS rel_id, (p_partkey - 1) * 10 + 1 AS from_edge, p_partkey AS via_node, p_partkey * 10 + 2 AS to_edge,
       CASE WHEN p_size % 2 = 0 THEN 'no_left_turn' ELSE 'only_straight_on' END AS restriction
FROM part WHERE p_size % 11 = 0 AND p_partkey % 100 > 0""",
    "w_node": """
SELECT way_id, CAST(row_number() OVER (PARTITION BY way_id ORDER BY ln, node_id, sk, ep) AS BIGINT) AS seq, node_id
FROM (SELECT l_orderkey AS way_id, l_linenumber AS ln, l_partkey AS node_id, l_suppkey AS sk, l_extendedprice AS ep FROM lineitem) x""",
    "w_way": """
SELECT o_orderkey AS way_id,
       CASE o_orderkey % 8 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary'
            WHEN 4 THEN 'residential' WHEN 5 THEN 'service' WHEN 6 THEN 'footway' ELSE 'tertiary_link' END AS highway,
       CASE o_orderkey % 9 WHEN 0 THEN 'private' WHEN 1 THEN 'permissive' WHEN 2 THEN 'delivery' END AS access,
       CASE o_orderkey % 17 WHEN 0 THEN 'gate' WHEN 1 THEN 'toll_booth' END AS barrier,
       CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' END AS oneway,
       CASE o_orderkey % 6 WHEN 0 THEN '2' WHEN 1 THEN '2;3' WHEN 2 THEN '4' END AS lanes,
       CASE o_orderkey % 7 WHEN 0 THEN '60' WHEN 1 THEN 'RU:urban' WHEN 2 THEN '90' END AS maxspeed,
       CASE o_orderkey % 11 WHEN 0 THEN '1' WHEN 1 THEN '-1' END AS layer,
       CASE WHEN o_orderkey % 19 = 0 THEN 'yes' END AS bridge, CASE WHEN o_orderkey % 23 = 0 THEN 'yes' END AS tunnel,
       o_orderdate AS created_at
FROM orders""",
    # way vertices with coordinates
    "w_vertex": "SELECT w.way_id, w.seq, w.node_id, n.lon, n.lat FROM w_node w JOIN g_node n ON n.node_id = w.node_id",
    # way boxes
    "w_box": "SELECT way_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, count(*) AS n_points FROM w_vertex GROUP BY way_id",
    "r_route_edge": "SELECT DISTINCT o_custkey AS request_id, o_orderkey AS route_id, l_partkey AS edge_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "e_fix": """
SELECT event_id, user_id AS agent_id, ts, value AS speed_kmh, 37.3e0 + (event_id % 97) * 2e-3 AS lon, 55.45e0 + (event_id % 89) * 2e-3 AS lat,
       event_type <> 'error' AS is_running FROM events""",
    "e_booking": "SELECT event_id, user_id AS node_id, ts, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS delta FROM events",
    "e_request": """
SELECT event_id, ts, value AS duration_ms, 1 + event_id % 5 AS k, 2 + event_id % 4 AS num_waypoints,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success,
       CASE WHEN event_type <> 'error' THEN 'None' WHEN event_id % 3 = 0 THEN 'Timeout' WHEN event_id % 3 = 1 THEN 'No Path Found' ELSE 'Other Error' END AS error_type,
       1 + event_id % 37 AS edges_found, 5e-1 + (event_id % 41) / 4e0 AS e_dist_km FROM events""",
    "e_tile_event": """
SELECT event_id, ts, user_id AS tile_no,
       CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'downloading' WHEN 2 THEN 'complete' ELSE 'failed' END AS status,
       event_id % 50 AS ways_count FROM events""",
}

#: Tables that grow as the view does and are not broadcast to it, however small their files.
DEALT = {"g_edge": ("part", "g_node")}

_NAME = re.compile(r"(\b(?:FROM|JOIN)\s+)(" + "|".join(sorted([*BASE, *VIEWS], key=len, reverse=True)) + r")\b", re.I)


class Tables:
    """Base tables and views of one data folder as DataFrames: ``Tables(spark, dir).g_edge``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in BASE:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.sql(VIEWS[name], DEALT.get(name, ())) if name in VIEWS else self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str, dealt: tuple = ()) -> DataFrame:
        """SQL over base tables and views; those in ``dealt`` are joined by merging."""
        used = {m[2].lower() for m in _NAME.finditer(text)}
        table = lambda n: getattr(self, n).hint("merge") if n in dealt else getattr(self, n)
        return self._spark.sql(_NAME.sub(lambda m: m[1] + "{" + m[2].lower() + "}", text), **{n: table(n) for n in used})


def _needs(text: str, out: list[str]) -> list[str]:
    for m in _NAME.finditer(text):
        name = m[2].lower()
        if name in VIEWS and name not in out:
            _needs(VIEWS[name], out)
            out.append(name)
    return out


def with_views(text: str, recursive: bool = False) -> str:
    """``text`` with the views it uses put before it as CTEs; text may begin with its own WITH."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in _needs(text, []))
    body = text.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if own:
        recursive, body = recursive or bool(own[1]), body[own.end() :]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return body if not ctes and not own else head + ctes + (", " if ctes and own else "\n" if ctes else "") + body
