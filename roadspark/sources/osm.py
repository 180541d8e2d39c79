"""Map elements: reading, splitting, filtering, assembling ways, and writing features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import geo, road

ELEMENT = (
    "type:string,id:long,lat:double,lon:double,nodes:array<long>,tags:map<string,string>,"
    "members:array<struct<type:string,ref:long,role:string>>"
)
BARRIERS = ["bollard", "gate", "lift_gate", "block", "cycle_barrier", "fence", "wall", "swing_gate", "chain", "barrier", "jersey_barrier"]


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row an element, from documents {elements: [...]}; the schema is fixed, so nothing is inferred."""
    docs = spark.read.schema(f"elements array<struct<{ELEMENT}>>").option("multiLine", True).json(path)
    return docs.select(F.explode("elements").alias("e")).select("e.*")


def split_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ways, barrier nodes, turn restrictions)."""
    return (
        elements.filter("type = 'way'"),
        elements.filter((F.col("type") == "node") & F.map_contains_key("tags", "barrier")),
        elements.filter((F.col("type") == "relation") & (F.element_at("tags", "type") == "restriction")),
    )


def node_coordinates(elements: DataFrame) -> DataFrame:
    return elements.filter("type = 'node'").select(F.col("id").alias("node_id"), "lon", "lat").dropDuplicates(["node_id"])


def assemble_ways(ways: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(osm_id, geom, tags, highway, name, lanes, maxspeed): lines in node order.

    Nodes without coordinates are dropped; ways with fewer than two points are left out.
    """
    at = ways.select(F.col("id").alias("osm_id"), F.posexplode("nodes").alias("pos", "node_id")).join(coordinates, "node_id")
    lines = at.groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).filter(F.size("p") >= 2)
    geom = F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    tag = lambda k: F.element_at("tags", k)
    return lines.join(ways.select(F.col("id").alias("osm_id"), "tags"), "osm_id").select(
        "osm_id", geom.alias("geom"), "tags", tag("highway").alias("highway"), tag("name").alias("name"), road.lanes(tag("lanes")).alias("lanes"), tag("maxspeed").alias("maxspeed")
    )


def extract(elements: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Elements to load for a box: tagged nodes in it, drivable ways with any node in it, barriers, restrictions."""
    x0, y0, x1, y1 = box
    inside = F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1)
    nodes = elements.filter((F.col("type") == "node") & inside & (F.size("tags") > 0))
    near = elements.filter((F.col("type") == "node") & inside).select(F.col("id").alias("node_id")).distinct()
    ways = elements.filter((F.col("type") == "way") & (F.element_at("tags", "highway").isin(road.CANDIDATE_HIGHWAYS) | F.element_at("tags", "barrier").isin(BARRIERS)))
    hit = ways.select("id", F.explode("nodes").alias("node_id")).join(near, "node_id", "left_semi").select("id").distinct()
    relations = elements.filter((F.col("type") == "relation") & (F.element_at("tags", "type") == "restriction"))
    return nodes.union(ways.join(hit, "id", "left_semi").select(*nodes.columns)).union(relations)


def feature(id_: Column, line: Column, properties: Column, tags: Column) -> Column:
    """GeoJSON feature text; ``properties`` (a map) gives way to tags of the same name."""
    points = F.transform(line, lambda p: F.array(p["lon"], p["lat"]))
    shape = F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))
    # the later of two equal keys wins, without relying on a session setting
    merged = F.map_concat(F.map_filter(properties, lambda k, v: ~F.map_contains_key(tags, k)), tags)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), id_.alias("id"), shape.alias("geometry"), merged.alias("properties")))


def collection(features: Column) -> Column:
    """GeoJSON text of an array of feature texts."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", features), F.lit("]}"))


def write_components(members: DataFrame, nodes: DataFrame, path: str) -> None:
    """CSV (node_id, lon, lat, component)."""
    members.join(nodes.select(F.col("node_id").alias("node"), "lon", "lat"), "node").select(F.col("node").alias("node_id"), "lon", "lat", "component").write.csv(path, header=True)


RESULT = "timestamp double, num_waypoints int, euclidean_dist_km double, route_dist_km double, tortuosity double, k int, duration_ms double, sei_ms_km double, complexity_factor double, inputs string, success int, error_type string"


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """All result CSVs that the glob names, as one table with a fixed schema."""
    return spark.read.csv(glob, header=True, schema=RESULT)


def log_rows(lines: DataFrame) -> DataFrame:
    """Labelled log rows from a text column ``value``; works on streams too."""
    schema = "record struct<level:struct<name:string>,name:string,message:string,function:string,line:int,module:string,time:struct<repr:string>,extra:struct<thread_id:string,agent_id:string>,exception:struct<type:string>>"
    r = lines.select(F.from_json("value", schema).alias("j")).select("j.record.*")
    return r.select(
        F.col("level.name").alias("level"), F.col("name").alias("logger"), "message", "function", "line", "module",
        F.to_timestamp("time.repr").alias("ts"), F.col("extra.thread_id").alias("thread_id"), F.col("extra.agent_id").alias("agent_id"), F.col("exception.type").alias("exception"),
    )


def ring_of(points) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the westernmost; monotone chain."""
    pts = sorted(set(points))

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return pts if len(pts) < 3 else half(pts)[:-1] + half(pts[::-1])[:-1]


def hull_per_group(points: DataFrame) -> DataFrame:
    """(component, wkt, n_points): convex hull of each group of (component, lon, lat); a POINT or a LINESTRING where that is all it spans.

    Each task first reduces every group's points of a batch to the corners of their own hull: a
    corner of the whole is a corner of every part that holds it. So what reaches the last
    hull of a group are the corners of its parts.
    """
    import pandas as pd

    def corners(frames):
        for pdf in frames:
            rows = [(k, len(g), x, y) for k, g in pdf.groupby("component") for x, y in ring_of(zip(g.lon, g.lat))]
            out = pd.DataFrame(rows, columns=["component", "n", "lon", "lat"])
            out["n"] = out["n"].where(~out.duplicated("component"), 0)  # each part is counted once
            yield out

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = ring_of(zip(pdf.lon, pdf.lat))
        text = ", ".join(f"{x} {y}" for x, y in (ring if len(ring) < 3 else [*ring, *ring[:1]]))
        wkt = f"POINT({text})" if len(ring) == 1 else f"LINESTRING({text})" if len(ring) == 2 else f"POLYGON(({text}))"
        return pd.DataFrame({"component": [pdf.component.iloc[0]], "wkt": [wkt], "n_points": [int(pdf.n.sum())]})

    parts = points.select("component", "lon", "lat").mapInPandas(corners, "component long, n long, lon double, lat double")
    return parts.groupBy("component").applyInPandas(hull, "component long, wkt string, n_points long")
