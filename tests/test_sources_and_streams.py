"""Sources, sinks, build stages, and streams against their batch twins."""

import json
import time

import pytest
from pyspark.sql import functions as F

from roadspark.operators import build, tables, traffic
from roadspark.sources import osm
from roadspark.sources.fixtures import Tables
from roadspark.streaming import streams


# ------------------------------------------------------------------ elements
ELEMENTS = {
    "elements": [
        {"type": "node", "id": 1, "lat": 55.0, "lon": 37.0, "tags": {"barrier": "gate"}},
        {"type": "node", "id": 2, "lat": 55.1, "lon": 37.1},
        {"type": "node", "id": 3, "lat": 55.2, "lon": 37.2},
        {"type": "way", "id": 10, "nodes": [3, 2, 99, 1], "tags": {"highway": "primary", "lanes": "2", "name": "A"}},
        {"type": "way", "id": 11, "nodes": [1, 98], "tags": {"highway": "footway"}},
        {"type": "relation", "id": 20, "tags": {"type": "restriction", "restriction": "no_u_turn"}, "members": [{"type": "way", "ref": 10, "role": "from"}]},
        {"type": "relation", "id": 21, "tags": {"type": "route"}},
    ]
}


def test_elements_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ELEMENTS, indent=1))
    e = osm.read_elements(spark, str(tmp_path / "*.json"))
    ways, barriers, restrictions = osm.split_elements(e)
    assert (ways.count(), barriers.count(), restrictions.count()) == (2, 1, 1)
    w = osm.assemble_ways(ways, osm.node_coordinates(e)).collect()
    assert [(r.osm_id, r.lanes, r.name, [p.lon for p in r.geom]) for r in w] == [(10, 2, "A", [37.2, 37.1, 37.0])]
    found = {(r.type, r.id) for r in osm.extract(e, (36.9, 54.9, 37.05, 55.05)).collect()}
    assert found == {("node", 1), ("way", 10), ("relation", 20)}


def test_geojson_and_hull(spark):
    df = spark.createDataFrame([(1, [(37.0, 55.0), (37.1, 55.2)])], "id long, line array<struct<lon:double,lat:double>>")
    f = df.select(osm.feature(F.col("id"), F.col("line"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("f"))
    got = json.loads(f.agg(osm.collection(F.collect_list("f")).alias("c")).first().c)
    assert got["features"][0]["properties"] == {"a": "1", "b": "3"} and got["features"][0]["geometry"]["coordinates"] == [[37.0, 55.0], [37.1, 55.2]]
    points = spark.createDataFrame([(1, float(x), float(y)) for x in range(5) for y in range(5)], "component long, lon double, lat double")
    hull = osm.hull_per_group(points).first()
    assert hull.n_points == 25 and sorted(set(hull.wkt[len("POLYGON((") : -2].split(", "))) == ["0.0 0.0", "0.0 4.0", "4.0 0.0", "4.0 4.0"]


def test_csv_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 37.0, 55.0)], "node_id long, lon double, lat double")
    osm.write_components(spark.createDataFrame([(1, 1)], "node long, component long"), nodes, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1
    for k in (1, 2):
        (tmp_path / f"r{k}.csv").write_text("timestamp,num_waypoints,euclidean_dist_km,route_dist_km,tortuosity,k,duration_ms,sei_ms_km,complexity_factor,inputs,success,error_type\n1,2,3,4,1.3,1,5,1.2,6,x,1,None\n")
    r = osm.read_results(spark, str(tmp_path / "r*.csv"))
    assert r.count() == 2 and r.first().num_waypoints == 2


def test_logs(spark):
    line = {"record": {"level": {"name": "ERROR"}, "name": "router", "message": "m", "function": "f", "line": 3, "module": "x", "time": {"repr": "2024-01-01 10:00:00"}, "extra": {"agent_id": "a"}, "exception": {"type": "ValueError"}}}
    r = osm.log_rows(spark.createDataFrame([(json.dumps(line),), ("broken",)], "value string")).collect()
    assert (r[0].level, r[0].logger, r[0].exception, r[0].agent_id) == ("ERROR", "router", "ValueError", "a") and r[1].level is None


def test_build_stages_skip_and_redo(spark, tmp_path):
    ran = []

    def stage(name, make):
        def run(t):
            ran.append(name)
            return make(t)

        return name, run

    stages = [stage("a", lambda t: spark.range(3)), stage("b", lambda t: t["a"].filter("id > 0"))]
    assert build.build(spark, str(tmp_path), stages)["b"].count() == 2
    build.build(spark, str(tmp_path), stages)
    assert ran == ["a", "b"]
    build.build(spark, str(tmp_path), stages, redo=("b",))
    assert ran == ["a", "b", "b"]


def test_running_sums(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("v"))
    got = {r.id: r.s for r in tables.with_running_sums(df, "id", {"s": F.col("v")}, 4).collect()}
    assert got == {i: sum(k % 7 for k in range(i)) for i in range(50)}


# -------------------------------------------------------------------- streams
@pytest.fixture(scope="module")
def feed(spark, sf, tmp_path_factory):
    """Events in three files, written one after another in order of time."""
    folder = str(tmp_path_factory.mktemp("feed") / "events")
    e = spark.read.parquet(f"{sf}/events.parquet")
    a, b = e.select(F.percentile_approx(traffic.epoch_s("ts"), [0.33, 0.66])).first()[0]
    for low, high in ((0, a), (a, b), (b, 1e12)):
        e.filter((traffic.epoch_s("ts") > low) & (traffic.epoch_s("ts") <= high)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # the source goes by whole seconds of the files' times
    return folder, e.schema


def run(stream, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_volume_stream_equals_batch(spark, feed, tmp_path):
    s = streams.read_events(spark, *feed).select(F.col("user_id").alias("node_id"), "ts", F.when(F.col("event_id") % 5 == 0, -1).otherwise(1).alias("delta"))
    got = {(r.node_id, r.s): r.volume for r in run(streams.volume_stream(s, "400 days"), tmp_path, "complete").withColumn("s", F.floor(F.unix_timestamp("starts") / 300)).collect()}
    b = spark.read.parquet(feed[0]).select(F.col("user_id").alias("node_id"), traffic.epoch_s("ts").alias("seconds"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(1).alias("delta"))
    assert got == {(r.node_id, r.slot): r.volume for r in traffic.book(b).collect()}


def test_late_bookings_are_dropped(spark, feed, tmp_path):
    s = streams.read_events(spark, *feed).select(F.col("user_id").alias("node_id"), "ts", F.lit(1).alias("delta"))
    got = run(streams.volume_stream(s, "1 hour"), tmp_path)
    assert 0 < got.count() <= spark.read.parquet(feed[0]).count()


def test_rates_and_histograms(spark, feed, sf, tmp_path):
    e = streams.read_events(spark, *feed).select("ts", F.col("value").alias("duration_ms"), (F.col("event_id") % 37 + 1).alias("edges_found"), (F.col("event_type") != "error").cast("int").alias("success"))
    n = spark.read.parquet(feed[0]).count()
    assert run(streams.success_stream(e, "400 days"), tmp_path / "a", "complete").agg(F.sum("n")).first()[0] == n
    assert run(streams.rate_stream(e, "400 days"), tmp_path / "b", "complete").agg(F.sum("n")).first()[0] == 4 * n
    h = run(streams.histogram_stream(e, [10.0, 1e9], "400 days"), tmp_path / "c", "complete")
    assert h.filter("le = 1e9").agg(F.sum("n")).first()[0] == n


def test_teleports_equal_batch(spark, feed, sf, tmp_path):
    fix = [F.col("user_id").alias("agent_id"), "event_id", "ts", ((F.col("event_id") % 97) * 2e-3 + 37.3).alias("lon"), ((F.col("event_id") % 89) * 2e-3 + 55.45).alias("lat"), (F.col("event_type") != "error").alias("is_running")]
    got = {r.event_id for r in run(streams.teleport_stream(streams.read_events(spark, *feed).select(*fix), 5.0), tmp_path).collect()}
    want = {r.event_id for r in traffic.teleports(Tables(spark, sf).e_fix, most_kmh=5.0).select("event_id").collect()}
    assert got == want


def test_trips(spark, feed, tmp_path):
    s = streams.read_events(spark, *feed).select(F.col("user_id").alias("agent_id"), "ts", F.col("value").alias("speed_kmh"))
    assert run(streams.trip_stream(s, late="400 days"), tmp_path, "complete").agg(F.sum("fixes")).first()[0] == spark.read.parquet(feed[0]).count()


def test_micro_batch_upsert(spark, feed, tmp_path):
    s = streams.read_events(spark, *feed).select("user_id", "event_id", "value", "ts")
    path = str(tmp_path / "table")
    q = s.writeStream.foreachBatch(streams.upsert_into(path, ["user_id"], ["ts", "event_id"])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = {r.user_id: r.event_id for r in spark.read.parquet(streams.current(spark, path)).collect()}
    e = spark.read.parquet(feed[0]).groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("e"))
    assert got == {r.user_id: r.e for r in e.collect()}


def test_bucketed_upsert_touches_few_files(spark, tmp_path):
    path, kind = str(tmp_path / "table"), "k long, v string, at long"
    merge = streams.upsert_buckets(path, ["k"], ["at"], buckets=8)
    schema = spark.createDataFrame([], kind).schema
    rows = lambda: {r.k: (r.v, r.at) for r in streams.read_buckets(spark, path, schema).collect()}
    merge(spark.createDataFrame([(k, "a", 1) for k in range(100)], kind), 0)
    assert rows() == {k: ("a", 1) for k in range(100)} and set(streams.manifest(spark, path).values()) == {0}
    merge(spark.createDataFrame([(7, "b", 2), (7, "old", 0), (200, "c", 2)], kind), 1)
    want = {**{k: ("a", 1) for k in range(100)}, 7: ("b", 2), 200: ("c", 2)}
    assert rows() == want
    generations = streams.manifest(spark, path)
    assert 1 <= sum(g == 1 for g in generations.values()) <= 2 and len(generations) == 8
    # a batch that wrote its data and died before its manifest: readers do not see it, and it can be run again
    import shutil

    before = streams.manifest(spark, path)
    merge(spark.createDataFrame([(k, "lost", 3) for k in range(50)], kind), 2)
    shutil.rmtree(f"{path}/manifest/{2:09d}")
    assert streams.manifest(spark, path) == before and rows() == want
    for _ in range(2):
        merge(spark.createDataFrame([(3, "d", 3)], kind), 2)
    assert rows() == {**want, 3: ("d", 3)}
    merge(spark.createDataFrame([], kind), 3)
    assert rows() == {**want, 3: ("d", 3)}


def test_old_tasks_expire(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    at = lambda h: day + dt.timedelta(hours=h)
    batches = [[("a", at(0), 0.0, 10.0), ("b", at(0), 1.0, 4.0), ("a", at(1), 5.0, 10.0)], [("b", at(20), 2.0, 4.0)], [("c", at(40), 0.0, 1.0)], [("c", at(41), 1.0, 1.0)]]
    folder = str(tmp_path / "in")
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "task string, ts timestamp, done double, total double").coalesce(1).write.parquet(f"{folder}/{k}")
        for f in os.listdir(f"{folder}/{k}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{folder}/all", exist_ok=True)
                os.rename(f"{folder}/{k}/{f}", f"{folder}/all/{k}-{f}")
                os.utime(f"{folder}/all/{k}-{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = spark.read.parquet(f"{folder}/all").schema
    got = run(streams.task_stream(streams.read_events(spark, f"{folder}/all", schema), 86_400.0), tmp_path / "out").collect()
    news = sorted((r.task, r.percent, r.left_s) for r in got if not r.expired)
    assert ("a", 50.0, 3600.0) in news and ("b", 50.0, 72_000.0) in news and ("c", 100.0, 0.0) in news
    # a has been silent since hour 1 when the clock of the events passes hour 25; b since hour 20 is younger than a day at hour 41
    assert [r.task for r in got if r.expired] == ["a"]


def test_hull_equals_brute_force(spark):
    """A point is a corner unless it lies in a triangle of others or on a line between two; round and flat sets too."""
    import math
    import random

    rng = random.Random(3)
    sets = [[(rng.random(), rng.random()) for _ in range(40)] for _ in range(10)]
    sets.append([(math.cos(k), math.sin(k)) for k in range(25)])
    sets += [[(float(k), 2.0 * k) for k in range(6)], [(1.0, 1.0)] * 4, [(0.0, 0.0), (3.0, 1.0)]]

    def corners(points):
        points = sorted(set(points))
        side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        out = set()
        for a in points:
            for b in points:
                # an edge of the hull has all points on one side, and those on its line between its ends
                if a != b and all(side(a, b, p) > 0 or side(a, b, p) == 0 and min(a, b) <= p <= max(a, b) for p in points):
                    out |= {a, b}
        return out or set(points)

    rows = [(k, x, y) for k, points in enumerate(sets) for x, y in points]
    got = {r.component: r for r in osm.hull_per_group(spark.createDataFrame(rows, "component long, lon double, lat double").repartition(7)).collect()}
    for k, points in enumerate(sets):
        kind, text = got[k].wkt.split("(", 1)
        ring = {tuple(map(float, p.split())) for p in text.strip("()").split(", ")}
        assert kind == {1: "POINT", 2: "LINESTRING"}.get(len(corners(points)), "POLYGON") and ring == corners(points) and got[k].n_points == len(points)
