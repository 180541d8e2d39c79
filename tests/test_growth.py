"""What must not grow with the input: rounds of a search, slots of a leg, copies of a fix, rows of a task."""

from pyspark.sql import functions as F

from roadspark.operators import alternatives, search, tables, traffic
from roadspark.plans import analytics, mapping, mobility, network
from roadspark.sources.fixtures import Tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_leg_of_any_length_meets_two_slots(spark):
    legs = spark.createDataFrame([(1, 0, 0, 700, 0.0, 0.0, 7.0, 0.0), (1, 1, 700, 10**13, 7.0, 0.0, 8.0, 0.0), (2, 0, 5, 5, 0.0, 0.0, 1.0, 0.0)], "route_id long, seq long, eta long, next_eta long, x0 double, y0 double, x1 double, y1 double")
    at = spark.createDataFrame([(0,), (699,), (700,), (10**13 - 1,), (10**13,)], "at long")
    got = {(r.route_id, r.at): r.seq for r in traffic.positions_at(legs, at, 500).collect()}
    assert got == {(1, 0): 0, (1, 699): 0, (1, 700): 1, (1, 10**13 - 1): 1}


def test_a_fix_is_dealt_once(spark, sf):
    assert _plan(network.nearest_edge(Tables(spark, sf))).count("Generate explode") == 2  # the streets' two


def test_route_edges_take_more_parts_as_they_grow(spark, sf, monkeypatch):
    monkeypatch.setattr(analytics, "ROUTE_ROWS", 500)
    t = Tables(spark, sf)
    n = -(-t.lineitem.count() // 500)
    assert analytics.route_edges(t).rdd.getNumPartitions() == n == tables.tasks_for(t.lineitem, 500)
    assert analytics.route_edges(t).exceptAll(t.r_route_edge).isEmpty() and t.r_route_edge.exceptAll(analytics.route_edges(t)).isEmpty()


def test_routes_that_share_nothing_are_not_paired(spark, monkeypatch):
    rows = [(1, 10, 1), (1, 10, 2), (1, 11, 2), (1, 12, 9), (2, 20, 1), (3, 30, 1), (3, 31, 1)]
    edges = spark.createDataFrame(rows, "request_id long, route_id long, edge_id long")
    monkeypatch.setattr(analytics, "route_edges", lambda t: edges)
    got = {r.request_id: tuple(r)[1:] for r in analytics.jaccard(None).collect()}
    assert got == {1: (3, 0.166667, 0.0, 0.5), 2: (1, 1.0, 1.0, 1.0), 3: (2, 1.0, 1.0, 1.0)}


def test_pairs_of_crossing_streets_are_found_once_without_an_aggregate(spark, sf):
    x = mobility.crossings(Tables(spark, sf))
    assert "Aggregate" not in _plan(x)
    assert x.groupBy("e1", "e2").count().filter("count > 1").isEmpty()


def test_points_of_tile_parts_are_not_looked_up_by_place(spark, sf):
    assert "get(" not in _plan(mapping.feature_rows(Tables(spark, sf)))


def test_repeated_points_leave_one_and_tall_lines_reach_their_tiles(spark):
    lines = [(1, 1, 0.0, 0.0), (1, 2, 0.00001, 0.0), (1, 3, 0.02, 0.0), (1, 4, 0.02, 0.0), (2, 1, 0.01, 0.01), (2, 2, 0.0100001, 0.01), (3, 1, 0.05, 60.0), (3, 2, 0.05, 62.0)]
    points = spark.createDataFrame([(*p, 1) for p in lines], "way_id long, seq long, lon double, lat double, importance int")
    zooms = spark.createDataFrame([(10, k) for k in (1, 2, 3)], "zoom long, way_id long")
    got = mapping.mapping.tile_parts(points, zooms).collect()
    assert {r.points for r in got if r.way_id == 1 and r.y == 512 and r.x == 512} == {"0,0 233,0"}
    assert not [r for r in got if r.way_id == 2]
    high = sorted(r.y for r in got if r.way_id == 3)
    assert high == list(range(high[0], high[0] + len(high))) and len(high) > 10


def test_rounds_of_a_search_do_not_grow_with_the_graph(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL_NODES", 8)
    arcs = spark.range(256).select(F.col("id").alias("s"), (F.col("id") + 1).alias("t"), F.lit(1).alias("w"))
    seen = []
    got = search.search(search.prepare(arcs), spark.createDataFrame([(0, 0)], "src long, node long"), seen=seen)
    assert len(seen) <= search.CELLS + 1
    assert got.agg(F.count("*"), F.sum("g")).first() == (257, 256 * 257 // 2)
    assert search.cell_size(10**9) == search.MOST_NODES


def test_alternatives_are_cut_by_their_own_answer(spark, monkeypatch):
    goals = []
    whole = alternatives.search
    monkeypatch.setattr(alternatives, "search", lambda *a, **k: goals.append(k["goals"].count()) or whole(*a, **k))
    arcs = spark.createDataFrame([(1, 2, 1), (2, 4, 1), (1, 3, 2), (3, 4, 2), (4, 5, 1)], "s long, t long, w long")
    asked = spark.createDataFrame([(7, 1, 4), (8, 4, 1), (9, None, 4)], "request_id long, src long, dst long")
    got = alternatives.k_routes(arcs, asked, 2, factor=5).orderBy("request_id", "route", F.desc("hop")).select("request_id", "route", "s", "t").collect()
    assert [tuple(r) for r in got] == [(7, 0, 1, 2), (7, 0, 2, 4), (7, 1, 1, 3), (7, 1, 3, 4)]
    assert goals[0] == 2


def test_boxes_of_ways_are_dealt_before_they_are_written_out_by_cells(spark, sf):
    assert "RepartitionByExpression [way_id" in _plan(mobility.ways_in_tiles(Tables(spark, sf)))


def test_components_and_their_streets_are_dealt_out_not_broadcast(spark, sf):
    from roadspark.operators import graph, strong

    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (4, 9)], "s long, t long")
    hooks = spark.createDataFrame([(2, 1)], "node long, up long")
    for made in (strong._relabel(links, hooks), strong._without(links, hooks), strong._mutual(links), strong._bypassed(strong._degrees(links)), graph.keep_nodes(links, hooks, "s", "t")):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.node: r.component for r in graph.strong_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_a_line_graph_is_cut_down_before_its_components_are_sought(spark, sf, monkeypatch):
    from roadspark.operators import graph, strong
    from roadspark.plans import turns

    sought, real = [], strong.strong_components
    counted = lambda arcs: sought.append(arcs.count()) or real(arcs)
    monkeypatch.setattr(strong, "strong_components", counted)
    monkeypatch.setattr(graph, "strong_components", counted)
    t = Tables(spark, sf)
    turns.largest_line(t).count()
    assert len(sought) == 1 and sought[0] < 0.9 * network.allowed(t).count()


def test_restrictions_are_laid_beside_segments_and_not_beside_manoeuvres(spark, sf, monkeypatch):
    plan = network.allowed(Tables(spark, sf))._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" not in plan
    roads = [(10 * k, k, 0, 1, "residential", 20.0, 1.0, 0.0) for k in range(3)] + [(10 * k, k, 1, 2, "residential", 20.0, 1.0, 90.0) for k in (5, 6, 7)]
    rules = [(1, "no_left_turn", 0, 1, 5), (2, "no_left_turn", 0, 1, None), (3, "only_straight_on", 1, 1, 6), (4, "only_straight_on", 1, 1, None), (5, "only_straight_on", 2, 1, 5), (6, "only_left", 2, 1, 7)]
    monkeypatch.setattr(network, "segments", lambda t: spark.createDataFrame(roads, "seg long, edge_id long, entry long, exit long, highway string, speed double, secs double, az double"))
    monkeypatch.setattr(network, "restriction_members", lambda t: None)
    monkeypatch.setattr(network, "restriction_triples", lambda r: spark.createDataFrame(rules, "rel_id long, restriction string, from_edge long, via_node long, to_edge long"))
    assert {(r.f_edge, r.t_edge) for r in network.allowed(None).collect()} == {(0, 6), (0, 7), (1, 6)}


def test_streets_get_their_ends_dealt_out_not_broadcast(spark, sf):
    from roadspark.plans import roads

    assert "Broadcast" not in roads.arcs(Tables(spark, sf))._jdf.queryExecution().executedPlan().toString()


def test_rounds_that_meet_no_target_change_no_cut(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL_NODES", 8)
    names, whole = [], search.settle
    monkeypatch.setattr(search, "settle", lambda df, name: names.append(name) or whole(df, name))
    arcs = spark.range(128).select(F.col("id").alias("s"), (F.col("id") + 1).alias("t"), F.lit(1).alias("w"))
    start, goal = spark.createDataFrame([(0, 0)], "src long, node long"), spark.createDataFrame([(0, 100)], "src long, dst long")
    got = search.search(search.prepare(arcs), start, targets=goal)
    assert got.filter("node = 100").first().g == 100
    assert names.count("met") == names.count("cuts") == 1
