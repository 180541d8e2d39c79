"""Graph algorithms on small graphs, against plain Python."""

import random

import pytest

from roadspark.operators import alternatives, graph, search, traffic


def shortest(arcs, src):
    best = {src: 0}
    while True:
        new = dict(best)
        for s, t, w in arcs:
            if s in best and best[s] + w < new.get(t, 1 << 60):
                new[t] = best[s] + w
        if new == best:
            return best
        best = new


def random_arcs(seed, n=14, m=30):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 9)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_and_paths(spark, seed):
    arcs = random_arcs(seed)
    a = spark.createDataFrame(arcs, "s long, t long, w long")
    src = spark.createDataFrame([(0,), (5,)], "src long")
    tree = graph.distances(a, src)
    got = {(r.src, r.node): r.g for r in tree.collect()}
    assert got == {(s, n): g for s in (0, 5) for n, g in shortest(arcs, s).items()}
    req = spark.createDataFrame([(k, 0, n) for k, n in enumerate(sorted(n for s, n in got if s == 0))], "request_id long, src long, dst long")
    cost = {}
    for s, t, w in arcs:
        cost[s, t] = min(w, cost.get((s, t), 99))
    paths = {}
    for r in graph.walk_back(tree, req).collect():
        paths.setdefault(r.request_id, {})[r.hop] = r.node
    for r in req.collect():
        p = [paths[r.request_id][h] for h in sorted(paths[r.request_id], reverse=True)]
        assert p[0] == 0 and p[-1] == r.dst
        assert sum(cost[x, y] for x, y in zip(p, p[1:])) == got[0, r.dst]


def test_components(spark):
    arcs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8)]
    a = spark.createDataFrame(arcs, "s long, t long")
    weak = {r.node: r.component for r in graph.weak_components(a).collect()}
    assert weak == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    strong = {r.node: r.component for r in graph.strong_components(a).collect()}
    assert strong == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert {r.node for r in graph.largest_component(graph.weak_components(a)).collect()} == {1, 2, 3, 4, 5}


def test_landmark_bounds_hold(spark):
    arcs = random_arcs(3, 10, 40)
    a = spark.createDataFrame(arcs, "s long, t long, w long")
    marks = graph.farthest_landmarks(a, 0, 2)
    table = graph.landmark_table(a, marks)
    pairs = [(10 * x + y, x, y) for x in range(10) for y in range(10)]
    got = graph.landmark_bounds(table, spark.createDataFrame(pairs, "request_id long, src long, dst long")).collect()
    for r in got:
        x, y = divmod(r.request_id, 10)
        assert r.bound <= shortest(arcs, x).get(y, 1 << 60)


LINE = [(0, 1, 100), (1, 2, 100), (2, 3, 100)]
K = [(0, 0), (1, 100000), (2, 100000), (3, 0)]


@pytest.mark.parametrize(
    "bookings, start, last",
    [([], 0, 300), ([(1, 50.0, 50), (2, 150.0, 50)], 0, 538), ([(1, 50.0, 10), (1, 50.0, -10)], 0, 300), ([], 400, 700)],
)
def test_timed_routes(spark, bookings, start, last):
    """Hand-computed line: free flow, congestion, booking undone, a later start."""
    b = spark.createDataFrame(bookings, "node_id long, seconds double, delta long") if bookings else spark.createDataFrame([], "node_id long, seconds double, delta long")
    v = traffic.book(b)
    got = traffic.timed_distances(spark.createDataFrame(LINE, "s long, t long, w long"), spark.createDataFrame([(0, start)], "src long, start long"), v, spark.createDataFrame(K, "node_id long, k_magic long"))
    at = {r.node: r.at for r in got.collect()}
    if bookings and len(bookings) == 2 and bookings[0][2] == 50:
        assert at[3] == 538
    else:
        assert at[3] == last and [at[n] for n in range(4)] == [start + 100 * n for n in range(4)]


def test_k_routes_differ(spark):
    arcs = [(0, 1, 1), (1, 3, 1), (0, 2, 2), (2, 3, 2), (0, 3, 9)]
    r = spark.createDataFrame([(7, 0, 3)], "request_id long, src long, dst long")
    k = alternatives.k_routes(spark.createDataFrame(arcs, "s long, t long, w long"), r, 3).collect()
    shapes = {}
    for x in k:
        shapes.setdefault(x.route, set()).add((x.s, x.t))
    assert shapes[0] == {(0, 1), (1, 3)} and shapes[1] == {(0, 2), (2, 3)}
    assert len({frozenset(s) for s in shapes.values()}) == len(shapes)


def diverse(arcs, src, dst, k, factor, apart, tries):
    """Brute force over all simple paths; weights chosen without ties."""
    cost = {(s, t): w for s, t, w in arcs}

    def paths(at, seen):
        if at == dst:
            yield seen
        for s, t in cost:
            if s == at and t not in seen:
                yield from paths(t, [*seen, t])

    every = [list(zip(p, p[1:])) for p in paths(src, [src])]
    used, kept = set(), []
    for _ in range(tries):
        route = min(every, key=lambda p: sum(cost[e] * (factor if e in used else 1) for e in p))
        if not kept or 1 - len(set(route) & set(kept[0])) / max(len(route), len(kept[0])) >= apart and set(route) not in map(set, kept):
            kept.append(route)
        used |= set(route) | {(t, s) for s, t in route}
        if len(kept) == k:
            break
    return [set(p) for p in kept]


def test_diverse_routes_against_all_paths(spark):
    arcs = [(0, 1, 101), (1, 0, 101), (1, 2, 103), (2, 1, 103), (0, 3, 127), (3, 4, 131), (4, 2, 137), (1, 4, 149), (3, 1, 211), (0, 4, 307)]
    r = spark.createDataFrame([(7, 0, 2), (8, 3, 2), (9, 2, 3)], "request_id long, src long, dst long")
    rows = alternatives.k_routes(spark.createDataFrame(arcs, "s long, t long, w long"), r, 3, factor=1.5, diversity=0.3, tries=30, both_ways=True).collect()
    for request, src, dst in [(7, 0, 2), (8, 3, 2), (9, 2, 3)]:
        got = {}
        for x in rows:
            if x.request_id == request:
                got.setdefault(x.route, set()).add((x.s, x.t))
        assert [got[k] for k in sorted(got)] == diverse(arcs, src, dst, 3, 1.5, 0.3, 30)


def test_searches_end_at_their_targets(spark):
    arcs = random_arcs(5, 20, 60)
    a = spark.createDataFrame(arcs, "s long, t long, w long")
    pairs = [(0, 3), (0, 7), (4, 4), (9, 99)]
    got = graph.distances(a, spark.createDataFrame([(0,), (4,), (9,)], "src long"), targets=spark.createDataFrame(pairs, "src long, dst long")).collect()
    for src, dst in pairs:
        assert {r.g for r in got if (r.src, r.node) == (src, dst)} == {g for n, g in shortest(arcs, src).items() if n == dst}


def test_landmark_choice_against_brute_force(spark):
    arcs = random_arcs(6, 9, 40)
    a = spark.createDataFrame(arcs, "s long, t long, w long")
    far = {n: shortest(arcs, n) for n in range(9)}
    pool = [0, 3]
    near = {n: min(far[p].get(n, 1 << 60) for p in pool) for n in range(9)}
    first = min((n for n in near if near[n] < 1 << 60), key=lambda n: (-near[n], n))
    assert graph.far_landmarks(a, pool, 1) == [first]
    table = graph.landmark_table(a, [0, 3, 5])
    pairs = [(10 * x + y, x, y) for x in range(9) for y in range(9)]
    chosen = graph.cover_landmarks(table, spark.createDataFrame(pairs, "request_id long, src long, dst long"), 2)
    known = {(r.landmark, r.node): r for r in table.collect()}

    def bound(m, x, y):
        p, q = known.get((m, x)), known.get((m, y))
        return max(p.d_to - q.d_to, q.d_from - p.d_from, 0) if p and q else 0

    total = lambda ms: sum(max(bound(m, x, y) for m in ms) for _, x, y in pairs)
    best = min((0, 3, 5), key=lambda m: (-total([m]), m))
    rest = min((m for m in (0, 3, 5) if m != best), key=lambda m: (-total([best, m]), m))
    assert chosen == [best, rest]


def plain_strong(arcs):
    nodes, ahead = sorted({x for a in arcs for x in a}), {}
    for s, t in arcs:
        ahead.setdefault(s, set()).add(t)
    reach = {}
    for n in nodes:
        reach[n], todo = {n}, [n]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in reach[n]:
                    reach[n].add(y)
                    todo.append(y)
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("share", [1.2, 1.8])
def test_strong_components_of_random_arcs(spark, share):
    rng = random.Random(share)
    arcs = [(rng.randrange(30), rng.randrange(30)) for _ in range(int(30 * share))]
    arcs += [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(200 + k, 201 + k) for k in range(9)] + [(3, 200)]  # a ring and a chain
    got = graph.strong_components(spark.createDataFrame(arcs, "s long, t long").coalesce(2)).collect()
    assert {r.node: r.component for r in got} == plain_strong(arcs)
    assert graph.strong_components(spark.createDataFrame([], "s long, t long")).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_line_graphs_with_bans(spark, seed):
    rng = random.Random(seed)
    segs = {100 + k: (rng.randrange(9), rng.randrange(9)) for k in range(26)}  # loops and parallel segments too
    pairs = [(f, t, b) for f, (_, b) in segs.items() for t, (a, _) in segs.items() if a == b and not (b < 4 and rng.random() < 0.4)]
    pairs += [(900, 901, None), (901, 900, None), (902, 900, None)] + pairs[:5]
    got = {r.node: r.component for r in graph.line_components(spark.createDataFrame(pairs, "s long, t long, hub long").coalesce(2)).collect()}
    want = plain_strong([(s, t) for s, t, _ in pairs])
    groups = lambda of: {frozenset(n for n in of if of[n] == k) for k in of.values()}
    assert groups(got) == groups(want)
    assert graph.line_components(spark.createDataFrame([], "s long, t long, hub long")).collect() == []


def test_distances_across_cells(spark):
    arcs = random_arcs(11, 40, 120)
    net = search.prepare(spark.createDataFrame(arcs, "s long, t long, w long"), cell_nodes=6)
    starts = spark.createDataFrame([(0, 0), (5, 5), (77, 77)], "src long, node long")
    want = {(s, n): g for s in (0, 5, 77) for n, g in shortest(arcs, s).items()}
    tree = search.search(net, starts).collect()
    assert {(r.src, r.node): r.g for r in tree} == want
    cost = {}
    for s, t, w in arcs:
        cost[s, t] = min(w, cost.get((s, t), 99))
    assert all(r.parent is None and r.g == 0 or want[r.src, r.parent] + cost[r.parent, r.node] == r.g for r in tree)
    assert {(r.src, r.node): r.g for r in search.search(net, starts, limit=7).collect()} == {k: g for k, g in want.items() if g <= 7}


def test_bounds_spare_most_of_a_search(spark):
    side = 30
    arcs = [(y * side + x, v * side + u, 10 + (x * 7 + y * 3) % 5) for y in range(side) for x in range(side) for u, v in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if 0 <= u < side and 0 <= v < side]
    arcs += [(0, 5000, 7)]  # a dead end, which is a poor landmark
    a = spark.createDataFrame(arcs, "s long, t long, w long")
    marks = graph.landmark_table(a, [0, side - 1, side * (side - 1), side * side - 1, 5000])
    asked = [(k, k * 35, (k * 35 + 4 * side + 3) % (side * side)) for k in range(12)] + [(90, 1, 9999)]
    q = spark.createDataFrame(asked, "request_id long, src long, dst long")
    cut, whole = [], []
    got = {r.request_id: r.cost for r in graph.routes(search.prepare(a, marks, cell_nodes=100), q, cut).collect()}
    assert got == {k: shortest(arcs, s).get(d) for k, s, d in asked}
    starts = q.selectExpr("request_id AS src", "src AS node")
    search.search(search.prepare(a, cell_nodes=100), starts, seen=whole)
    assert sum(cut) * 3 < sum(whole)


def test_long_paths_take_few_rounds(spark):
    n = 300
    tree = spark.createDataFrame([(0, k, k, k - 1 if k else None) for k in range(n)], "src long, node long, g long, parent long")
    got = graph.walk_back(tree, spark.createDataFrame([(1, 0, n - 1), (2, 0, 7), (3, 0, 999), (4, None, 3)], "request_id long, src long, dst long")).collect()
    assert sorted((r.request_id, r.hop, r.node, r.g) for r in got) == [(1, h, n - 1 - h, n - 1 - h) for h in range(n)] + [(2, h, 7 - h, 7 - h) for h in range(8)]


def test_a_goal_without_a_way_ends_its_search_and_many_sources_share_cells(spark, monkeypatch):
    """Node 900 only leads into the ring and 901 only out of it: no search for 900 walks around, in one part of sources or in many."""
    ring = [(k, (k + 1) % 300, 1) for k in range(300)] + [((k + 1) % 300, k, 2) for k in range(300)]
    arcs = spark.createDataFrame([*ring, (900, 5, 1), (7, 901, 1)], "s long, t long, w long")
    asked = [(1, 40, 900), (2, 40, 901), (3, 900, 901), (4, 901, 3), (5, 10, 30), (6, 30, 10), (7, 12, 12)]
    q = spark.createDataFrame(asked, "request_id long, src long, dst long")
    want = {1: None, 2: 67, 3: 4, 4: None, 5: 20, 6: 40, 7: 0}
    marks = graph.landmark_table(arcs, [0, 100, 200], one_way=True)
    assert {r.node for r in marks.filter("d_to IS NULL").collect()} == {901} and {r.node for r in marks.filter("d_from IS NULL").collect()} == {900}
    both_ways = marks.filter("d_from IS NOT NULL AND d_to IS NOT NULL")
    for sources, table, one_way in ((4096, both_ways, False), (2, marks, True)):
        monkeypatch.setattr(search, "SOURCES", sources)
        got = graph.routes(search.prepare(arcs, table, cell_nodes=50, one_way=one_way), q).collect()
        assert {r.request_id: r.cost for r in got} == want
    seen = []
    graph.routes(search.prepare(arcs, marks, cell_nodes=50, one_way=True), q.filter("request_id IN (1, 4)"), seen=seen).collect()
    assert sum(seen) <= 2


def test_routes_with_dearer_streets_are_the_same_in_parts_of_sources(spark, monkeypatch):
    arcs = spark.createDataFrame(random_arcs(5, 12, 40), "s long, t long, w long")
    r = spark.createDataFrame([(k, k % 12, (5 * k + 3) % 12) for k in range(9)], "request_id long, src long, dst long")
    found = []
    for sources in (4096, 2):
        monkeypatch.setattr(search, "SOURCES", sources)
        monkeypatch.setattr(alternatives, "CELL_NODES", 4)
        found.append(sorted(map(tuple, alternatives.k_routes(arcs, r, 2).collect())))
    assert found[0] == found[1] and len({x[0] for x in found[0]}) > 3
