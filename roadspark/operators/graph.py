"""Graph algorithms over edge tables: components, distances, paths, landmarks.

All of them are rounds of joins and grouped minima, or, for distances, of cells of the graph. Every round is settled
as a table, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.operators.scratch import forget, settle
from roadspark.operators.search import MARK_CAP, Net, prepare, search
from roadspark.operators.strong import line_components, strong_components  # noqa: F401


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """Points neighbours at the least node around each centre u.

    larger: every neighbour above u moves to the minimum; else u itself and every
    neighbour below u do. Edges are dealt by centre once, for the minimum and for the join.
    """
    both = (edges if not larger else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))).repartition("u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least.hint("merge"), "u")
    if larger:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.filter(F.col("u") != F.col("m")).select("u", F.col("m").alias("v"))).distinct()


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (s, t); component is its least node.

    Alternating star contraction: a logarithmic number of rounds, each settled. Self links
    and repeated links change nothing; nodes without other links do not appear.
    """
    now = edges.filter("s <> t").select(F.greatest("s", "t").alias("u"), F.least("s", "t").alias("v")).distinct()
    first, settled = True, False
    while not settled:
        after = settle(_contract(_contract(now, True), False), "stars")
        # done when every node hangs on one centre, and no centre hangs on another node
        ends = after.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(after.select("v", F.lit(0), F.lit(1)))
        roles = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        settled = roles.filter((F.col("hangs") > 1) | (F.col("hangs") + F.col("holds") > 1)).isEmpty()
        if not first:
            forget(now)
        now, first = after, False
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def distances(arcs: DataFrame | Net, sources: DataFrame, limit: int | None = None, penalised: DataFrame | None = None, factor: float = 1, targets: DataFrame | None = None) -> DataFrame:
    """Least whole-number distances (src, node, g, parent) from each source (src, and node if it is not the source's id) over arcs (s, t, w), or over a prepared graph.

    Weights are not negative. See ``search`` for the limit, the targets (src, dst) after which a source's search ends, and the
    arcs (src, s, t) that cost a source ``factor`` times as much; nodes beyond the targets may lack rows or have too
    high a g, targets and the nodes on their paths do not. All sources share the rounds.
    """
    net = arcs if isinstance(arcs, Net) else prepare(arcs)
    start = F.col("node" if "node" in sources.columns else "src")
    starts = sources.select("src", start.alias("node")).filter("src IS NOT NULL AND node IS NOT NULL").dropDuplicates(["src"])
    return search(net, starts, limit=limit, targets=targets, penalised=penalised, factor=factor)


def reachable(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, node) that can be reached."""
    return distances(arcs.select("s", "t", F.lit(0).cast("long").alias("w")), sources).select("src", "node")


def largest_component(members: DataFrame) -> DataFrame:
    """The nodes of the largest component, on ties of that with the least node; from (node, component)."""
    top = members.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least")).orderBy(F.col("n").desc(), "least").limit(1)
    return members.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")  # one row


def keep_nodes(edges: DataFrame, nodes: DataFrame, s: str = "source_id", t: str = "target_id") -> DataFrame:
    """Edges with both ends among ``nodes``, which grow with the graph and are dealt out, not broadcast."""
    return edges.join(nodes.select(F.col("node").alias(s)).hint("merge"), s, "left_semi").join(nodes.select(F.col("node").alias(t)).hint("merge"), t, "left_semi")


def walk_back(tree: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, hop, node, g): the nodes of each request's path, hop 0 at the target.

    ``tree`` is a result of ``distances``; ``requests`` has request_id, src, dst. Requests without a path give no rows.
    Pointer jumping: tables of the ancestors 1, 2, 4, ... steps up, then each known place of a path gives the one that
    far behind it, the longest jumps first. So a path of n nodes takes 2 log2(n) rounds.
    """
    asked = settle(requests.select("request_id", "src", F.col("dst").alias("node")).filter("src IS NOT NULL AND node IS NOT NULL"), "requests")
    tree = settle(tree.select("src", "node", "g", "parent").join(asked.select("src").distinct(), "src", "left_semi"), "tree")
    jumps = [tree.filter("parent IS NOT NULL").select("src", "node", F.col("parent").alias("up"))]
    paths = settle(asked.join(tree.select("src", "node"), ["src", "node"]).select("request_id", "src", "node", F.lit(0).alias("hop")), "walk")
    while True:
        ahead = jumps[-1].select("src", F.col("node").alias("up"), F.col("up").alias("top"))
        twice = settle(jumps[-1].join(ahead, ["src", "up"]).select("src", "node", F.col("top").alias("up")), "jumps")
        if twice.isEmpty():
            break
        jumps.append(twice)
    for k in range(len(jumps) - 1, -1, -1):
        far = paths.join(jumps[k], ["src", "node"]).select("request_id", "src", F.col("up").alias("node"), (F.col("hop") + (1 << k)).alias("hop"))
        paths = settle(paths.union(far), "walk")
    forget(*jumps[1:])
    return paths.join(tree.select("src", "node", "g"), ["src", "node"]).select("request_id", "hop", "node", "g")


def routes(net: Net, requests: DataFrame, seen: list | None = None) -> DataFrame:
    """``requests`` (request_id, src, dst) with cost, null where there is no way; ids are distinct.

    Each request is a search of its own, cut by the bounds of the landmarks that ``net`` was prepared with: it starts with the
    cheapest way over a landmark as its answer, and only labels that can still better it go on. ``seen`` as in ``search``.
    """
    asked = requests.filter("request_id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    starts = asked.select(F.col("request_id").alias("src"), F.col("src").alias("node"))
    goals = asked.select(F.col("request_id").alias("src"), "dst")
    got = search(net, starts, goals=goals, seen=seen).select(F.col("src").alias("request_id"), F.col("node").alias("dst"), F.col("g").alias("cost"))
    return requests.join(got, ["request_id", "dst"], "left")


def corner_landmarks(nodes: DataFrame) -> list[int]:
    """The nodes (node_id, lon, lat) farthest out in the eight directions: landmarks without a search."""
    x, y = F.col("lon"), F.col("lat")
    ways = [x, -x, y, -y, x + y, x - y, -x + y, -x - y]
    picked = nodes.agg(*[F.min(F.struct(-w, F.col("node_id").alias("id"))).alias(f"w{k}") for k, w in enumerate(ways)]).first()
    return sorted({w["id"] for w in picked if w is not None})


def tight_parents(arcs: DataFrame, dist: DataFrame) -> DataFrame:
    """``dist`` with parent put to the least node from which an arc ends a shortest path; weights must be positive.

    A function of the distances alone, however they were found. ``dist``: src, node, g.
    """
    near = dist.select("src", "node", "g")
    back = near.join(arcs.groupBy("s", "t").agg(F.min("w").alias("w")), F.col("node") == F.col("t")).select("src", "node", "g", "s", "w")
    before = near.select("src", F.col("node").alias("s"), F.col("g").alias("before"))
    tight = back.join(before, ["src", "s"]).filter("before + w = g").groupBy("src", "node").agg(F.min("s").alias("parent"))
    return near.join(tight, ["src", "node"], "left")


def far_landmarks(arcs: DataFrame | Net, pool: list[int], n: int) -> list[int]:
    """``n`` more landmarks beside ``pool``: each is the reached node farthest from all before it (least id on ties).

    From one start these are the farthest candidates; from a pool, its blind spots. One table of least distances serves all: a new
    landmark's search goes on from it, and touches only the nodes that come nearer.
    """
    net = arcs if isinstance(arcs, Net) else prepare(arcs)
    spark = net.graph.sparkSession
    latest, found, labels = list(pool), [], []
    while len(found) < n:
        near = search(net, spark.createDataFrame([(0, x) for x in latest], "src long, node long"), onto=labels)
        far = near.agg(F.min(F.struct((-F.col("g")).alias("d"), F.col("node"))).alias("m")).first().m
        found.append(far.node)
        latest = [far.node]
    return found


def farthest_landmarks(arcs: DataFrame | Net, first: int, n: int) -> list[int]:
    """``n`` landmarks from ``first`` on: each next one is the node farthest from all before it (least id on ties)."""
    return [first] + far_landmarks(arcs, [first], n - 1)


def cover_landmarks(table: DataFrame, pairs: DataFrame, n: int) -> list[int]:
    """``n`` of the landmarks of ``table`` that together bound ``pairs`` (request_id, src, dst) best.

    Greedy cover: each step takes the one that raises the sum of the pairs' best bounds most (least id
    on ties), which reaches 1 - 1/e of the best choice at least. The number of pairs is the caller's;
    landmarks are few, so the steps look at pairs x landmarks rows.
    """
    at_s = table.select("landmark", F.col("node").alias("src"), F.col("d_to").alias("ts"), F.col("d_from").alias("fs"))
    at_t = table.select("landmark", F.col("node").alias("dst"), F.col("d_to").alias("tt"), F.col("d_from").alias("ft"))
    each = pairs.join(at_s, "src").join(at_t, ["landmark", "dst"])
    bound = settle(each.select("request_id", "landmark", F.greatest(F.col("ts") - F.col("tt"), F.col("ft") - F.col("fs"), F.lit(0)).alias("bound")), "bounds")
    chosen: list[int] = []
    while len(chosen) < n:
        have = bound.filter(F.col("landmark").isin(chosen)).groupBy("request_id").agg(F.max("bound").alias("have"))
        gain = bound.filter(~F.col("landmark").isin(chosen)).join(have, "request_id", "left").groupBy("landmark").agg(F.sum(F.greatest(F.col("bound") - F.coalesce("have", F.lit(0)), F.lit(0))).alias("gain"))
        best = gain.orderBy(F.col("gain").desc(), "landmark").first()
        if best is None:
            break
        chosen.append(best.landmark)
    return chosen


def landmark_table(arcs: DataFrame, landmarks: list[int], cap: int = MARK_CAP, one_way: bool = False) -> DataFrame:
    """(landmark, node, d_from, d_to), each at most ``cap``; nodes that a landmark reaches and is reached from; with ``one_way`` also
    those with one of both, and null for the other.

    One batch of searches for both ways, as rounds cost most: the graph and its reverse lie in one table, a node's even number in the
    first and its odd one in the second, so both fall into the same cells.
    """
    sources = arcs.sparkSession.createDataFrame([(2 * x + back, 2 * x + back) for x in landmarks for back in (0, 1)], "src long, node long")
    arcs = arcs.select("s", "t", "w")
    both = arcs.select((2 * F.col("s")).alias("s"), (2 * F.col("t")).alias("t"), "w").union(arcs.select(2 * F.col("t") + 1, 2 * F.col("s") + 1, "w"))
    found = settle(distances(both, sources), "marks")
    way = lambda back, name: found.filter(F.pmod("src", F.lit(2)) == back).select(F.shiftright("src", 1).alias("landmark"), F.shiftright("node", 1).alias("node"), F.least("g", F.lit(cap)).alias(name))
    return way(0, "d_from").join(way(1, "d_to"), ["landmark", "node"], "full_outer" if one_way else "inner")


def landmark_bounds(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """(request_id, bound): the largest lower bound of the distance src -> dst over all landmarks."""
    at_s = table.select("landmark", F.col("node").alias("src"), F.col("d_to").alias("ts"), F.col("d_from").alias("fs"))
    at_t = table.select("landmark", F.col("node").alias("dst"), F.col("d_to").alias("tt"), F.col("d_from").alias("ft"))
    joined = pairs.join(at_s, "src").join(at_t, ["landmark", "dst"])
    return joined.groupBy("request_id").agg(F.max(F.greatest(F.col("ts") - F.col("tt"), F.col("ft") - F.col("fs"), F.lit(0))).alias("bound"))
