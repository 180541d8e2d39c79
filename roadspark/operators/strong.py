"""Strong components of large arc tables, by contraction.

Nodes that certainly share a component are merged, and nodes that certainly have none are
dropped, until no arcs are left. A round is one of these; the next kind is tried when one has removed
less than a tenth of the arcs, and after colours all begins anew:

* nodes with arcs both ways between them are merged: each is hooked to its least such neighbour,
  and the hooks are followed to their ends by pointer jumping. On road networks, where most streets run
  both ways, this leaves one giant node and a rim;
* nodes without arcs in, or without arcs out, are dropped, and a node with one arc in and one out is bypassed, no two neighbours at once, so chains shrink by a
  constant share a round: it belongs to its neighbours' component if they turn out to share one, else stands alone;
* colours: each node takes the first of the nodes that reach it (those with most arcs come first), and
  the nodes of a colour that reach its first node are a component. All colours go at once.

Rounds are settled as tables; the arcs shrink from round to round. A node with very many arcs is merged
by partial minima, and its arcs, which soon are the same few, are made distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.operators.scratch import forget, settle

#: Steps of a search that share a job.
STEPS = 3


def _table(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: dealt by key, never sent whole through the driver, however small its file."""
    return df.hint("merge")


def _jump(hooks: DataFrame) -> DataFrame:
    """Hooks (node, up) followed to their ends."""
    while True:
        up = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        twice = hooks.join(_table(up), "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
        again = twice.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("moved").alias("more"))
        after = settle(twice.join(_table(again), "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.coalesce("more", F.lit(False)).alias("moved")), "hooks")
        forget(hooks)
        hooks = after.select("node", "up")
        if after.filter("moved").isEmpty():  # no end has moved on, so all are ends
            return hooks


def _relabel(links: DataFrame, hooks: DataFrame) -> DataFrame:
    a = links.join(_table(hooks.select(F.col("node").alias("s"), F.col("up").alias("us"))), "s", "left").select(F.coalesce("us", "s").alias("s"), "t")
    b = a.join(_table(hooks.select(F.col("node").alias("t"), F.col("up").alias("ut"))), "t", "left").select("s", F.coalesce("ut", "t").alias("t"))
    return b.filter("s <> t").distinct()


def _without(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs that touch none of ``nodes`` (node)."""
    return links.join(_table(nodes.select(F.col("node").alias("s"))), "s", "left_anti").join(_table(nodes.select(F.col("node").alias("t"))), "t", "left_anti").select("s", "t")


def _mutual(links: DataFrame) -> DataFrame:
    """(node, up): each node's least neighbour with arcs both ways, if that is less than the node."""
    back = links.filter("s < t").select(F.col("s").alias("t"), F.col("t").alias("s"))
    return links.filter("s > t").join(_table(back), ["s", "t"]).groupBy("s").agg(F.min("t").alias("up")).select(F.col("s").alias("node"), "up")


def _degrees(links: DataFrame) -> DataFrame:
    out = links.select(F.col("s").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out"), F.lit(None).cast("long").alias("before"), F.col("t").alias("behind"))
    into = links.select("t", F.lit(1), F.lit(0), "s", F.lit(None).cast("long"))
    return out.union(into).groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out"), F.max("before").alias("before"), F.max("behind").alias("behind"))


def _bypassed(degrees: DataFrame) -> DataFrame:
    """(node, before, behind) of nodes with one arc in and one out whose hash is the least among neighbours of that kind."""
    through = degrees.filter("into = 1 AND out = 1").select("node", "before", "behind", F.xxhash64("node").alias("h"))
    near = through.select("node", "h", F.explode(F.array("before", "behind")).alias("at"))
    less = near.join(_table(through.select(F.col("node").alias("at"), F.col("h").alias("other"))), "at").filter("other < h OR other = h AND at < node").select("node").distinct()
    return through.join(_table(less), "node", "left_anti").select("node", "before", "behind")


def _coloured(links: DataFrame, degrees: DataFrame) -> DataFrame:
    """(node, root): the component of each colour's first node, for all colours."""
    state = settle(degrees.select("node", F.struct((-F.col("into") - F.col("out")).alias("rank"), F.col("node").alias("root")).alias("colour")), "colours")
    moved = True
    while moved:
        now = state
        for _ in range(STEPS):
            sent = now.join(_table(links), now.node == links.s).select(F.col("t").alias("node"), "colour")
            now = now.select("node", "colour").union(sent).groupBy("node").agg(F.min("colour").alias("colour"))
        old = state.select("node", F.col("colour").alias("old"))
        after = settle(now.join(_table(old), "node").select("node", "colour", (F.col("colour") != F.col("old")).alias("moved")), "colours")
        moved = not after.filter("moved").isEmpty()
        forget(state)
        state = after
    colour = state.select("node", F.col("colour.root").alias("root"))
    inside = links.join(_table(colour.select(F.col("node").alias("s"), F.col("root").alias("rs"))), "s").join(_table(colour.select(F.col("node").alias("t"), F.col("root").alias("rt"))), "t").filter("rs = rt")
    inside = settle(inside.select("s", "t"), "links")
    front = found = settle(colour.filter("node = root"), "found")
    while True:
        step = front
        for _ in range(STEPS):
            step = step.union(step.join(_table(inside), F.col("node") == F.col("t")).select(F.col("s").alias("node"), "root")).distinct()
        front = settle(step.join(_table(found), "node", "left_anti"), "found")
        if front.isEmpty():
            return found
        found = found.union(front)


def strong_components(arcs: DataFrame) -> DataFrame:
    """(node, component) of arcs (s, t); component is the least node of the node's strong component.

    Self arcs and repeated arcs change nothing; rows with a null end are left out. An empty table gives no rows.
    """
    arcs = arcs.filter("s IS NOT NULL AND t IS NOT NULL")
    links = settle(arcs.filter("s <> t").select("s", "t").distinct(), "links")
    nodes = settle(arcs.select(F.col("s").alias("node")).union(arcs.select("t")).distinct(), "nodes")
    hooks, passed = [], []

    def go_on(after: DataFrame) -> DataFrame:
        kept = settle(after, "links")
        forget(links)
        return kept

    kind, count = 0, links.count()
    while count:
        if kind == 0:
            pairs = settle(_mutual(links), "hooks")
            if not pairs.isEmpty():
                hooks.append(_jump(pairs))
                links = go_on(_relabel(links, hooks[-1]))
        else:
            degrees = settle(_degrees(links), "degrees")
            if kind == 1:
                through = settle(_bypassed(degrees), "through")
                passed.append(through)
                dead = degrees.filter("into = 0 OR out = 0").select("node")
                bridge = _without(through.select(F.col("before").alias("s"), F.col("behind").alias("t")), dead)
                links = go_on(_without(links, dead.union(through.select("node"))).union(bridge).filter("s <> t").distinct())
            else:
                found = settle(_coloured(links, degrees), "found")
                hooks.append(settle(found.filter("node <> root").select("node", F.col("root").alias("up")), "hooks"))
                links = go_on(_without(links, found))
            forget(degrees)
        left = links.count()
        if kind == 2:
            kind = 0
        elif left > 0.9 * count:
            kind += 1
        elif kind == 1:
            kind = 0
        count = left

    label = nodes.select("node", F.col("node").alias("root"))
    if hooks:
        forest = hooks[0]
        for more in hooks[1:]:
            forest = forest.union(more)
        forest = _jump(settle(forest, "forest"))
        label = settle(nodes.join(_table(forest), "node", "left").select("node", F.coalesce("up", "node").alias("root")), "labels")
    for through in reversed(passed):  # a node passed by later is known before those passed by earlier
        before = label.select(F.col("node").alias("before"), F.col("root").alias("a"))
        behind = label.select(F.col("node").alias("behind"), F.col("root").alias("b"))
        joins = through.join(_table(before), "before").join(_table(behind), "behind").filter("a = b").select(F.col("node").alias("root"), F.col("a").alias("up"))
        label = settle(label.join(_table(joins), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(_table(least), "root").select("node", "component")


def line_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of the arcs s -> t of ``pairs`` (s, t, hub); nodes have equal numbers where they share a strong component.

    Each s ends at one hub, and each t begins at one, as segments do at junctions. Where every s of a hub goes on to every t of it, arcs to the
    hub and from it stand for its pairs, and an arc between two such hubs for the node between them. So a line graph shrinks
    to about its road network before any round. In the rounds, nodes have even numbers and hubs odd ones.
    """
    at_hub = Window.partitionBy("hub")
    many = lambda k: F.size(F.collect_set(k).over(at_hub)).cast("long")
    dealt = pairs.select("s", "t", "hub").filter("s IS NOT NULL AND t IS NOT NULL").repartition("hub").distinct()
    pairs = settle(dealt.select("s", "t", "hub", (F.col("hub").isNotNull() & (F.count("*").over(at_hub) == many("s") * many("t"))).alias("whole")), "pairs")
    whole = pairs.filter("whole")
    behind = whole.groupBy(F.col("s").alias("node")).agg(F.max("hub").alias("behind"))
    before = whole.groupBy(F.col("t").alias("node")).agg(F.max("hub").alias("before"))
    ends = settle(behind.join(before, "node", "full").select("node", "before", "behind"), "ends")
    hub_or_node = lambda k: F.coalesce(F.col(k) * 2 + 1, F.col("node") * 2)
    links = ends.select(hub_or_node("before").alias("s"), hub_or_node("behind").alias("t"))
    label = settle(strong_components(links.union(pairs.filter("NOT whole").select(F.col("s") * 2, F.col("t") * 2))), "labels")
    own = label.filter("node % 2 = 0").select(F.shiftright("node", 1).alias("node"), "component")
    hubs = label.filter("node % 2 <> 0").select(F.shiftright("node", 1).alias("hub"), "component")
    between = ends.filter("before IS NOT NULL AND behind IS NOT NULL")
    between = between.join(_table(hubs.select(F.col("hub").alias("before"), F.col("component").alias("a"))), "before").join(_table(hubs.select(F.col("hub").alias("behind"), F.col("component").alias("b"))), "behind")
    return settle(own.union(between.select("node", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("node") * 2))), "labels")
