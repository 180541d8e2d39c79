"""Least distances on arc tables, cell by cell.

The nodes of a graph are dealt to cells by ranges of their ids; ids that lie near each other (Z-order,
rows of a map) make cells with few arcs between them. A round takes the labels that arrived in
some cells, relaxes the arcs inside each of these cells until nothing improves, and sends what leaves a
cell to the next round. So the number of rounds is that of the borders on a path, not of its nodes.

What a round reads follows its frontier: labels are appended, never rewritten, in folders by zone (a run of cells), and
a round opens the zones with arrivals only; cells do not see each other's labels. Nothing but zone
numbers, ``ZONES`` at most, comes to the driver.

A search can be cut: by a limit, by targets (a source ends where nothing cheaper than its dearest target is
left), or by goals with landmarks: a label goes on only if its distance and the landmarks' lower bound of what is left are within
the source's best answer so far, which begins at the landmarks' upper bound.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.functions import road
from roadspark.operators.scratch import scratch_dir, settle

# Executors need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes in a cell, about, at least and at most; cells up to the most nodes, so that rounds do not grow with the graph;
#: zones of a graph, at most; labels (sources x nodes) that a kernel holds at once.
CELL_NODES, MOST_NODES, CELLS, ZONES, LABELS = 8192, 1 << 18, 16, 64, 1 << 22
#: Sources, about, that share a task: with more of them a cell goes to several tasks.
SOURCES = 4096

FAR = np.int64(1 << 62)
#: Landmarks' distances are stored up to this; a larger one is no way that is known.
MARK_CAP = 65534
#: Stands for a distance from or to a landmark where there is no way.
NEVER = 1 << 40
#: Seconds of a traffic slot; a penalty is at most so many weights of its arc.
SLOT_S, CAP = road.SLOT_S, 10
LABEL = "kind int, cell int, zone int, src long, node long, g long, parent long"


@dataclass
class Net:
    """A graph dealt to cells: ``graph`` has a row an arc (cell, zone, s, t, w, t_cell, t_zone), and a row a node (t null) with
    its landmarks' distances, if there are any; ``nodes`` (node, cell, zone)."""

    graph: DataFrame
    nodes: DataFrame
    landmarks: DataFrame | None = None
    timed: bool = False


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers as bytes, which cross between Spark and Python far faster."""
    for batch in batches:
        packed = [pa.array([np.array(x, np.int64).tobytes() for x in batch.column(k).to_pylist()], pa.binary()) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *packed], ["node", "d_from", "d_to", "b_from", "b_to"])


def cell_size(nodes: int) -> int:
    """Nodes a cell: ``CELLS`` cells, none below ``CELL_NODES`` nodes or above ``MOST_NODES``."""
    return min(max(CELL_NODES, -(-nodes // CELLS)), MOST_NODES)


def prepare(
    arcs: DataFrame, landmarks: DataFrame | None = None, cell_nodes: int | None = None, volumes: DataFrame | None = None, factors: DataFrame | None = None, extra: DataFrame | None = None,
    one_way: bool = False,
) -> Net:
    """Deals arcs (s, t, w) to cells; of parallel arcs the lightest stays. ``landmarks``: landmark, node, d_from, d_to; ``one_way``: with
    the rows of nodes that a landmark only reaches or is only reached from, so that searches end whose goal cannot be reached.

    A search takes a round for every border that its paths cross, one after the other. So cells grow with the graph (see
    ``cell_size``), up to what a task holds. With landmarks, which keep many searches near their requests, cells stay small and
    the searches share the tasks; ``cell_nodes`` sets the size outright.

    With ``volumes`` (node_id, slot, volume) and ``factors`` (node_id, k_magic) an arc's cost follows the traffic at its target
    when the arc is entered, and ``extra`` (node_id, seconds) is added to arcs into a node. Labels are then times.
    """
    best = settle(arcs.groupBy("s", "t").agg(F.min("w").cast("long").alias("w")), "arcs")
    if extra is not None:
        best = best.join(extra.select(F.col("node_id").alias("t"), F.col("seconds").cast("long").alias("extra")), "t", "left")
    best = best.withColumn("extra", F.coalesce("extra", F.lit(0)).cast("long") if extra is not None else F.lit(0).cast("long"))
    ids = settle(best.select(F.col("s").alias("node")).union(best.select("t")).distinct(), "ids")
    count = ids.count()
    n = max(1, -(-count // (cell_nodes or (cell_size(count) if landmarks is None else CELL_NODES))))
    cell = F.spark_partition_id()
    zone = (cell.cast("long") * min(n, ZONES) / n).cast("int")
    nodes = settle(ids.repartitionByRange(n, "node").select("node", cell.alias("cell"), zone.alias("zone")), "cells")
    # nodes grow with the graph and are dealt out to their arcs, however small their file
    s = nodes.select(F.col("node").alias("s"), "cell", "zone").hint("merge")
    t = nodes.select(F.col("node").alias("t"), F.col("cell").alias("t_cell"), F.col("zone").alias("t_zone")).hint("merge")
    none = F.lit(None).cast("binary")
    graph = best.join(s, "s").join(t, "t").select("cell", "zone", "s", "t", "w", "extra", "t_cell", "t_zone", none.alias("b_from"), none.alias("b_to"))
    table = None
    if landmarks is not None:
        # landmarks off the main part know few nodes and are left out; nodes that one of the others does not know have no bounds, but
        # of a table with one-way rows no row says that there is no way: what a landmark reaches leads to nothing that it does not reach
        known = landmarks.groupBy("landmark").agg(F.count(F.col("d_from") + F.col("d_to")).alias("n")).collect()  # a row a landmark
        kept = sorted(r.landmark for r in known if r.n and 2 * r.n >= max(x.n for x in known))
        each = F.map_from_entries(F.collect_list(F.struct("landmark", F.struct("d_from", "d_to"))))
        marks = nodes.select("node").join(landmarks.filter(F.col("landmark").isin(kept)).groupBy("node").agg(each.alias("l")), "node", "left")
        of_each = lambda k: F.array(*[F.coalesce(F.col("l")[F.lit(x)][k], F.lit(NEVER)).cast("long") for x in kept])
        table = marks.filter(F.lit(bool(kept)) if one_way else F.size("l") == len(kept)).select("node", of_each("d_from").alias("d_from"), of_each("d_to").alias("d_to"))
        table = settle(table.mapInArrow(_bytes, "node long, d_from array<long>, d_to array<long>, b_from binary, b_to binary"), "landmarks")
        void = [F.lit(None).cast(k) for k in ("long", "long", "long", "int", "int")]
        graph = graph.union(table.join(nodes, "node").select("cell", "zone", F.col("node"), *void, "b_from", "b_to"))
    if volumes is not None:  # every cell gets the traffic of all nodes that its arcs lead to
        per_slot = volumes.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("slot", "volume"))).alias("v"))
        packed = per_slot.select("node_id", F.col("v.slot").alias("d_from"), F.col("v.volume").alias("d_to")).mapInArrow(_bytes, "node long, d_from array<long>, d_to array<long>, b_from binary, b_to binary")
        ends = graph.select("cell", "zone", F.col("t").alias("node")).distinct().join(factors.select(F.col("node_id").alias("node"), F.col("k_magic").cast("long").alias("w")), "node")
        void = [F.lit(None).cast(k) for k in ("long", "int", "int")]
        graph = graph.union(ends.join(packed, "node").select("cell", "zone", "node", F.lit(None).cast("long"), "w", *void, "b_from", "b_to"))
    path = f"{scratch_dir(arcs.sparkSession)}/rounds/net-{uuid.uuid4().hex}"
    graph.repartition("zone", "cell").write.partitionBy("zone").parquet(path)
    order = ["cell", "s", "t", "w", "extra", "t_cell", "t_zone", "b_from", "b_to"]
    return Net(arcs.sparkSession.read.schema(graph.select(*order, "zone").schema).parquet(path), nodes, table, volumes is not None)


# ------------------------------------------------------------------ inside a cell
def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The numbers of some rows of a column of bytes, all of one length, as a matrix."""
    return np.frombuffer(b"".join(column.combine_chunks().take(pa.array(rows)).to_pylist()), np.int64).reshape(len(rows), -1)


class Cell:
    """The arcs of one cell by the number of their start, and what leads out of it."""

    def __init__(self, table: pa.Table, extra: np.ndarray, timed: bool = False) -> None:
        column = lambda k: table.column(k).to_numpy(zero_copy_only=False)
        arc = table.column("t").is_valid().to_numpy()
        s, cell = column("s")[arc].astype(np.int64), column("cell")[arc]
        t, w = column("t")[arc].astype(np.int64), column("w")[arc].astype(np.int64)
        t_cell, t_zone = column("t_cell")[arc].astype(np.int64), column("t_zone")[arc].astype(np.int64)
        at = np.flatnonzero(~arc)
        marked = column("s")[at].astype(np.int64) if not timed else np.zeros(0, np.int64)
        stays = t_cell == cell
        self.ids = np.unique(np.concatenate([s, t[stays], extra, marked]))
        order = np.argsort(s, kind="stable")
        self.s, self.t, self.w, self.t_cell, self.t_zone, self.stays = s[order], t[order], w[order], t_cell[order], t_zone[order], stays[order]
        self.to = np.where(self.stays, np.searchsorted(self.ids, self.t), -1)
        self.first = np.searchsorted(self.s, self.ids, "left")
        self.degree = np.searchsorted(self.s, self.ids, "right") - self.first
        self.extra = column("extra")[arc].astype(np.int64)[order]
        self.d_from = self.d_to = self.busy = None
        if timed:
            self._traffic(table, column("s")[at].astype(np.int64), column("w")[at].astype(np.int64), at)
        elif len(at):
            inside = np.searchsorted(self.ids, marked)
            away, to = _matrix(table.column("b_from"), at), _matrix(table.column("b_to"), at)
            self.d_from, self.d_to = np.full((len(self.ids), away.shape[1]), -1), np.full((len(self.ids), away.shape[1]), -1)
            self.d_from[inside], self.d_to[inside] = away, to

    def _traffic(self, table: pa.Table, nodes: np.ndarray, factors: np.ndarray, rows: np.ndarray) -> None:
        """Volumes by target of an arc and slot, in one sorted list."""
        lists = [[np.frombuffer(x, np.int64) for x in table.column(k).combine_chunks().take(pa.array(rows)).to_pylist()] for k in ("b_from", "b_to")]
        order = np.argsort(nodes)
        self.busy, k = nodes[order], factors[order]
        owner = np.repeat(np.argsort(order), [len(x) for x in lists[0]])
        slot, volume = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in lists)
        self.slots = np.unique(slot)
        code = owner * (len(self.slots) + 1) + np.searchsorted(self.slots, slot)
        by = np.argsort(code)
        self.code, self.pressure = code[by], (k[owner] * volume * volume)[by]
        place = np.searchsorted(self.busy, self.t).clip(0, max(len(self.busy) - 1, 0))
        self.target = np.where(self.busy[place] == self.t, place, -1) if len(self.busy) else np.full(len(self.t), -1)

    def _pressure(self, target: np.ndarray, slot: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.slots, slot).clip(0, len(self.slots) - 1)
        code = target * (len(self.slots) + 1) + at
        found = np.searchsorted(self.code, code).clip(0, len(self.code) - 1)
        return np.where((self.slots[at] == slot) & (self.code[found] == code) & (target >= 0), self.pressure[found], 0)

    def seconds(self, arc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What arcs cost that are entered at these times: weight, extra, and the penalty between two slots, at most CAP weights."""
        w = self.w[arc]
        if self.busy is None or not len(self.code):
            return w + self.extra[arc]
        slot, into = at // SLOT_S, at % SLOT_S
        p0, p1 = self._pressure(self.target[arc], slot), self._pressure(self.target[arc], slot + 1)
        return w + self.extra[arc] + np.minimum((p0 + (p1 - p0) * into // SLOT_S) >> 20, CAP * w)

    def arcs_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs out of each of ``nodes``: the place in ``nodes``, and the arc."""
        n = self.degree[nodes]
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(nodes)), n)
        return owner, np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - self.first[nodes], n)

    def left(self, nodes: np.ndarray, goal_from: np.ndarray, goal_to: np.ndarray) -> np.ndarray:
        """Lower bounds from ``nodes`` to goals with these landmark distances; 0 where a node has none, FAR where no way leads there."""
        if self.d_to is None:
            return np.zeros(len(nodes), np.int64)
        a = np.maximum(self.d_to[nodes] - goal_to, goal_from - self.d_from[nodes]).max(axis=1)
        a = np.where(a > NEVER >> 1, FAR, np.maximum(a, 0))
        return np.where(self.d_to[nodes, 0] < 0, 0, a)


def relax(cell: Cell, g: np.ndarray, parent: np.ndarray, fresh: np.ndarray, allowed: Callable, dearer: Callable, upto: Callable | None = None) -> np.ndarray:
    """Improves labels g (sources x nodes, flat) along arcs inside the cell; returns the places that improved at any time.

    With ``upto`` (what a label's way to its goal costs at least), a source's most promising labels go first, and the others wait:
    most of them are beyond its answer by then.
    """
    n = len(cell.ids)
    ever = np.zeros(len(g), bool)
    ever[fresh] = True
    waiting, step = fresh[:0], 2 * int(np.median(cell.w)) if len(cell.w) else 0
    while len(fresh):
        if upto is not None:
            row, node = np.divmod(fresh, n)
            fine = allowed(row, node, g[fresh])
            fresh, row, node = fresh[fine], row[fine], node[fine]
            least, whole = np.full(len(g) // n, FAR), upto(row, node, g[fresh])
            np.minimum.at(least, row, whole)
            first = whole <= least[row] + step
            fresh, waiting = fresh[first], fresh[~first]
        row, node = np.divmod(fresh, n)
        owner, arc = cell.arcs_of(node)
        keep = cell.stays[arc]
        owner, arc = owner[keep], arc[keep]
        new = g[fresh][owner] + dearer(row[owner], arc, g[fresh][owner])
        place = row[owner] * n + cell.to[arc]
        better = new < g[place]
        better[better] = allowed(row[owner][better], cell.to[arc][better], new[better])
        place, new, source = place[better], new[better], cell.s[arc][better]
        np.minimum.at(g, place, new)
        won = new == g[place]
        parent[place[won]] = FAR
        np.minimum.at(parent, place[won], source[won])
        fresh = np.unique(place)
        ever[fresh] = True
        if len(waiting):
            fresh = np.union1d(fresh, waiting)
    return np.flatnonzero(ever)


def _round(factor: float, limit: int | None, timed: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One cell's share of a round."""

    def run(graph: pa.Table, labels: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        column = lambda k: labels.column(k).to_numpy(zero_copy_only=False)
        kind = column("kind")
        if (kind == 1).any():
            node = column("node").astype(np.int64)
            cell = Cell(graph, np.unique(node[kind < 2]), timed)
            here, zone = int(labels.column("cell")[0].as_py()), int(labels.column("zone")[0].as_py())
            src, g = column("src").astype(np.int64), column("g")
            whole = np.unique(src[kind == 1])
            most = max(1, LABELS // len(cell.ids))
            for k in range(0, len(whole), most):
                some = whole[k : k + most]
                mine = np.flatnonzero(np.isin(src, some))
                out += _relax_some(cell, here, zone, some, mine, kind, src, node, g, column, labels, factor, limit)
        names = [x.split()[0] for x in LABEL.split(", ")]
        types = [pa.int32()] * 3 + [pa.int64()] * 4
        merged = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 7
        parent = pa.array(merged[6], pa.int64(), mask=merged[6] == FAR)
        return pa.table([*(pa.array(x, t) for x, t in zip(merged[:6], types)), parent], names=names)

    return run


def _relax_some(cell, here, zone, some, mine, kind, src, node, g, column, labels, factor, limit) -> list[list[np.ndarray]]:
    n, rows = len(cell.ids), len(some)
    dist, parent = np.full(rows * n, FAR), np.full(rows * n, FAR)
    row = np.searchsorted(some, src[mine])
    place = row * n + np.searchsorted(cell.ids, node[mine]).clip(0, n - 1)
    known, came = kind[mine] == 0, kind[mine] == 1
    value = np.zeros(len(mine), np.int64)
    value[known | came] = g[mine][known | came].astype(np.int64)
    np.minimum.at(dist, place[known], value[known])
    # what is known of each source: its best answer, and its goal
    cut = np.full(rows, FAR)
    bound = column("cut")[mine]
    told = came & ~np.isnan(bound.astype(float))
    np.minimum.at(cut, row[told], bound[told].astype(np.int64))
    goal_at, goal_from, goal_to = np.full(rows, -1, np.int64), None, None
    aimed = np.flatnonzero(came & labels.column("goal").is_valid().to_numpy()[mine])
    if len(aimed):
        goal = column("goal")[mine][aimed].astype(np.int64)
        at = np.searchsorted(cell.ids, goal).clip(0, n - 1)
        goal_at[row[aimed]] = np.where(cell.ids[at] == goal, at, -1)
        with_marks = aimed[labels.column("goal_from").is_valid().to_numpy()[mine[aimed]]]
        if len(with_marks) and cell.d_to is not None:
            width = cell.d_to.shape[1]
            goal_from, goal_to = np.zeros((rows, width), np.int64), np.full((rows, width), FAR >> 1)
            goal_from[row[with_marks]] = _matrix(labels.column("goal_from"), mine[with_marks])
            goal_to[row[with_marks]] = _matrix(labels.column("goal_to"), mine[with_marks])

    def allowed(r: np.ndarray, v: np.ndarray, new: np.ndarray) -> np.ndarray:
        met = goal_at[r] == v
        if met.any():
            np.minimum.at(cut, r[met], new[met])
        left = cell.left(v, goal_from[r], goal_to[r]) if goal_from is not None else 0
        fine = new + left <= cut[r]
        return fine if limit is None else fine & (new <= limit)

    dear = None
    hits = np.flatnonzero(kind[mine] == 2)
    if len(hits):  # arcs that cost a source more: s in node, t in parent
        far_end = column("parent")[mine][hits].astype(np.int64)
        key = {}
        for a, (s, t) in enumerate(zip(cell.s.tolist(), cell.t.tolist())):
            key[s, t] = a
        arc = np.array([key.get(x, -1) for x in zip(node[mine][hits].tolist(), far_end.tolist())], np.int64)
        dear = np.unique(row[hits][arc >= 0] * len(cell.s) + arc[arc >= 0])

    def dearer(r: np.ndarray, arc: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = cell.seconds(arc, at)
        if dear is None or not len(dear):
            return w
        code = r * len(cell.s) + arc
        at = np.searchsorted(dear, code).clip(0, len(dear) - 1)
        return np.where(dear[at] == code, np.floor(w * factor + 0.5).astype(np.int64), w)

    arrived = np.flatnonzero(came)
    better = value[arrived] < dist[place[arrived]]
    arrived = arrived[better]
    arrived = arrived[allowed(row[arrived], place[arrived] % n, value[arrived])]
    np.minimum.at(dist, place[arrived], value[arrived])
    won = arrived[value[arrived] == dist[place[arrived]]]
    origin = column("parent")[mine][won].astype(float)
    parent[place[won]] = FAR
    has = ~np.isnan(origin)
    np.minimum.at(parent, place[won][has], origin[has].astype(np.int64))
    aimed = goal_from is not None
    upto = lambda r, v, g: g + cell.left(v, goal_from[r], goal_to[r])
    ever = relax(cell, dist, parent, np.unique(place[won]), allowed, dearer, upto if aimed else None)
    r, v = np.divmod(ever, n)
    if aimed:  # labels beyond the answer that was found on the way serve nothing
        fine = allowed(r, v, dist[ever])
        ever, r, v = ever[fine], r[fine], v[fine]
    full = lambda x, like: np.full(len(like), x, np.int64)
    out = [[full(0, ever), full(here, ever), full(zone, ever), some[r], cell.ids[v], dist[ever], parent[ever]]]
    owner, arc = cell.arcs_of(v)
    leaves = ~cell.stays[arc]
    owner, arc = owner[leaves], arc[leaves]
    new = dist[ever][owner] + dearer(r[owner], arc, dist[ever][owner])
    fine = new <= cut[r[owner]]
    if limit is not None:
        fine &= new <= limit
    owner, arc, new = owner[fine], arc[fine], new[fine]
    order = np.lexsort((cell.s[arc], new, cell.t[arc], r[owner]))  # of several ways out to a node the best is sent
    owner, arc, new = owner[order], arc[order], new[order]
    one = np.ones(len(order), bool)
    one[1:] = (r[owner][1:] != r[owner][:-1]) | (cell.t[arc][1:] != cell.t[arc][:-1])
    owner, arc, new = owner[one], arc[one], new[one]
    out.append([full(1, new), cell.t_cell[arc], cell.t_zone[arc], some[r[owner]], cell.t[arc], new, cell.s[arc]])
    return out


# ------------------------------------------------------------------ rounds
def search(
    net: Net, starts: DataFrame, limit: int | None = None, targets: DataFrame | None = None, goals: DataFrame | None = None, penalised: DataFrame | None = None, factor: float = 1, seen: list | None = None, onto: list | None = None
) -> DataFrame:
    """Least distances (src, node, g, parent) from the starts (src, node; several a source may be given, and g, else 0).

    ``limit``: no label beyond it. ``targets`` (src, dst): a source ends when nothing cheaper than its dearest target is
    left. ``goals`` (src, dst, one a source): only labels that can still improve the answer go on; labels of
    other nodes may be missing or too high. ``penalised`` (src, s, t): these arcs cost a source ``factor`` times as much.
    Of equal ways the parent found first stays, and the least of those found together. Starts outside the graph
    give their own label. ``seen`` gets a row count for each round. With ``onto``, a list that is empty at first, a search goes on from the labels of
    the ones before it with the same list: only what the new starts improve is touched.
    """
    spark = net.graph.sparkSession
    path, number = onto or (f"{scratch_dir(spark)}/rounds/search-{uuid.uuid4().hex}", 0)
    base = starts if "g" in starts.columns else starts.withColumn("g", F.lit(0))
    at = base.join(net.nodes.hint("merge"), "node", "left").select(
        F.lit(1).alias("kind"), F.coalesce("cell", F.lit(-1)).alias("cell"), F.coalesce("zone", F.lit(-1)).alias("zone"), "src", "node", F.col("g").cast("long").alias("g"), F.lit(None).cast("long").alias("parent")
    )
    arrivals = settle(at, "arrivals")
    outside = arrivals.filter("cell < 0").select("src", "node", "g", "parent")
    arrivals = arrivals.filter("cell >= 0")
    dear = None
    if penalised is not None:
        spots = net.nodes.withColumnRenamed("node", "s")
        dear = penalised.join(spots, "s").select(F.lit(2).alias("kind"), "cell", "zone", "src", F.col("s").alias("node"), F.lit(None).cast("long").alias("g"), F.col("t").alias("parent"))
        dear = settle(dear, "penalised")
    cuts = aim = met = None
    if goals is not None:
        aim = goals.select("src", F.col("dst").alias("goal"))
        if net.landmarks is not None:
            far = net.landmarks.select(F.col("node").alias("goal"), F.col("d_from").alias("from_mark"), F.col("b_from").alias("goal_from"), F.col("b_to").alias("goal_to"))
            aim = aim.join(far, "goal", "left")
            near = net.landmarks.select("node", F.col("d_to").alias("there"))
            ways = base.select("src", "node").join(near, "node").join(aim, "src").select("src", F.array_min(F.zip_with("there", "from_mark", lambda a, b: F.when((a < MARK_CAP) & (b < MARK_CAP), a + b))).alias("cut"))
            cuts = settle(ways.groupBy("src").agg(F.min("cut").alias("cut")), "cuts")
            aim = aim.drop("from_mark")
        aim = settle(aim, "goals")
        targets = goals
    if targets is not None:
        asked = settle(targets.select("src", F.col("dst").alias("node")).distinct(), "targets")
        count = asked.groupBy("src").agg(F.count("*").alias("asked"))
    none = F.lit(None).cast("binary")
    # many sources: each part of them takes the cells that its own labels arrived in, and of old labels only those of such sources there
    parts = -(-base.select("src").distinct().count() // SOURCES) if goals is not None else 1
    part = F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int").alias("part")
    while True:
        zones = [r.zone for r in arrivals.select("zone").distinct().collect()]  # ZONES at most
        if not zones:
            break
        labels = arrivals
        labels = labels.withColumn("cut", F.lit(None).cast("long")) if cuts is None else labels.join(cuts, "src", "left")
        if cuts is not None:
            labels = labels.filter("cut IS NULL OR g <= cut")
        if aim is None:
            labels = labels.withColumns({"goal": F.lit(None).cast("long"), "goal_from": none, "goal_to": none})
        else:
            labels = labels.join(aim, "src", "left")
            if "goal_from" not in labels.columns:
                labels = labels.withColumns({"goal_from": none, "goal_to": none})
        names = ["kind", "cell", "zone", "src", "node", "g", "parent"]
        void = {"cut": F.lit(None).cast("long"), "goal": F.lit(None).cast("long"), "goal_from": none, "goal_to": none}
        labels = labels.select(*names, *void)
        here = F.col("zone").isin(zones)
        active = settle(arrivals.select("src", "cell").distinct(), "active") if parts > 1 else None
        of_active = lambda df: df if active is None else df.join(active, ["src", "cell"], "left_semi").select(*names)
        if number:
            old = spark.read.schema(f"{LABEL}, round int").parquet(path).filter(here & (F.col("kind") == 0))
            labels = labels.union(of_active(old.select(*names)).withColumns(void))
        if dear is not None:
            labels = labels.union(of_active(dear.filter(here)).withColumns(void))
        graph, key = net.graph.filter(here), ["cell"]
        if parts > 1:
            key = ["cell", "part"]
            graph, labels = graph.join(active.select("cell", part).distinct(), "cell"), labels.withColumn("part", part)
        got = graph.groupBy(*key).cogroup(labels.groupBy(*key)).applyInArrow(_round(factor, limit, net.timed), LABEL)
        # state lies by zone; what goes on lies apart, as it is read once
        got.write.partitionBy("kind", "zone").parquet(f"{path}/round={number}")
        made = spark.read.schema(LABEL).parquet(f"{path}/round={number}").select(*names)
        number += 1
        arrivals = made.filter("kind = 1")
        if seen is not None:
            seen.append(made.filter("kind = 0").count())
        hit = None
        if targets is not None:
            hit = settle(made.filter("kind = 0").join(asked, ["src", "node"], "left_semi").select("src", "node", "g"), "hit")
        if hit is not None and not hit.isEmpty():  # most rounds meet no target, and change no cut
            met = hit if met is None else met.union(hit)
            met = settle(met.groupBy("src", "node").agg(F.min("g").alias("g")), "met")
            ends = met.groupBy("src").agg(F.count("*").alias("met"), F.max("g").alias("cut")).join(count, "src").filter("met = asked").select("src", "cut")
            cuts = settle((ends if cuts is None else ends.union(cuts)).groupBy("src").agg(F.min("cut").alias("cut")), "cuts")
    if onto is not None:
        onto[:] = [path, number]
    state = outside
    if number:
        every = spark.read.schema(f"{LABEL}, round int").parquet(path).filter("kind = 0")
        best = every.groupBy("src", "node").agg(F.min(F.struct("g", "parent")).alias("b")).select("src", "node", "b.g", "b.parent")
        state = best.union(outside)
    return state
