"""Noding of the whole table against brute force."""

from collections import defaultdict

from roadspark.plans import QUERIES
from roadspark.sources.fixtures import Tables


def test_every_way_is_noded_against_every_other(spark, sf):
    rows = Tables(spark, sf).w_node.select("way_id", "seq", "node_id").collect()
    ways, users = defaultdict(list), defaultdict(set)
    for way, seq, node in rows:
        ways[way].append((seq, node))
        users[node].add(way)
    want = {w: 1 + sum(1 < seq < len(v) and len(users[node]) > 1 for seq, node in v) for w, v in ways.items()}
    got = QUERIES["i01_shared_vertices"](spark, sf).collect()
    assert len(got) == len(want) and {r.way_id: r.pieces for r in got} == want
