"""Hard negatives, minimax shards and the prefix tree: against plain loops and their SQL, and on hostile rows."""

import bisect
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from roadspark.llm import hard_negatives, prefix_trie, queries, sharding


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_minimax_shards", "op13_prefix_trie"])
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = queries.QUERIES[name](spark, sf)
    other = con.sql(queries.ORACLES[name])
    at = [other.columns.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in other.fetchall())


# ------------------------------------------------------------------ hard negatives
def test_tables_and_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for dims, top in ((1, 3), (8, 500), (13, 40), (64, 256)):
        a, c = rng.integers(-top, top + 1, (5, dims)), rng.integers(-top, top + 1, (9, dims))
        planes = int(max(abs(c).max(), 1)).bit_length() + 1
        assert (hard_negatives.scores(hard_negatives.subset_sums(a), hard_negatives.bit_planes(c, planes)) == c @ a.T).all()


def plain_negatives(rows):
    known = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            key = ((label + 1) % 10 if i % 7 == 0 else label, [np.floor(256 * np.float64(np.float32(x))) for x in v])
            known[i] = min(known[i], key) if i in known else key
    out = []
    for a, (label, v) in known.items():
        if a % 50:
            continue
        score = {i: int(sum(x * y for x, y in zip(v, u))) for i, (_, u) in known.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if known[i][0] == label][:5]:
            fit = [i for i in order if known[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit[:3])]
    return sorted(out)


def test_negatives_of_hostile_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 30)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.3, 0.9]) for _ in range(5)], rng.randrange(3)) for i in range(160)]
    rows += [(k, rows[k][1], rows[k][2]) for k in (50, 51)]  # repeated rows
    rows += [(200, [0.5] * 5, 1), (201, [0.5] * 5, 2), (202, [0.5] * 5, 2), (250, [], 1), (251, [0.5], 1), (252, [0.5] * 11, 2)]  # ties, other lengths
    rows += [(None, [0.5] * 5, 1), (300, None, 1), (350, [0.5] * 5, None), (400, [0.5, None, 0.1, 0.1, 0.1], 1), (401, [float("nan")] * 5, 1), (402, [float("inf")] * 5, 1), (-50, [0.4] * 5, 2)]
    df = spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, rank int, planes string")
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.hard_negatives(df).collect())
    assert got == plain_negatives(rows) and got
    assert hard_negatives.hard_negatives(df.limit(0)).collect() == []


# ------------------------------------------------------------------ shards
def least_capacity(sizes, shards):
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        mid, at = (low + high) // 2, 0
        for _ in range(shards):
            at = ends[bisect.bisect_right(ends, at + mid) - 1]
        low, high = (low, mid) if at >= ends[-1] else (mid + 1, high)
    return high


@pytest.mark.parametrize("n, shards", [(3, 5), (60, 7), (900, 12)])
def test_capacity_is_the_smallest(spark, n, shards):
    rng = random.Random(n)
    groups = [(h, rng.choice([16, 20, 50, 1000, 5000])) for h in sorted(rng.sample(range(1 << 60), n))]
    df = spark.createDataFrame(groups, "hash long, size long")
    capacity, cuts = sharding.cut_hashes(df, shards, sum(s for _, s in groups), most_cells=128, first_bits=3)
    filled = [0] * shards
    for h, size in groups:
        filled[bisect.bisect_right(cuts, h)] += size
    assert capacity == least_capacity([s for _, s in groups], shards) == max(filled) and cuts == sorted(cuts)


def test_shards_of_hostile_rows(spark):
    texts = [None, "", "same", "same", "é" * 50, "big" * 4000] + [f"text {k} " * (k % 5 + 1) for k in range(60)] + ["hot"] * 40
    rows = [(None if k == 7 else k % 95, x, "s", 1, 2) for k, x in enumerate(texts)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string, size int, hash int"), 6).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    want = sorted((i if i is not None else -1, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got) == want
    shards, slots = {}, {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(x) == 1 for x in shards.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ------------------------------------------------------------------ prefix tree
def plain_tree(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            talks.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    talks = {c: [x[3:] for x in sorted(t)] for c, t in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - c % 100 if c >= 0 else c + (-c) % 100
        built[c] = tuple(talks.get(lead, [])[:h] + own[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if built[c] == p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(kids.get(p, [])), sum(q not in kids for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def tree_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [0, 1, 2, 3, 5, 8, 99, 100, 101, 150, 199, 305, 399, -50, 12345678901]:
        for turn in range(rng.choice([0, 1, 3, 9, 20])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None]) if rng.random() < 0.8 else "é" * 3))
    same = [(turn, "user", f"turn {turn}") for turn in range(19)]
    rows += [(c, *x) for c in (700, 701, 702, 703, 704, 777) for x in same] + [(c, *x) for c in (710, 711) for x in same[:10]]
    rows += [(800, None, "user", "first"), (800, None, "user", "another"), (800, 4, None, "x"), (800, 4, "user", "x"), (800, 4, "user", "x"), (None, 1, "user", "lost"), (820, 1, "user", None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_plain_tree(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    monkeypatch.setattr(prefix_trie, "CHAIN_BITS", 1)
    monkeypatch.setattr(prefix_trie, "TURN_BITS", 2)
    rows = tree_rows(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, pos string")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in prefix_trie.prefix_tree(df).collect()), key=key) == sorted(plain_tree(rows), key=key)
    assert prefix_trie.prefix_tree(df.limit(0)).collect() == []
