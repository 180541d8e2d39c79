"""Prefix tree of conversations by digests of fixed-length blocks of turns.

A prefix of d turns is known by its depth and a 128-bit key: the exclusive or of one mixed hash for each turn,
made from the turn's digest and its position. Keys of longer prefixes follow from those of shorter ones, so
blocks of ``BLOCK`` turns are keyed first:

1. conversations are grouped by the keys at the ends of their blocks; a block that all
   conversations of its beginning share needs no closer look, its turns are nodes with the same members;
2. only the blocks whose siblings diverge are opened: their turns, one set for each distinct block, are
   grouped by the keys of the prefixes inside.

Sums over the members of every node go the same way, blocks first. They give all figures without
walking the tree:

* every childless node is counted at its least member, so n_leaves is a sum over members;
* a conversation shares its turns with a smaller one up to the depth at which it becomes the least member;
  ``shared`` is the code points up to there. In a node of depth d, all members but the least share theirs
  at least up to d, so saved_tokens = sum of shared over them - (n_convs - 1) * code points before turn d.

Hot first turns, blocks and whole conversations meet in partial sums. Turns of one conversation are numbered, and its
blocks chained, in two levels, so even a conversation with very many turns is not one task's work. Only
the ids that end at one node come together, in order, for their hash: as a stream of strings, never as a list.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.llm.common import discard, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns in a block; conversations that share a beginning; turns of it at most, plus one.
BLOCK, HUNDRED, HEADS = 8, 100, 6
#: Turn numbers, blocks, and ids that are handled together, as powers of two.
TURN_BITS, CHAIN_BITS, ID_BITS = 12, 9, 12

NODE = ["depth", "k1", "k2"]


def carried(rows: DataFrame, key: str, chunk: Column, order: list[str], sums: dict[str, Column], xors: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Adds exclusive running sums and exclusive ors over the rows of each ``key`` in ``order``.

    ``chunk`` grows with the order; rows run inside a chunk, and whole chunks are carried over.
    """
    made = {**{n: (F.sum, v) for n, v in sums.items()}, **{n: (F.bit_xor, v) for n, v in xors.items()}}
    rows = rows.withColumn("chunk", chunk)
    whole = rows.groupBy(key, "chunk").agg(*[f(v).alias(f"w_{n}") for n, (f, v) in made.items()])
    over = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(key, "chunk", *[F.coalesce(f(f"w_{n}").over(over), F.lit(0)).alias(f"b_{n}") for n, (f, _) in made.items()])
    inside = Window.partitionBy(key, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(f(v).over(inside), F.lit(0)).alias(f"i_{n}") for n, (f, v) in made.items()])
    joined = local.join(before.hint("merge"), [key, "chunk"])
    both = {n: F.col(f"b_{n}") + F.col(f"i_{n}") if n in sums else F.col(f"b_{n}").bitwiseXOR(F.col(f"i_{n}")) for n in made}
    return joined.select(*[c for c in rows.columns if c != "chunk"], *[c.cast("long").alias(n) for n, c in both.items()])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): the turns of every conversation, from 1, by turn (null first), then digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    slim = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    first = F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 62)))  # null first
    placed = carried(slim, "conv_id", first, [F.col("turn").asc_nulls_first(), F.col("digest")], {"pos": F.lit(1)})
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars) of the rebuilt conversations; those without turns have one row with pos 0.

    The first turns come from the conversation that leads the hundred, the others from the conversation itself.
    """
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", share)
    leads = convs.filter(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("lead"), F.least("n", F.lit(HEADS - 1)).alias("has"))
    plan = convs.withColumn("lead", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(leads, "lead", "left")
    plan = materialize(plan.select("conv_id", "lead", "n", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("m")), "rebuilding")
    heads = turns.filter((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "lead")
    taken = plan.filter("m > 0").select("conv_id", "lead", "m").join(heads, "lead").filter("pos <= m")
    own = turns.join(plan.select("conv_id", "h", "m").hint("merge"), "conv_id").filter("pos > h")
    none = plan.filter("m = 0 AND n <= h")
    return taken.select("conv_id", "pos", "digest", "chars").union(own.select("conv_id", F.col("pos") - F.col("h") + F.col("m"), "digest", "chars")).union(
        none.select("conv_id", F.lit(0).cast("long"), F.lit(""), F.lit(0).cast("long"))
    )


def blocks_of(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """(conv_id, b, turns, s1, s2, e1, e2, chars, before): the blocks of every conversation with the keys at their begin and end.

    ``before`` is the code points of the blocks before it. Every conversation has a block -1 without turns, which ends at the root.
    """
    two = [F.xxhash64("digest", "pos").alias("m1"), F.xxhash64("pos", "digest").alias("m2")]
    real = turns.filter("pos > 0").select("conv_id", F.floor((F.col("pos") - 1) / width).alias("b"), F.struct("pos", "chars", *two).alias("t"))
    xor = lambda part: F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t[part]))
    made = real.groupBy("conv_id", "b").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.sum("t.chars").alias("chars"))
    made = made.select("*", xor("m1").alias("x1"), xor("m2").alias("x2"))
    chained = carried(made, "conv_id", F.shiftright("b", CHAIN_BITS), ["b"], {"before": F.col("chars")}, {"s1": F.col("x1"), "s2": F.col("x2")})
    e1, e2 = F.col("s1").bitwiseXOR(F.col("x1")), F.col("s2").bitwiseXOR(F.col("x2"))
    chained = chained.select("conv_id", "b", "turns", "s1", "s2", e1.alias("e1"), e2.alias("e2"), "chars", "before")
    zero = F.lit(0).cast("long")
    roots = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long"), F.array().cast(made.schema["turns"].dataType), zero, zero, zero, zero, zero, zero)
    return chained.union(roots)


def turns_inside(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """The turns of each distinct block (``groups``: b, e1, e2, conv_id, n, diverges), with the keys of the prefixes that they end."""
    mine = blocks.select("b", "conv_id", "turns", "s1", "s2", "before").join(groups, ["b", "conv_id"])
    upto = lambda part, start, k: F.aggregate(F.slice("turns", 1, k), F.col(start), lambda a, t: a.bitwiseXOR(t[part]))
    chars = lambda k: F.aggregate(F.slice("turns", 1, k), F.col("before"), lambda a, t: a + t["chars"])
    node = lambda t, i: F.struct(
        t["pos"].alias("depth"), upto("m1", "s1", i + 1).alias("k1"), upto("m2", "s2", i + 1).alias("k2"), upto("m1", "s1", i).alias("u1"), upto("m2", "s2", i).alias("u2"), chars(i).alias("before")
    )
    opened = mine.filter("b >= 0").select("b", "e1", "e2", "conv_id", "n", "diverges", F.explode(F.transform("turns", node)).alias("t")).select("b", "e1", "e2", "conv_id", "n", "diverges", "t.*")
    zero = F.lit(0).cast("long")
    root = mine.filter("b < 0").select("b", "e1", "e2", "conv_id", "n", F.lit(False).alias("diverges"), zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("u1"), zero.alias("u2"), zero.alias("before"))
    return opened.union(root)


def block_groups(blocks: DataFrame) -> DataFrame:
    """(b, e1, e2, conv_id, n, diverges): distinct blocks, their least member and number, and whether some conversation that
    shares their beginning does not go on with them."""
    groups = blocks.groupBy("b", "e1", "e2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    groups = materialize(groups, "blocks")
    begin = groups.select((F.col("b") + 1).alias("b"), F.col("e1").alias("s1"), F.col("e2").alias("s2"), F.col("n").alias("all"))
    told = groups.filter("b > 0").join(begin, ["b", "s1", "s2"]).select("b", "e1", "e2", "conv_id", "n", (F.col("n") < F.col("all")).alias("diverges"))
    everyone = groups.filter("b = -1").select("n").first()
    edge = groups.filter("b <= 0").select("b", "e1", "e2", "conv_id", "n", (F.col("n") < F.lit(everyone.n if everyone else 0)).alias("diverges"))
    return told.union(edge)


def ends_of(blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, chars): the node at which each conversation ends, and all its code points."""
    last = F.max(F.struct("b", F.size("turns").alias("turns"), "e1", "e2", (F.col("before") + F.col("chars")).alias("chars"))).alias("l")
    depth = F.when(F.col("l.b") < 0, 0).otherwise(F.col("l.b") * BLOCK + F.col("l.turns")).cast("long")
    return blocks.groupBy("conv_id").agg(last).select("conv_id", depth.alias("depth"), F.col("l.e1").alias("k1"), F.col("l.e2").alias("k2"), "l.chars")


def ends_hash(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha): SHA-256 of the ids of a node's ends, ascending, joined by commas.

    Ids are joined by ranges first; the strings of a node then pass one hash in order, one at a time.
    """
    chunk = F.shiftright("conv_id", ID_BITS)
    strings = ends.groupBy(*NODE, chunk.alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "sha"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key == at:
                    sha.update(b",")
                else:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield flush()
        if at is not None:
            done.append((*at, sha.hexdigest()))
            yield flush()

    ordered = strings.repartition(*[F.col(c) for c in NODE]).sortWithinPartitions(*NODE, "chunk")
    return ordered.select(*NODE, "ids").mapInArrow(run, "depth long, k1 long, k2 long, sha string")


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Null roles and texts are
    empty; turns with one number, repeated rows too, all stay, in order of the md5 of length of role, role and text; rows without conv_id
    take no part. An empty table has no nodes, not even a root.
    """
    turns = materialize(numbered(conversations), "turns")
    blocks = materialize(blocks_of(rebuilt(turns)), "conversation-blocks")
    inside = materialize(turns_inside(blocks, block_groups(blocks)), "turns-inside")
    first = [F.first(c).alias(c) for c in ("u1", "u2", "before")]
    same, split = inside.filter("NOT diverges"), inside.filter("diverges")
    nodes = same.select(*NODE, "conv_id", "n", "u1", "u2", "before").union(
        split.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), *first).select(*NODE, "conv_id", "n", "u1", "u2", "before")
    )
    nodes = materialize(nodes, "nodes")

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    known = materialize(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "known-nodes")
    ends = materialize(ends_of(blocks), "ends")
    # where a conversation becomes the least member, and whether it stands for a childless node
    least = known.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    each = ends.select("conv_id", "chars").join(least, "conv_id", "left").select(
        "conv_id", F.coalesce("from.before", "chars").alias("shared"), F.coalesce("from.depth", F.lit(1 << 62)).alias("own_from"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")
    )
    each = materialize(each, "shared")

    members = blocks.select("conv_id", "b", "e1", "e2").join(each.hint("merge"), "conv_id")
    top = F.min(F.struct("conv_id", "own_from", "shared")).alias("top")
    sums = members.groupBy("b", "e1", "e2").agg(F.sum("shared").alias("shared"), F.sum("leaf").alias("leaves"), top)
    summed = inside.select("b", "e1", "e2", "diverges", *NODE).join(sums, ["b", "e1", "e2"]).drop("b", "e1", "e2")
    both = summed.filter("NOT diverges").select(*NODE, "shared", "leaves", "top").union(
        summed.filter("diverges").groupBy(*NODE).agg(F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves"), F.min("top").alias("top"))
    )
    full = known.join(both, NODE).join(ends_hash(ends), NODE, "left")
    full = materialize(full.withColumn("own_from", F.col("top.own_from")).withColumn("rest", F.col("shared") - F.col("top.shared")), "full-nodes")

    # the parent's least member is the node's own, but where that conversation first is the least one
    turned = full.filter("depth > 0 AND own_from = depth").withColumn("up", F.col("depth") - 1)
    ups = known.select(F.col("depth").alias("up"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent"))
    other = turned.join(ups, ["up", "u1", "u2"]).drop("up").withColumnRenamed("parent", "parent_conv_id")
    same_up = full.filter("depth = 0 OR own_from < depth").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    saved = F.col("rest") - (F.col("n") - 1) * F.col("before")
    out = other.select(*same_up.columns).union(same_up).select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    discard(turns, nodes)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same in DuckDB: every prefix as a list of turns, subtrees as lists that begin with it. crc32 comes from its table of 256 remainders.
OP13_SQL = r"""
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
rem AS (SELECT list(v ORDER BY i) AS r FROM bits WHERE k = 8),
crc(c, s, k, v) AS (
  SELECT c, c::VARCHAR, 0, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL SELECT c, s, k + 1, xor(v >> 8, r[1 + xor(v & 255, ascii(s[k + 1]))]) FROM crc, rem WHERE k < length(s)),
h AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = length(s)),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
      FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT h.c, 0 AS own, o.p, o.role, o.text FROM h JOIN o ON o.c = h.c - h.c % 100 AND o.p <= h.h
      UNION ALL SELECT h.c, 1, o.p, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.p > h.h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, md5(length(role) || ':' || role || text) AS g, length(text) AS z FROM t),
m AS (SELECT c, 0 AS d, '' AS key, NULL::VARCHAR AS up, 0 AS z FROM h
      UNION ALL SELECT c, d, string_agg(g, '') OVER w AS key, coalesce(string_agg(g, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), z
      FROM n WINDOW w AS (PARTITION BY c ORDER BY d)),
node AS (SELECT key, d, min(c) AS c, count(*) AS n, any_value(up) AS up, any_value(z) AS z FROM m GROUP BY key, d),
last AS (SELECT c, arg_max(key, d) AS key FROM m GROUP BY c),
ends AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM last GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY up),
path AS (SELECT DISTINCT a.key, b.key AS below, b.n, b.z, k.n IS NULL AS leaf
         FROM (SELECT key, c, d FROM m) a JOIN m ON m.c = a.c AND m.d >= a.d JOIN node b ON b.key = m.key LEFT JOIN kids k ON k.key = b.key),
sums AS (SELECT key, count(*) FILTER (leaf) AS leaves, sum((n - 1) * z) AS saved FROM path GROUP BY key)
SELECT node.c AS conv_id, node.d::BIGINT AS depth, u.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves,
       sums.saved::BIGINT AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
FROM node JOIN sums ON sums.key = node.key LEFT JOIN node u ON u.key = node.up LEFT JOIN kids ON kids.key = node.key LEFT JOIN ends ON ends.key = node.key
"""
