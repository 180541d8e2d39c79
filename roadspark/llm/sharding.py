"""Shards of near equal size by minimax contiguous partition (DataFrame functions only).

Documents with equal texts are one atomic group. Groups stand in the order of a hash of
their text, and a shard is a run of them; the runs are chosen so that the largest shard is as
small as it can be:

1. a group that is no smaller than the mean of what is left takes a shard of its own (each such
   group is a fortieth of something at least, so there are fewer of them than shards);
2. a binary search finds the smallest capacity for which greedy filling needs no more shards
   than there are;
3. cuts are put as near to equal shares as that capacity allows.

No task sorts all groups. Their sizes are summed by cells of the hash range; each cell's end
is a known border of groups. With the borders known so far, the search gives two capacities that
enclose the right one, and the stretches of positions that it has looked at; only the cells
there are split, by a pass over their groups, until no answer depends on the inside of a cell.
Then the capacity and the cuts are those of the single groups. A row's shard follows from its
hash and the cuts alone, without a join.

The tables of cells hold ``MOST_CELLS`` rows at most, whatever the input.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.llm.common import discard, documents, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shards; fixed bytes of a document besides its text; bits of the group hash; cells in a table of borders.
SHARDS, RECORD_BYTES, HASH_BITS, MOST_CELLS = 40, 16, 60, 12_288
#: Hash bits of the first cells.
FIRST_BITS = 12


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table of at most MOST_CELLS + 2 ** FIRST_BITS rows, settled as one file."""
    return materialize(df.repartition(1), name)


def hash60(text: Column) -> Column:
    """60 bits of md5, equal in every engine that has it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, hash, place): one row a document, without its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), hash60(text).alias("hash"))
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("hash").cast("string"))
    return slim.withColumn("place", hash60(own))


def own_shards(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Hashes of the groups that take a shard of their own, largest first, and the size of all others."""
    left = groups.agg(F.sum("size")).first()[0] or 0
    taken: list[int] = []
    for g in groups.orderBy(F.col("size").desc(), "hash").limit(shards - 1).collect():
        if g["size"] * (shards - len(taken)) < left:
            break
        taken.append(g["hash"])
        left -= g["size"]
    return taken, left


# ------------------------------------------------- borders, as one row of arrays
def _at_most(x: str) -> str:
    """Number of the last border <= x, by halving steps."""
    return f"aggregate(steps, 0, (i, b) -> if(i + b < size(at) AND at[i + b] <= {x}, i + b, i))"


def _below(x: str, maybe: bool) -> str:
    """Last border <= x; maybe: the last that there can be, which is x inside a cell of several groups."""
    found = f"transform(array({_at_most(x)}), i -> at[i])[0]"
    return f"transform(array({_at_most(x)}), i -> if(mixed[i], {x}, at[i]))[0]" if maybe else found


def _above(x: str, maybe: bool) -> str:
    """First border >= x; maybe: the first that there can be."""
    inside = f"if(mixed[i], {x}, at[i + 1])" if maybe else "at[i + 1]"
    return f"transform(array({_at_most(x)}), i -> if(at[i] >= {x}, at[i], {inside}))[0]"


def _fill(capacity: str, shards: int, maybe: bool) -> str:
    """Greedy filling from the left: the ends of the shards, from 0 on."""
    return f"aggregate(sequence(1, {shards}), array(0L), (ends, k) -> concat(ends, array({_below(f'element_at(ends, -1) + {capacity}', maybe)})))"


def _fill_back(capacity: str, shards: int, total: int, maybe: bool) -> str:
    """Greedy filling from the right: the begins of the shards, from the last one's end on."""
    return f"aggregate(sequence(1, {shards}), array({total}L), (ends, k) -> concat(ends, array({_above(f'greatest(element_at(ends, -1) - {capacity}, 0L)', maybe)})))"


def _least_capacity(shards: int, total: int, maybe: bool) -> str:
    """The smallest capacity whose greedy filling reaches the end."""
    mid = "((s.a + s.b) div 2)"
    reach = f"aggregate(sequence(1, {shards}), 0L, (pos, k) -> {_below(f'pos + {mid}', maybe)})"
    step = f"if(s.a >= s.b, s, if({reach} >= {total}L, named_struct('a', s.a, 'b', {mid}), named_struct('a', {mid} + 1, 'b', s.b)))"
    return f"aggregate(sequence(1, 62), named_struct('a', {-(-total // shards)}L, 'b', {total}L), (s, r) -> {step}).b"


def _cuts(capacity: int, shards: int, total: int) -> str:
    """Ends of the shards: the border nearest to an equal share, no further than the capacity from the end before, and
    late enough for the rest to fit (``back``)."""
    share = f"({total}L * k div {shards})"
    low, high = _below(share, False), _above(share, False)
    near = f"transform(array(struct({low} AS a, {high} AS b)), p -> if({share} - p.a <= p.b - {share}, p.a, p.b))[0]"
    forward = f"aggregate(sequence(1, {shards}), array(0L), (ends, k) -> concat(ends, array(least({near}, {_below(f'element_at(ends, -1) + {capacity}L', False)}))))"
    return f"transform({forward}, (x, k) -> greatest(x, back[{shards} - k]))"


def _bordered(cells: DataFrame) -> DataFrame:
    """One row of arrays: positions of the borders (0 first), hashes under which the groups before them lie, and whether
    the cell behind a border holds several groups."""
    steps = ", ".join(str(1 << b) for b in range(MOST_CELLS.bit_length(), -1, -1))
    ordered = cells.agg(F.sort_array(F.collect_list(F.struct("start", "ends", "low", "high", (F.col("n") > 1).alias("mixed")))).alias("c"))
    return ordered.selectExpr("concat(array(0L), c.ends) AS at", "concat(array(0L), c.high) AS below", "concat(c.mixed, array(false)) AS mixed", f"array({steps}) AS steps")


def _placed(parts: DataFrame) -> DataFrame:
    """Cells (cell, from, low, high, size, n) with start and ends, their positions; ``from`` is the position where their parent cell begins."""
    run = Window.partitionBy("from").orderBy("low")
    return parts.withColumn("ends", F.col("from") + F.sum("size").over(run)).select("low", "high", (F.col("ends") - F.col("size")).alias("start"), "ends", "n")


def _split(groups: DataFrame, cells: DataFrame, parts: int) -> DataFrame:
    """The groups of ``cells`` summed by ``parts`` smaller cells of each."""
    keys = cells.withColumn("width", F.ceil((F.col("high") - F.col("low")) / parts).cast("long"))
    shift = HASH_BITS - FIRST_BITS
    keys = keys.select("low", "high", "width", F.col("start").alias("from"), F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("head"))
    inside = groups.withColumn("head", F.shiftright("hash", shift)).join(F.broadcast(keys), "head")  # at most MOST_CELLS + 2 ** FIRST_BITS rows
    inside = inside.filter("hash >= low AND hash < high").withColumn("part", F.expr("(hash - low) div width"))
    sums = inside.groupBy("from", F.expr("low + part * width").alias("low_"), F.expr("least(low + (part + 1) * width, high)").alias("high_")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return _placed(sums.select("from", F.col("low_").alias("low"), F.col("high_").alias("high"), "size", "n"))


def cut_hashes(groups: DataFrame, shards: int, total: int, most_cells: int = MOST_CELLS, first_bits: int = FIRST_BITS) -> tuple[int, list[int]]:
    """(capacity, cuts): the smallest feasible capacity, and ``shards`` - 1 hashes; a group's shard is the number of cuts <= its hash."""
    if shards == 1:
        return total, []
    shift = HASH_BITS - first_bits
    first = groups.groupBy(F.shiftright("hash", shift).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    cells = _small(_placed(first.select(F.lit(0).cast("long").alias("from"), F.shiftleft("cell", shift).alias("low"), F.shiftleft(F.col("cell") + 1, shift).alias("high"), "size", "n")), "cells")
    widest = groups.agg(F.max("size")).first()[0]
    while True:
        row = _small(_bordered(cells), "borders")
        least, most = row.selectExpr(_least_capacity(shards, total, True), _least_capacity(shards, total, False)).first()
        ends = row.selectExpr(
            f"{_fill(f'{least}L', shards, False)} AS fill_low", f"{_fill(f'{most}L', shards, True)} AS fill_high",
            f"{_fill_back(f'{most}L', shards, total, True)} AS back_low", f"{_fill_back(f'{least}L', shards, total, False)} AS back_high",
            f"{_fill_back(f'{most}L', shards, total, False)} AS back", "*",
        )
        final = ends.withColumn("cuts", F.expr(_cuts(most, shards, total))).first()
        # stretches of positions in which the borders matter
        asked = [(a + least, b + most) for a, b in zip(final.fill_low[:-1], final.fill_high[:-1])] + [(a - most, b - least) for a, b in zip(final.back_low[:-1], final.back_high[:-1])]
        asked += [(total * k // shards - widest, total * k // shards + widest) for k in range(1, shards)] + [(x + most, x + most) for x in final.cuts[:-1]]
        spans = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in sorted({(max(a, 0), min(b, total)) for a, b in asked if a < total and b > 0})])
        needed = F.exists(spans, lambda s: (s["a"] < F.col("ends")) & (s["b"] > F.col("start")))
        marked = _small(cells.withColumn("needed", needed), "cells")
        opened = marked.filter("needed AND n > 1")
        count = opened.count()
        if not count:
            border = dict(zip(final.at, final.below))
            discard(cells, marked, row)
            return most, [border[x] for x in final.cuts[1:-1]]
        # cells between the stretches become one, so that the table stays small
        order = Window.orderBy("low")
        runs = marked.withColumn("run", F.sum(F.when(F.col("needed") | F.lag("needed", 1, True).over(order), 1).otherwise(0)).over(order))
        closed = runs.filter("NOT needed").groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("start").alias("start"), F.max("ends").alias("ends"), F.sum("n").alias("n")).drop("run")
        parts = max(2, most_cells // count)
        after = _small(_split(groups, opened, parts).union(closed).union(marked.filter("needed AND n = 1").select("low", "high", "start", "ends", "n")), "cells")
        discard(cells, marked, row)
        cells = after


def shard_of(own: list[int], cuts: list[int]) -> Column:
    """The shard of a group, from its hash: groups with a shard of their own come first."""
    shard = F.lit(len(own))
    for x in cuts:
        shard = shard + F.when(F.col("hash") >= F.lit(x).cast("long"), 1).otherwise(0)
    for k, h in enumerate(own):
        shard = F.when(F.col("hash") == F.lit(h).cast("long"), k).otherwise(shard)
    return shard.cast("int")


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot: gapless numbers from 0 inside each shard, in order of place and id.

    Two levels: rows are counted by shard and cell of ``place``, the counts run over the cells, and
    only the rows of one cell are ranked together, so a large shard is many tasks.
    """
    bits = max(8, min(16, (rows.count() // 80_000).bit_length()))
    celled = rows.withColumn("cell", F.shiftright("place", HASH_BITS - bits))
    run = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = celled.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("place", "doc_id", "hash")) - 1
    return celled.withColumn("rank", rank).join(before.hint("merge"), ["shard", "cell"]).withColumn("slot", (F.col("before") + F.col("rank")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    Law ``bytes``: the largest shard is the smallest that runs of whole groups allow. A null
    text counts as an empty one, so its size is the record's alone and its crc32 is 0. Null and
    repeated ids are rows like others; rows equal in id and text get neighbouring slots. With
    fewer groups than shards some shards stay empty; an empty table gives no rows. Other columns are not read.
    """
    slim = materialize(sized(docs), "sized")
    groups = materialize(slim.groupBy("hash").agg(F.sum("size").alias("size")), "groups")
    own, left = own_shards(groups, shards)
    rest = groups.filter(~F.col("hash").isin(own)) if own else groups
    cuts = cut_hashes(rest, shards - len(own), left)[1] if left else []
    discard(groups)
    placed = with_slots(slim.withColumn("shard", shard_of(own, cuts)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


#: The same in DuckDB, over the borders of all groups. crc32 comes from its table of 256 remainders.
OP12_SQL = r"""
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
rem AS (SELECT list(v ORDER BY i) AS r FROM bits WHERE k = 8),
t AS (SELECT doc_id, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS hash FROM documents),
b AS MATERIALIZED (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM t),
d AS (SELECT doc_id, hash, strlen(text)::BIGINT + 16 AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || hash::VARCHAR), 1, 15))::BIGINT AS place,
             xor(list_reduce(bytes, lambda a, x: xor(a >> 8, r[1 + (xor(a, x) & 255)]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM b, rem),
g AS MATERIALIZED (SELECT hash, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY sum(size) DESC, hash) AS rk FROM d GROUP BY hash),
own(k, rest) AS (
  SELECT 0::BIGINT, sum(size)::BIGINT FROM g
  UNION ALL SELECT k + 1, rest - g.size FROM own JOIN g ON g.rk = k + 1 WHERE k < 39 AND g.size * (40 - k) >= rest),
z AS MATERIALIZED (SELECT 40 - max(k) AS n, max(k) AS own, min(rest) AS total FROM own),
p AS MATERIALIZED (SELECT hash, size, (sum(size) OVER (ORDER BY hash))::BIGINT AS upto FROM g, z WHERE rk > own),
w AS MATERIALIZED (SELECT n, own, total, list_concat([0::BIGINT], (SELECT coalesce(list(upto ORDER BY upto), []) FROM p)) AS borders FROM z),
search(a, b, k, pos) AS (
  SELECT ((total + n - 1) // n)::BIGINT, total, 0::BIGINT, 0::BIGINT FROM w
  UNION ALL SELECT CASE WHEN pos < total AND k = n THEN (a + b) // 2 + 1 ELSE a END, CASE WHEN pos >= total THEN (a + b) // 2 ELSE b END,
                   CASE WHEN pos >= total OR k = n THEN 0 ELSE k + 1 END,
                   CASE WHEN pos >= total OR k = n THEN 0 ELSE list_max(list_filter(borders, lambda x: x <= pos + (a + b) // 2)) END
            FROM search, w WHERE a < b),
c AS MATERIALIZED (SELECT a AS cap FROM search WHERE a >= b),
back(k, pos) AS (SELECT 0::BIGINT, total FROM w UNION ALL SELECT k + 1, list_min(list_filter(borders, lambda x: x >= greatest(pos - cap, 0))) FROM back, w, c WHERE k < n),
fwd(k, pos) AS (
  SELECT 0::BIGINT, 0::BIGINT
  UNION ALL SELECT k + 1, least(CASE WHEN share - low <= high - share THEN low ELSE high END, list_max(list_filter(borders, lambda x: x <= pos + cap)))
            FROM (SELECT k, pos, cap, borders, total * (k + 1) // n AS share, list_max(list_filter(borders, lambda x: x <= total * (k + 1) // n)) AS low,
                         list_min(list_filter(borders, lambda x: x >= total * (k + 1) // n)) AS high FROM fwd, w, c WHERE k < n)),
cuts AS (SELECT list(greatest(f.pos, q.pos)) AS cuts FROM fwd f, back q, w WHERE q.k = n - f.k AND f.k BETWEEN 1 AND n - 1),
s AS (SELECT hash, (rk - 1)::INTEGER AS shard FROM g, z WHERE rk <= own
      UNION ALL SELECT hash, (own + len(list_filter(cuts, lambda x: x <= upto - size)))::INTEGER FROM p, cuts, z)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, hash) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN s USING (hash)
"""
