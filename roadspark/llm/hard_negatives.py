"""Hard negatives by exact scores from subset-sum tables (the Four-Russians way).

Components are whole numbers, floor(256 x). A candidate is stored as bit planes: for each group of
eight dimensions and each bit of the two's complement, one byte holds that bit of the eight
components. An anchor has a table of 256 sums for each group: the sum of its components over every
subset of the eight. A byte of a plane is such a subset, so a score is

    sum over planes p of +-2**p * (sum over groups of table[group][byte of p and group]),

the sign plane counting negative: table lookups, shifts and additions, and exact.

Anchors meet all candidates in blocks: candidates are dealt to groups of at most
``CANDIDATES`` rows, anchors to groups of at most ``ANCHORS``, and every pair of groups is a task. A
first pass scores rows of the anchor's label and keeps each block's best positives; a second pass,
which knows the positives' scores, scores the others and keeps each block's best rows in each band.
A block gives at most a fixed number of rows for an anchor, so what follows is small however
many rows share a label or a vector.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.llm.common import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a candidate group and of an anchor group, at most (about: they are dealt by hash).
CANDIDATES, ANCHORS = 8192, 256
#: Anchors and candidates scored together inside a task, so that their tables and sums stay in the cache.
ANCHOR_TILE, CANDIDATE_TILE = 64, 2048
#: Positives of an anchor, negatives of a positive, and the band of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Components are multiplied by this; labels, and the ids whose label moves on by one.
SCALE, LABELS, MOVED, EVERY = 256, 10, 7, 50


# ------------------------------------------------------------------ kernels
def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bytes (rows, planes, groups) of whole numbers (rows, dims): bit p of eight neighbouring dims in one byte."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of each anchor's components over all subsets of each group of eight dims."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    padded = np.zeros((n, groups * 8), anchors.dtype)
    padded[:, :dims] = anchors
    sums = np.zeros((groups, 256, n), anchors.dtype)
    for k in range(8):  # a subset with bit k as its highest is a smaller subset and that dim
        sums[:, 1 << k : 2 << k] = sums[:, : 1 << k] + padded[:, k::8].T[:, None, :]
    return sums


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors): exact inner products, from the highest plane down, doubling what is there."""
    n_planes, groups = planes.shape[1], planes.shape[2]
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    for p in range(n_planes - 1, -1, -1):
        if p < n_planes - 1:
            total <<= 1
        for g in range(groups):
            part = tables[g].take(planes[:, p, g], axis=0)
            if p == n_planes - 1:  # the sign
                total -= part
            else:
                total += part
    return total


def best_first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` best: higher score, then smaller id."""
    if len(score) > 4 * n:
        at_least = np.partition(score, len(score) - n)[len(score) - n]
        some = np.flatnonzero(score >= at_least)
        return some[np.lexsort((ids[some], -score[some]))][:n]
    return np.lexsort((ids, -score))[:n]


def _unpack(table: pa.Table, name: str, dtype: type, shape: tuple[int, ...]) -> np.ndarray:
    rows = table.column(name).combine_chunks().cast(pa.large_binary())
    begin, end = (np.frombuffer(rows.buffers()[1], np.int64)[rows.offset + k] for k in (0, len(rows)))
    return np.frombuffer(rows.buffers()[2], np.uint8)[begin:end].view(dtype).reshape(len(rows), *shape)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def tiles(candidates: pa.Table, anchors: pa.Table, dims: int, planes: int, width: type) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of two groups, tile by tile: (candidates, anchors, scores)."""
    packed = _unpack(candidates, "planes", np.uint8, (planes, -(-dims // 8)))
    vectors = _unpack(anchors, "vector", np.int64, (dims,)).astype(width)
    for a in range(0, len(vectors), ANCHOR_TILE):
        tables = subset_sums(vectors[a : a + ANCHOR_TILE])
        for c in range(0, len(packed), CANDIDATE_TILE):
            yield slice(c, min(c + CANDIDATE_TILE, len(packed))), slice(a, min(a + ANCHOR_TILE, len(vectors))), scores(tables, packed[c : c + CANDIDATE_TILE])


# ------------------------------------------------------------------ rows
def whole(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def rows_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector array<double> of whole numbers) of the rows that take part; one row an id."""
    inside = embeddings.select("vec_id", "label", F.col("embedding").alias("v")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    rows = inside.filter(finite).select("vec_id", moved.alias("label"), whole(F.col("v")).alias("vector"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def _packed(rows: DataFrame, dims: int, planes: int, vectors: bool) -> DataFrame:
    """(vec_id, label, planes) or, for anchors, (vec_id, label, vector), as bytes; short vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            lengths = np.diff(column.offsets.to_numpy())
            values = np.zeros((len(column), dims), np.int64)
            values[np.arange(dims)[None, :] < lengths[:, None]] = column.flatten().to_numpy().astype(np.int64)
            made = values if vectors else bit_planes(values, planes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in made], pa.binary())], ["vec_id", "label", "vector" if vectors else "planes"])

    return rows.mapInArrow(run, f"vec_id long, label long, {'vector' if vectors else 'planes'} binary")


def _grid(candidates: DataFrame, anchors: DataFrame, c_groups: int, a_groups: int):
    """Both sides dealt to the pairs of groups, ready to meet."""
    c = candidates.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(c_groups))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a_groups - 1))))
    a = anchors.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.lit(a_groups)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_groups - 1).cast("long"))))
    return c.groupBy("c", "a").cogroup(a.groupBy("c", "a"))


def positives_of(candidates: DataFrame, anchors: DataFrame, grid: tuple[int, int], shape: tuple[int, int, type], n: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the best ``n`` other rows of an anchor's label."""

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, label = _numbers(mine, "vec_id"), _numbers(mine, "label")
        a_ids, a_label = _numbers(theirs, "vec_id"), _numbers(theirs, "label")
        out: list[tuple[np.ndarray, ...]] = []
        for one in np.unique(a_label) if len(ids) else ():  # only rows of the same label are scored
            c_at, a_at = np.flatnonzero(label == one), np.flatnonzero(a_label == one)
            for c, a, block in tiles(mine.take(pa.array(c_at)), theirs.take(pa.array(a_at)), *shape):
                there = ids[c_at[c]]
                for k, anchor in enumerate(a_ids[a_at[a]]):
                    own = np.flatnonzero(there != anchor)
                    best = own[best_first(block[own, k], there[own], n)]
                    out.append((np.full(len(best), anchor), there[best], block[best, k].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(columns, names=["anchor_id", "positive_id", "positive_score"])

    best = _grid(candidates, anchors, *grid).applyInArrow(run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")


def negatives_of(candidates: DataFrame, anchors: DataFrame, grid: tuple[int, int], shape: tuple[int, int, type], low: int = LOW, high: int = HIGH, n: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_score, negative_id, negative_score, rank): the best ``n`` rows of other labels in each band.

    ``anchors`` has bands, the distinct scores of the anchor's positives: low * p <= 100 * score <= high * p.
    """

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, label = _numbers(mine, "vec_id"), _numbers(mine, "label")
        a_ids, a_label, bands = _numbers(theirs, "vec_id"), _numbers(theirs, "label"), theirs.column("bands").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        for c, a, block in tiles(mine, theirs, *shape) if len(ids) else ():
            there, kinds = ids[c], label[c]
            for k in range(a.stop - a.start):
                # whole-number bounds: ceil(low * p / 100) <= score <= floor(high * p / 100)
                bounds = [(p, -(-low * p // 100), high * p // 100) for p in bands[a.start + k]]
                if not bounds:
                    continue
                column = block[:, k]
                some = np.flatnonzero((column >= min(b[1] for b in bounds)) & (column <= max(b[2] for b in bounds)) & (kinds != a_label[a.start + k]))
                if len(some):
                    near, at = column[some].astype(np.int64), there[some]
                    for p, least, most in bounds:
                        fit = np.flatnonzero((near >= least) & (near <= most))
                        best = fit[best_first(near[fit], at[fit], n)]
                        out += [(int(a_ids[a.start + k]), p, int(at[x]), int(near[x])) for x in best]
        names = ["anchor_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], names=names)

    best = _grid(candidates, anchors, *grid).applyInArrow(run, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``embeddings`` has vec_id, embedding and label; other columns are not read. Rows with a null
    id, label or vector, or with a component that is null or not finite, take no part. Of several rows with one
    id, the one with the least label, then vector, stands for all. An inner product of vectors of different
    lengths ends with the shorter one; empty vectors score 0. Equal scores go by id. Scores are 64-bit
    whole numbers; sums beyond that wrap around. An anchor without positives, or a band without rows, gives none,
    and an empty table an empty result.
    """
    rows = materialize(rows_of(embeddings), "vectors")
    facts = rows.agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("asked"), F.max(F.size("vector")).alias("dims"),
        F.min(F.array_min("vector")).alias("least"), F.max(F.array_max("vector")).alias("most"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("square"),
    ).first()
    dims = max(facts.dims or 0, 1)
    planes = min(max(int(max(facts.most or 0, -1 - (facts.least or 0))).bit_length() + 1, 2), 64)
    # a product of two vectors, and every sum on the way to it, stays under the product of their lengths, times 8 * 2 ** planes at most for partial sums
    width = np.int32 if (facts.square or 0) ** 0.5 * dims * 2**planes < 2**31 else np.int64
    shape = dims, planes, width
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = max(-(-facts.n // CANDIDATES), min(parts, -(-facts.n // 256)), 1), max(-(-(facts.asked or 0) // ANCHORS), 1)
    candidates = materialize(_packed(rows, dims, planes, False), "planes")
    anchors = materialize(_packed(rows.filter(F.col("vec_id") % every == 0), dims, planes, True), "anchors")
    positives = materialize(positives_of(candidates, anchors, grid, shape), "positives")
    bands = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("bands"))
    banded = anchors.join(bands, anchors.vec_id == bands.anchor_id).drop("anchor_id")
    negatives = negatives_of(candidates, banded, grid, shape)
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same in DuckDB, with plain products.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""
