"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a hash in [0, 1). A source that should give a share f of its
tokens gives the documents whose hash lies under a threshold, chosen so that
their tokens come closest to the budget. The threshold is found without sorting:

1. tokens are summed by source and hash bucket (``2**BITS`` buckets);
2. a running sum over the buckets of a source finds the one where the budget is
   crossed; buckets before it are in, buckets after it are out;
3. only the documents of that boundary bucket are split by the next ``BITS`` bits of
   their hash, and so on for ``LEVELS`` nested levels, and last by all bits that are left.
   A single document that is left there is taken if that brings the sum nearer to the budget;
   of documents that are equal in id and text, and so in hash, as many are taken as come nearest.

The histograms have at most ``2**BITS`` rows a source however many documents there
are, so one hot source needs no special care: its documents meet in partial sums.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspark.llm.common import discard, documents, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hash bits of one level, nested levels, and the largest number of copies of a document.
BITS, LEVELS, MOST_EPOCHS = 12, 3, 3
#: Weights of the sources in code-point order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of one file that are numbered together.
BLOCK = 1 << 16


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ words; 0 for null. Counts single spaces between words, so no word is copied out."""
    spaced = text
    for ch in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(ch), F.lit(" "))

    def count(one: Column) -> Column:
        single = F.when(F.contains(one, F.lit("  ")), F.regexp_replace(one, " {2,}", " ")).otherwise(one)
        gaps = F.transform(F.array(single), lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))))[0]
        return F.when(one == "", 0).otherwise(gaps + 1)

    return F.coalesce(F.transform(F.array(F.trim(spaced)), count)[0], F.lit(0)).cast("long")


def unit_hash(doc_id: Column, text: Column) -> Column:
    """A 60-bit hash of the id and the text; equal in every engine that has md5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets of the sources from (source, source_size): shares of the total by weight, capped.

    A target stops at ``epochs`` times its source's size, and what it leaves is shared out
    again by weight until none is above. Sources that hit the cap are those with the
    smallest cap per weight, so one pass in that order finds them all: source i is capped
    when the share that is left for it and the ones behind it would exceed its cap.
    Works on one row a source.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    names = sizes.withColumn("_rank", F.row_number().over(everything))
    picks = F.array(*[F.lit(float(w)) for w in weights])
    w = names.withColumn("_w", F.element_at(picks, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", (F.col("source_size") * epochs).cast("long"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    behind, upto = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(upto), F.lit(0))) / F.sum("_w").over(behind)
    levels = w.withColumn("_level", level).withColumn("_capped", F.col("_level") * F.col("_w") > F.col("_cap"))
    free = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(Window.partitionBy())
    return levels.withColumn("_at", free["_level"]).select(
        "source", "source_size", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_at") * F.col("_w")).alias("target")
    )


def thresholds(docs: DataFrame, targets: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """(source, whole, cut, part): complete copies of a source, the hash under which one more copy is taken, and how many rows of just that hash get one.

    ``docs`` has source, size and hash (60 bits); ``targets`` has source, source_size, target.
    ``part`` is above 0 only where several rows share the hash and some, but not all, are taken.
    """
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    state = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.select("source", "whole", budget.alias("left"), F.lit(0).cast("long").alias("prefix"))
    shifts = [60 - bits * (level + 1) for level in range(levels)] + [0]
    for level, shift in enumerate(shifts):
        inside = docs.select("source", "size", F.shiftright("hash", shift).alias("cell"), F.shiftright("hash", ([60] + shifts)[level]).alias("prefix"))
        if level:
            inside = inside.withColumnRenamed("source", "s").withColumnRenamed("prefix", "p")
            near = state.select("source", "prefix")
            inside = inside.join(near, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("prefix"))).select("source", "size", "cell")
        histogram = inside.groupBy("source", "cell").agg(F.sum("size").alias("tokens"), F.count("*").alias("rows"))
        run = Window.partitionBy("source").orderBy("cell")
        histogram = histogram.withColumn("upto", F.sum("tokens").over(run)).withColumnRenamed("source", "s")
        joined = histogram.join(state.drop("prefix"), F.col("s").eqNullSafe(F.col("source")))
        # the first cell whose running sum passes what is left; all before it are in
        over = joined.filter(F.col("upto") > F.col("left")).groupBy("source", "whole").agg(
            F.min(F.struct("cell", "upto", "tokens", "rows", "left")).alias("at")
        )
        rest = F.col("at.left") - (F.col("at.upto") - F.col("at.tokens"))
        state = over.select("source", "whole", F.col("at.cell").alias("prefix"), rest.alias("left"), *([] if shift else ["at.tokens", "at.rows"]))
    # the cell is one hash by now: rows of one size
    taken = F.ceil(F.col("left") / (F.col("tokens") / F.col("rows")) - 0.5)
    return state.withColumn("taken", taken.cast("long")).select(
        "source", "whole", (F.col("prefix") + F.when(F.col("taken") >= F.col("rows"), 1).otherwise(0)).alias("cut"),
        F.when(F.col("taken") >= F.col("rows"), 0).otherwise(F.greatest(F.col("taken"), F.lit(0))).cast("long").alias("part"),
    )


def source_cuts(small: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, cut, part) from (source, size, hash); one row a source."""
    sizes = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, epochs), "mix-targets")
    cuts = thresholds(small, targets).withColumnRenamed("source", "s").withColumnRenamed("whole", "w")
    joined = targets.join(cuts, F.col("s").eqNullSafe(F.col("source")), "left")
    # no boundary cell: the whole copies meet the target, and nothing is left to take
    whole = F.coalesce("w", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).cast("long")
    return materialize(joined.select("source", "source_size", "target", whole.alias("whole"), F.coalesce("cut", F.lit(0)).cast("long").alias("cut"), F.coalesce("part", F.lit(0)).cast("long").alias("part")), "mix-cuts")


def with_copies(joined: DataFrame, cuts: DataFrame, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``joined`` (hash and the columns of ``cuts``) with copies, how often each row is taken.

    Where a source's boundary is a hash that many rows share, those rows are written out and
    numbered by their places in the files: rows before them by counts of blocks, then inside a
    block of at most ``BLOCK`` rows. However many they are, no task gets more than a block.
    """
    more = F.col("hash") < F.col("cut")

    def taken(extra: Column) -> Column:
        return F.least(F.col("whole") + F.when(extra, 1).otherwise(0), F.lit(epochs)).cast("long").alias("copies")

    if cuts.filter("part > 0").isEmpty():
        return joined.select("*", taken(more))
    tied = (F.col("part") > 0) & (F.col("hash") == F.col("cut"))
    ties = materialize(joined.filter(tied), "mix-ties")
    placed = ties.select("*", F.struct(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / BLOCK)).alias("_block"), F.col("_metadata.row_index").alias("_row"))
    blocks = placed.groupBy("s", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("s").orderBy("_block")) - F.col("_n")
    blocks = blocks.select(F.col("s").alias("_s"), F.col("_block").alias("_b"), before.alias("_before"))
    numbered = placed.join(blocks, F.col("s").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    rank = F.row_number().over(Window.partitionBy("s", "_block").orderBy("_row"))
    numbered = numbered.withColumn("_rank", F.col("_before") + rank)
    return joined.filter(~tied).select("*", taken(more)).unionByName(numbered.select(*joined.columns, taken(F.col("_rank") <= F.col("part"))))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(doc, size, source_size, target, copies) for every row of ``docs`` (doc_id, text, source needed); doc holds the row.

    Null texts have size 0; null is a source of its own, last in order; documents of size 0
    follow their hash like all others and change no sum. The hash is of id and text: rows
    with null or equal ids part by their texts, and of rows that are equal in both as many are taken
    as the target asks for. A source without words has target 0 and contributes no copies. An empty
    table gives an empty result. Columns of any name pass through inside doc.
    """
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in docs.columns]).alias("doc"))
    doc = F.col("doc")
    hashed = unit_hash(doc["doc_id"], doc["text"]).alias("hash")
    small = materialize(rows.select(doc["source"].alias("source"), word_count(doc["text"]).alias("size"), hashed), "mix-sizes")
    cuts = source_cuts(small, weights, epochs).withColumnRenamed("source", "s")
    discard(small)
    joined = rows.select("doc", word_count(doc["text"]).alias("size"), hashed).join(cuts, F.col("s").eqNullSafe(doc["source"]))
    return with_copies(joined, cuts, epochs).select("doc", "size", "source_size", "target", "copies")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    small = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), unit_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    small = materialize(small, "mix-sizes")
    cuts = source_cuts(small).withColumnRenamed("source", "s")
    joined = small.join(cuts, F.col("s").eqNullSafe(F.col("source")))
    return with_copies(joined, cuts).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same in DuckDB: here the threshold comes from sorting the hashes of each source.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT) AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w,
             row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) AS r, source_size * 3 AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN level * w > cap THEN cap::DOUBLE
             ELSE (SELECT arg_min(x.level, (x.cap / x.w, x.r)) FROM v x WHERE NOT x.level * x.w > x.cap) * w END AS target FROM v),
c AS (SELECT source, hash AS cell, sum(size)::BIGINT AS tokens, count(*) AS n FROM d GROUP BY ALL),
b AS (SELECT c.source, cell, tokens, n, sum(tokens) OVER (PARTITION BY c.source ORDER BY cell) AS upto,
             CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE target END AS lef
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, min(cell) AS cell, arg_min(tokens, cell) AS tokens, arg_min(n, cell) AS n, arg_min(lef - (upto - tokens), cell) AS rest FROM b WHERE upto > lef GROUP BY source),
x AS (SELECT t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
             coalesce(k.cell, 0) AS cut, coalesce(CAST(ceil(k.rest / (k.tokens / k.n) - 0.5e0) AS BIGINT), 0) AS part
      FROM t LEFT JOIN k ON t.source IS NOT DISTINCT FROM k.source)
SELECT d.doc_id, d.size, x.source_size, x.target,
       (d.size * least(x.whole + CASE WHEN d.hash < x.cut OR d.hash = x.cut AND d.nr <= x.part THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, hash) AS nr FROM d) d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
