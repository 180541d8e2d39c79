"""Corpus stages: each one takes all documents that its predecessor kept.

All but the last return the columns of the documents they get.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import mixing, near_dedup, packing, pairwise_quality, pu_toxicity
from roadspark.llm.common import materialize
from roadspark.operators.scratch import release

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: The score beside the columns of the documents, whatever those are called.
SCORE = "_stage_score_"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under the quantile threshold.

    Every row is judged by its text alone: null and empty texts share one score, repeated rows
    go or stay together, null ids make no difference. An empty table stays empty.
    """
    scored = pairwise_quality.score_texts(docs, *pairwise_quality.train(docs, _labels(spark, sf_dir)), keep=docs.columns, out=SCORE)
    release(spark)
    return scored.filter(F.col(SCORE) >= pairwise_quality.CUT).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic.

    Every row is judged by its text alone, as in ``quality``; null and empty texts score as the bias.
    """
    scored = pu_toxicity.score_texts(docs, *pu_toxicity.train(docs, _labels(spark, sf_dir)), keep=docs.columns, out=SCORE)
    release(spark)
    return scored.filter(F.col(SCORE) < 0.5).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that of the least doc_id, once.

    Documents without an id cannot be linked and all stay; those without words are linked with
    nothing. Of several rows with one id, the one with the least text stays (of equal texts, the one with the least hash of its columns).
    """
    keep = materialize(near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    release(spark)
    known = docs.filter(F.col("doc_id").isNotNull())
    stay = known.join(keep.hint("merge"), known.doc_id == F.col("_kept"), "left_semi")
    row, first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    stay = stay.groupBy("doc_id").agg(F.min_by(row, first).alias("_row")).select("_row.*")
    return stay.unionByName(docs.filter(F.col("doc_id").isNull()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for.

    Null is a source of its own. Documents without words are taken or left by their hash like
    all others; of rows equal in id and text as many go as the target asks for. Columns of any name pass through.
    """
    mixed = mixing.mix_sources(docs).filter("copies > 0")
    return mixed.select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Packs the token ids of all documents, with their end ids, into sequences.

    Every row is packed as often as it stands; a null or empty text is its end id alone, and null ids pass through.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(materialize(packing.token_sizes(docs, tokenizer_path), "sizes"))
