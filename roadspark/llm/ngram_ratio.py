"""Quality rules: base limits, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into ``BUCKETS`` buckets. Two multinomials over
the buckets are counted: one from every document of the corpus, one from the trusted
documents. A document's score is the mean, over its n-grams, of
log p_trusted(bucket) - log p_corpus(bucket); it is kept at ``THRESHOLD`` or above.
The trusted counts are smoothed with the corpus distribution, so a bucket that the
trusted texts say little about scores near 0.

Counts are summed inside each task before they are shuffled, at most one row a bucket
and task, and the finished table of ``BUCKETS`` numbers is the only thing broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common as C
from roadspark.llm.wordstats import Words, WordStats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16
#: Mean log ratio under which a document goes.
THRESHOLD = -0.25
#: Least words, and the largest share of repeat words in percent.
LEAST_WORDS, MOST_REPEAT = 50, 50

SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double"


def gram_buckets(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of a piece, and the text number of each."""
    pair, at = C.windows(words.first, len(words.hashes), 2)
    grams = np.concatenate([words.hashes, C.combine(words.hashes, pair, 2)])
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([C.owners(words.first), C.owners(at)])


def count_grams(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all of ``texts`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, n = WordStats(), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = C.text_bytes(batch.column("text"))
            for i, j in C.pieces(offsets):
                n += np.bincount(gram_buckets(stats.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), buckets)[0], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(corpus: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The table of log ratios; its size is fixed by ``buckets``."""
    p, t = np.ones(buckets), np.zeros(buckets)
    for table, counts in ((p, corpus), (t, trusted)):
        for row in counts.toLocalIterator():
            table[row.bucket] += row.n
    p /= p.sum()
    return np.log((t + buckets * p) / ((t.sum() + buckets) * p))


def score_documents(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Base counts, log ratio and verdict for every row of ``docs`` (doc_id, text), beside the columns ``keep``.

    A null text counts as empty; a text without words fails the base limits and has
    log ratio 0. A ratio equal to the threshold is kept. Equal texts get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make() -> C.Kernel:
        stats, weights = WordStats(), shared.value

        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
            words, n = stats.counts(data, offsets)
            at, row = gram_buckets(words, len(weights))
            rows = len(offsets) - 1
            ratio = np.bincount(row, weights[at], minlength=rows) / np.maximum(np.bincount(row, minlength=rows), 1)
            failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEAT * n["n_words"])
            return [*n.values(), failed, ~failed & (ratio >= threshold), ratio]

        return kernel

    return C.map_texts(docs, ["doc_id"] if keep is None else keep, SCORED, make)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text) of all labelled good documents outside the held-out fifth.

    The ids are too many to broadcast, so this is a merge join at every size; on large
    inputs Spark filters the documents by the ids' Bloom filter before it shuffles them.
    """
    good = labels.filter((F.col("quality") == 1) & ~C.is_held_out()).select("doc_id").distinct()
    return docs.select("doc_id", "text").join(good.hint("merge"), "doc_id").select("text")


def op3_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, log_ratios(count_grams(docs), count_grams(trusted_texts(docs, labels))))
