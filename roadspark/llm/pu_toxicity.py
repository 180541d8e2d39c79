"""Toxicity by non-negative positive-unlabelled learning.

The learner sees texts confirmed as toxic and texts without any label. Its risk is the
class-prior-corrected estimate

    prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)])

with the logistic loss of a linear model over hashed lower-case words and word stems
(present or not).
Where the second term turns negative, its gradient is reversed, which keeps the model
from explaining the unlabelled toxic texts away. Labels of clean documents are used for
the class prior alone.

The fit runs in numpy on a bounded sample (``MOST_POSITIVE``, ``MOST_UNLABELLED`` rows).
The bias then comes from histograms of the scores of all confirmed and all unlabelled
texts outside the held-out fifth. Every document is scored with the fixed-size weight
table broadcast.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common as C
from roadspark.llm.sampling import adam, known_labels, one_text_each, ragged, training_ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 18
#: Bytes of a word that make its stem.
STEM = 4
#: Rows used for the fit, at most.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
#: Words kept for the model: those whose rates in the two samples differ most, by at least
#: LEAST_STRENGTH standard errors, seen in so many positives.
FEATURES, LEAST_SEEN, LEAST_STRENGTH = 1000, 3, 4.0
#: Scores are grouped in steps of 1 / BINS, from -MOST_BINS / BINS to MOST_BINS / BINS; what lies beyond is in the outer groups.
BINS, MOST_BINS = 1024, 1024 * 50

_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or b == 39)


class Letters:
    """Hashed lower-case words: runs of letters, digits, apostrophes and bytes beyond ASCII."""

    def __init__(self) -> None:
        self.hasher, self.inside, self.lower = C.Hasher(), C.member_table(_LETTERS), C.lower_table()

    def buckets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of every word and its stem (its first bytes), and each text's first one."""
        starts, ends, first = C.spans(self.inside[data], offsets)
        sums = self.hasher.prefix(self.lower[data])
        whole = self.hasher.of(sums, starts, ends)
        stem = C.mix(self.hasher.of(sums, starts, np.minimum(starts + STEM, ends)) + np.uint64(STEM))
        hashes = np.stack([whole, stem], axis=1).ravel()  # word, stem, word, stem, ...
        return (hashes % np.uint64(BUCKETS)).astype(np.int64), 2 * first

    def scores(self, data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Summed weights of what is present in each text."""
        at, first = self.buckets(data, offsets)
        some = weights[at] != 0
        at, row = present(at[some], C.owners(first)[some])
        return np.bincount(row, weights[at], minlength=len(offsets) - 1).astype(np.float64)  # of nothing it makes integers


def present(at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once for each text."""
    key = np.unique(row * BUCKETS + at)
    return key % BUCKETS, key // BUCKETS


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, y, buckets) of the sampled documents."""

    def make() -> C.Kernel:
        letters = Letters()

        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            at, first = letters.buckets(data, offsets)
            at, row = present(at, C.owners(first))
            begins = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(begins), pa.array(at.astype(np.int32)))]

        return kernel

    return C.map_texts(docs, ["doc_id", "y"], "buckets array<int>", make)


def _count(at: np.ndarray, use: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Rows in each bucket, in slices, as counting makes a wide copy of what it counts."""
    n = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(at), step):
        n += np.bincount(at[i : i + step][use[i : i + step]], minlength=BUCKETS)
    return n


def fit_pu(at: np.ndarray, first: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the bias, from rows given as bucket lists.

    Without positives or without unlabelled rows there is nothing to learn: all weights
    are 0 and the bias is the log-odds of the prior.
    """
    prior = min(max(prior, 1e-3), 0.5)
    n_pos, n_other = int(positive.sum()), int((~positive).sum())
    if not n_pos or not n_other:
        return np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    sizes = np.diff(first)
    of_pos = np.repeat(positive, sizes)
    in_pos, in_other = _count(at, of_pos), _count(at, ~of_pos)
    del of_pos
    p, u = in_pos / n_pos, in_other / n_other
    spread = np.sqrt((in_pos + in_other + 1.0) / (n_pos + n_other)) / np.sqrt(min(n_pos, n_other))
    strength = np.where(in_pos >= LEAST_SEEN, np.abs(p - u) / spread, 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    chosen = chosen[strength[chosen] >= LEAST_STRENGTH]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    use = strength[at] >= LEAST_STRENGTH  # a superset; most words of the sample go here
    at, row = at[use], np.repeat(np.arange(len(positive), dtype=np.int32), sizes)[use]
    use = place[at] >= 0
    col, row, n, k = place[at[use]], row[use], len(positive), len(chosen)
    weight_pos, weight_other = positive / n_pos, ~positive / n_other

    def gradient(w: np.ndarray) -> np.ndarray:
        z = np.bincount(row, w[col], minlength=n) + w[k]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # slope of loss(-); loss(+) has s - 1
        loss_minus = np.logaddexp(0, z)
        negative_part = (weight_other * loss_minus).sum() - prior * (weight_pos * loss_minus).sum()
        g_negative = weight_other * s - prior * weight_pos * s
        g = prior * weight_pos * (s - 1) + g_negative if negative_part >= 0 else -g_negative
        return np.append(np.bincount(col, g[row], minlength=k), g.sum()) + decay * np.append(w[:k], 0)

    w = adam(gradient, np.append(np.zeros(k), np.log(prior / (1 - prior))), steps, rate)
    out = np.zeros(BUCKETS)
    out[chosen] = w[:k]
    z = np.bincount(row, w[col], minlength=n)
    return out, -least_risk(z[positive], z[~positive], prior)


def least_risk(pos: np.ndarray, other: np.ndarray, prior: float) -> float:
    """The threshold with the least non-negative estimate of the 0/1 risk; of equal ones the widest gap's middle."""
    values, place = np.unique(np.concatenate([pos, other]), return_inverse=True)
    counts = [np.bincount(part, minlength=len(values)) for part in (place[: len(pos)], place[len(pos) :])]
    return least_risk_of_counts(values, values, *counts, prior)


def least_risk_of_counts(low: np.ndarray, high: np.ndarray, pos: np.ndarray, other: np.ndarray, prior: float) -> float:
    """The same for rising groups of scores, each from ``low`` to ``high`` with so many rows of both kinds."""
    at = np.append((low[1:] + high[:-1]) / 2, high[-1] + 1)
    gap = np.append(low[1:] - high[:-1], 0)
    missed = np.cumsum(pos) / pos.sum()
    flagged = 1 - np.cumsum(other) / other.sum()
    risk = prior * missed + np.maximum(0, flagged - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(at[best[np.argmax(gap[best])]])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fits on confirmed toxic rows and on unlabelled texts outside the held-out fifth.

    Rows without an id are not used, nor are null labels. Of several labels for one id the larger
    counts, and of several texts under one id the least is learnt from, so the sample keeps its
    bounds. A document may be in both samples: unlabelled means any document.
    """
    counts = labels.filter(F.col("toxic").isNotNull() & ~C.is_held_out()).agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    toxic = training_ids(labels, "toxic", MOST_POSITIVE, 1)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~C.is_held_out()).distinct()
    # unlabelled: any documents, whatever is known of them
    other = ids.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(MOST_UNLABELLED).select("doc_id", F.lit(0).alias("y"))
    # both lists are bounded by the parameters above
    chosen = F.broadcast(toxic.select("doc_id", "y").union(other))
    table = features(one_text_each(docs, chosen)).toArrow()
    at, first = ragged(table.column("buckets"))
    prior, positive = (counts.k or 0) / max(counts.n, 1), np.asarray(table.column("y")) == 1
    del table
    weights, bias = fit_pu(at, first, positive, prior)
    del at
    if positive.all() or not positive.any():
        return weights, bias
    return weights, whole_bias(docs, labels, weights, min(max(prior, 1e-3), 0.5))


def whole_bias(docs: DataFrame, labels: DataFrame, weights: np.ndarray, prior: float) -> float:
    """The bias of least risk over every text outside the held-out fifth, with confirmed ones among them."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~C.is_held_out())
    toxic = known_labels(labels, "toxic").filter("y = 1")
    # at most 2 * MOST_BINS + 1 groups, whatever the number of rows; the ends of each are exact
    group = F.greatest(F.lit(-MOST_BINS), F.least(F.lit(MOST_BINS), F.floor(F.col("z") * BINS))).alias("group")
    scores = raw_scores(mine, weights).join(toxic, "doc_id", "left").groupBy(group)
    table = scores.agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("y").alias("pos"), F.count("*").alias("other")).sort("group").toArrow()
    return -least_risk_of_counts(*(np.asarray(table.column(k)) for k in ("low", "high", "pos", "other")), prior)


def raw_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, z): the score of every row of ``docs`` without a bias."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make() -> C.Kernel:
        letters, w = Letters(), shared.value
        return lambda data, offsets: [letters.scores(data, offsets, w)]

    return C.map_texts(docs, ["doc_id"], "z double", make)


def score_texts(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Columns ``keep`` (default doc_id) and a score ``out`` in 0..1 for every row of ``docs``.

    Null and empty texts have no words and score as the bias alone; equal texts score equally.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def make() -> C.Kernel:
        letters, (w, b) = Letters(), shared.value

        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
            z = letters.scores(data, offsets, w) + b
            return [1 / (1 + np.exp(-np.clip(z, -30, 30)))]

        return kernel

    return C.map_texts(docs, ["doc_id"] if keep is None else keep, f"{out} double", make)


def op5_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    scored = score_texts(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", C.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
