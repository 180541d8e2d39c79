"""Quality scores from preference pairs: a Bradley-Terry model.

Each pair says that one document (labelled good) is better than another (labelled bad).
The chance that i beats j is 1 / (1 + exp(s_j - s_i)) with s = w . x, so the logistic loss
acts on the difference of the two feature vectors. The features are shares of word shapes
(runs of character classes, e.g. capital-lower-comma), of neighbouring shape pairs, and
shares of repeated words, lines and windows: what a text looks like, not what it says.

Documents are then cut at a quantile of the scores: the share of bad documents among the
labelled ones. The result is put on a 0..1 scale with that quantile at ``CUT``.

The fit runs in numpy on at most ``MOST_ROWS`` labelled documents. The bad share, the
quantile and the scale come from the scores of all labelled documents outside the
held-out fifth. Every document is scored with the small weight vector broadcast.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common as C
from roadspark.llm.sampling import adam, known_labels, one_text_each, training_ids
from roadspark.llm.wordstats import WordStats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHAPES = 1024
EXTRA = 7
WIDTH = SHAPES + EXTRA
#: Labelled rows used for the fit, at most, and pairs drawn from them.
MOST_ROWS, PAIRS = 8000, 60000
#: The score at the quantile threshold.
CUT = 0.3
#: Quantiles are right to one rank in so many; exact up to as many rows.
ACCURACY = 100_000


def shape_classes() -> np.ndarray:
    """Byte classes: 1 capitals, 2 other letters and all bytes beyond ASCII, 3 digits, each other byte itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = 1
    table[97:123] = 2
    table[128:] = 2
    table[48:58] = 3
    return table


class Looks:
    """Feature rows of the texts of a piece, as (column, row, value) triples summed per text."""

    def __init__(self) -> None:
        self.stats, self.classes = WordStats(), shape_classes()

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        words, n = self.stats.counts(data, offsets)
        kinds = self.classes[data]
        # one step for each run of a class inside a word
        step = np.ones(len(kinds), bool)
        step[1:] = kinds[1:] != kinds[:-1]
        step[words.starts] = True
        before = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(step, out=before[1:])
        shapes = self.stats.hasher.of(self.stats.hasher.prefix(kinds[step]), before[words.starts], before[words.ends])
        pair, at = C.windows(words.first, len(shapes), 2)
        column = np.concatenate([shapes, C.combine(shapes, pair, 2)]) % np.uint64(SHAPES)
        row = np.concatenate([C.owners(words.first), C.owners(at)])
        total = np.maximum(n["n_words"], 1)
        x = np.zeros((rows, WIDTH), np.float32)
        x[:, :SHAPES] = np.sqrt(np.bincount(row * SHAPES + column.astype(np.int64), minlength=rows * SHAPES).reshape(rows, SHAPES) / total[:, None])
        again = C.repeats(C.within(words.hashes, words.first))[1]
        same = words.hashes[pair] == words.hashes[pair + 1]
        lines = np.add.reduceat(np.append(data == 10, 0).astype(np.int64), np.minimum(offsets[:-1], len(data))) * (np.diff(offsets) > 0) + 1
        x[:, SHAPES:] = np.stack(
            [
                n["n_repeat_words"] / total,
                C.per_text(same, at) / total,
                n["n_dup_lines"] / lines,
                np.minimum(n["n_symbols"] / total, 1),
                C.per_text(again, words.first) / total / np.log(total + 2),
                np.minimum(n["word_chars"] / total / 10, 3),
                (n["n_words"] == 0).astype(float),
            ],
            axis=1,
        )
        return x

    def scores(self, data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """w . x of each text."""
        out = []
        for i in range(0, len(offsets) - 1, 256):
            o = offsets[i : i + 257]
            out.append(self.rows(data[o[0] : o[-1]], o - o[0]) @ weights)
        return np.concatenate(out).astype(np.float64)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, y, columns, x) of the sampled documents: the features that are not 0, and their values."""

    def make() -> C.Kernel:
        looks = Looks()

        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            ends, columns, values = [np.zeros(1, np.int64)], [], []
            for i in range(0, len(offsets) - 1, 256):
                o = offsets[i : i + 257]
                x = looks.rows(data[o[0] : o[-1]], o - o[0])
                row, column = np.nonzero(x)
                ends.append(ends[-1][-1] + np.searchsorted(row, np.arange(1, len(x) + 1)))
                columns.append(column.astype(np.int16))
                values.append(x[row, column])
            at = pa.array(np.concatenate(ends).astype(np.int32))
            return [pa.ListArray.from_arrays(at, pa.array(np.concatenate(v))) for v in (columns, values)]

        return kernel

    return C.map_texts(docs, ["doc_id", "y"], "columns array<short>, x array<float>", make)


def matrix(table: pa.Table) -> np.ndarray:
    """Feature rows of a collected ``features`` table, filled batch by batch."""
    x, at = np.zeros((table.num_rows, WIDTH), np.float32), 0
    for batch in table.to_batches():
        columns, values = batch.column("columns"), batch.column("x")
        row = np.repeat(np.arange(at, at + batch.num_rows), columns.value_lengths())
        x[row, np.asarray(columns.flatten())] = np.asarray(values.flatten())
        at += batch.num_rows
    return x


def fit_pairs(x: np.ndarray, good: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Bradley-Terry weights from pairs of a good and a bad row; zeros if one kind is missing."""
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    i, j = rng.choice(better, PAIRS), rng.choice(worse, PAIRS)

    def gradient(w: np.ndarray) -> np.ndarray:
        s = x @ w.astype(np.float32)
        lost = 1 / (1 + np.exp(np.clip(s[i] - s[j], -30, 30)))  # chance given to the wrong order
        push = np.bincount(j, lost, minlength=len(x)) - np.bincount(i, lost, minlength=len(x))
        return (push.astype(np.float32) @ x) / PAIRS + decay * w

    return adam(gradient, np.zeros(x.shape[1]), steps, rate)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """(weights, threshold, scale); the fit is on a sample, the threshold is the quantile of the bad share of all labelled rows.

    Rows without an id, or without a label, teach nothing. Of several labels for one id the
    larger counts; of several texts under one id the least is learnt from, so the sample never
    holds more than ``MOST_ROWS`` rows. Without both kinds of labels all weights are 0.
    """
    chosen = F.broadcast(training_ids(labels, "quality", MOST_ROWS))  # bounded by MOST_ROWS
    table = features(one_text_each(docs, chosen)).sort("doc_id").toArrow()
    if not table.num_rows:
        return np.zeros(WIDTH), 0.0, 1.0
    x, good = matrix(table), np.asarray(table.column("y")) == 1
    del table
    w = fit_pairs(x, good)
    del x
    if good.all() or not good.any():
        return w, -1.0, 1.0  # all weights are 0
    return w, *threshold(docs, labels, w)


def threshold(docs: DataFrame, labels: DataFrame, weights: np.ndarray) -> tuple[float, float]:
    """(threshold, scale) over every labelled row outside the held-out fifth, with both kinds among them."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~C.is_held_out())
    scored = C.materialize(raw_scores(mine, weights).join(known_labels(labels, "quality"), "doc_id").select("y", "s"), "labelled-scores")
    good = F.col("y") == 1
    middle = lambda kind: F.percentile_approx(F.when(kind, F.col("s")), 0.5, ACCURACY)
    got = scored.agg(F.count("*").alias("n"), F.count_if(~good).alias("bad"), middle(good).alias("good_s"), middle(~good).alias("bad_s")).first()
    # the middle between the last score of the bad share and the next one
    ends = scored.agg(F.percentile_approx("s", [(got.bad - 0.5) / got.n, (got.bad + 0.5) / got.n], ACCURACY).alias("q")).first().q
    C.discard(scored)
    return sum(ends) / 2, 4 / max(got.good_s - got.bad_s, 1e-6)


def raw_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, s): w . x of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make() -> C.Kernel:
        looks, w = Looks(), shared.value
        return lambda data, offsets: [looks.scores(data, offsets, w)]

    return C.map_texts(docs, ["doc_id"], "s double", make)


def score_texts(docs: DataFrame, weights: np.ndarray, cut: float, scale: float, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Columns ``keep`` (default doc_id) and a score ``out`` in 0..1 for every row of ``docs``.

    Null and empty texts share one feature vector and so one score; equal texts score equally.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), cut, scale, float(np.log(CUT / (1 - CUT)))))

    def make() -> C.Kernel:
        looks, (w, at, k, shift) = Looks(), shared.value

        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
            z = (looks.scores(data, offsets, w) - at) * k + shift
            return [1 / (1 + np.exp(-np.clip(z, -30, 30)))]

        return kernel

    return C.map_texts(docs, ["doc_id"] if keep is None else keep, f"{out} double", make)


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    scored = score_texts(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", C.is_held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
