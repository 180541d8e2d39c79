"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm.common import is_held_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all labelled rows outside the held-out fifth; of several labels for one id the larger counts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def training_ids(labels: DataFrame, label: str, most: int, value: int | None = None) -> DataFrame:
    """At most ``most`` rows (doc_id, y) outside the held-out fifth, those of smallest hash.

    Rows without an id or a label are not used; of several labels for one id the larger counts.
    """
    known = known_labels(labels, label)
    if value is not None:
        known = known.filter(F.col("y") == value)
    return known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)


def one_text_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the documents in ``chosen`` (doc_id, y); of several texts under one id the least, nulls first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min(F.struct("text")).alias("t")).select("doc_id", "y", "t.text")


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (values, first index of each row)."""
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], rows.type)
    sizes = np.asarray(rows.value_lengths().fill_null(0)) if len(rows) else np.zeros(0, np.int64)
    return np.asarray(rows.flatten()), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimises by full-gradient Adam steps; ``gradient(w)`` returns the gradient at w."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
