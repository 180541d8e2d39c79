"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points is hashed (rolling, from prefix sums). Of each window of
``WINDOW`` neighbouring hashes the least is chosen, the rightmost one on ties, and kept
with its position. Any two texts that share a passage of GRAM + WINDOW - 1 code points
then share a chosen hash of that passage.

Edge cases: a text with fewer hashes than a window is one window; one shorter than
GRAM is one gram; a null or empty text has an empty fingerprint. Two empty fingerprints
are alike (1), an empty and a full one are not (0).
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM, WINDOW = 16, 32

_LOW = np.uint64(0xFFFFFFFF)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every full window, by doubling; one window if there are fewer keys."""
    width = min(width, len(keys))
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def winnow(points: np.ndarray, hasher: C.Hasher, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 32-bit hashes and their positions, in text order."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    width = min(gram, n)
    at = np.arange(n - width + 1)
    hashes = hasher.of(hasher.prefix(points), at, at + width)
    # hash above, inverted position below: the least key is the least hash, rightmost on ties
    keys = (hashes & ~_LOW) | (_LOW - at.astype(np.uint64))
    least = sliding_least(keys, window)
    chosen = least[np.append(True, least[1:] != least[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (_LOW - (chosen & _LOW)).astype(np.uint32)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    return hashlib.blake2b(hashes.tobytes() + positions.tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sorted distinct hash arrays."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes, positions) of every text; the general interface of this operator."""

    def make() -> C.Kernel:
        hasher = C.Hasher()

        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            chosen = [winnow(code_points(data[s:e].tobytes().decode("utf-8", "replace")), hasher) for s, e in zip(offsets[:-1], offsets[1:])]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(h) for h, _ in chosen])]).astype(np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([c[k] for c in chosen]).astype(np.int64))) for k in (0, 1)]

        return kernel

    return C.map_texts(docs, ["doc_id"], "hashes array<long>, positions array<long>", make)


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (range, role, sid, doc_id, text), sorted, so that each role-0 row stands before its successor.

    The ids are cut into ranges that begin at existing ids. Each document goes to its range,
    and the first one of a range goes to the range before as well, in role 1; the very first
    follows the very last. One shuffle of the texts, and no window over all rows. Null ids
    come last; rows with equal ids follow each other in text order.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.LAST_ID)).alias("sid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    begins, tasks = C.id_ranges(ids, "sid")
    ranges = len(begins)
    place = C.place_in(begins)
    at = F.shiftright("place", 1)
    own = F.struct(at.alias("range"), F.lit(0).alias("role"))
    before = F.struct(F.pmod(at - 1, F.lit(ranges)).alias("range"), F.lit(1).alias("role"))
    to = F.explode(F.when(F.col("place") % 2 == 1, F.array(own, before)).otherwise(F.array(own)))
    rows = ids.withColumn("place", place("sid")).select(to.alias("to"), "sid", "doc_id", "text").select("to.*", "sid", "doc_id", "text")
    return rows.repartition(tasks, "range").sortWithinPartitions("range", "role", "sid", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long"


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and of the text whose last half gives way to the next document's beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = C.Hasher()
        names = [f.split()[0] for f in EDITED.split(", ")]
        held = None
        for batch in batches:
            out = []
            for group, role, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "role", "doc_id", "text"))):
                points = code_points(text or "")
                hashes, positions = winnow(points, hasher)
                row = (group, role, doc_id, points, digest(hashes, positions), np.unique(hashes))
                if held is not None and held[1] == 0:
                    mine = held[3]
                    half = len(mine) // 2
                    edited = np.concatenate([mine[: len(mine) - half], points[:half]])
                    text_of = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                    h, p = winnow(edited, hasher)
                    out.append((held[2], len(mine), hashlib.sha256(text_of).hexdigest(), held[4], digest(h, p), likeness(held[5], np.unique(h)), likeness(held[5], row[5]), len(held[5])))
                held = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], names)

    return with_successors(docs).select("range", "role", "doc_id", "text").mapInArrow(run, EDITED)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(C.documents(spark, sf_dir))
