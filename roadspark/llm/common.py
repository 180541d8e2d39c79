"""Helpers shared by the training-data operators: word kernels, id ranges.

The word kernels work on a whole Arrow batch at once: a batch's texts are one
UTF-8 byte buffer, so word borders and 64-bit word hashes come from a few NumPy
passes over it, with no Python object per word.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadspark.operators import scratch
from roadspark.operators.scratch import forget as discard  # noqa: F401
from roadspark.operators.scratch import scratch_dir  # noqa: F401
from roadspark.operators.scratch import settle as materialize  # noqa: F401

# Executors need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(scratch)

#: Bytes of text that a kernel handles at once (a single longer text is still one piece).
PIECE_BYTES = 1 << 19

#: Fixed value: the characters between words, as in [^\x20\x09-\x0D]+.
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: The same as a Java regular expression.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- byte kernels
def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts with about ``most`` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Hasher:
    """Position-free 64-bit hashes of byte spans, by prefix sums of byte * base**position.

    All arithmetic wraps at 2**64; the base is odd, so its powers can be undone.
    """

    def __init__(self) -> None:
        self.size = 0
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        n = max(n, 2 * self.size)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
        self.undo = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]))
        self.size = n

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over ``values``, for any number of calls of ``of``."""
        if len(values) > self.size:
            self._grow(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.power[: len(values)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end)."""
        return mix((sums[ends] - sums[starts]) * self.undo[starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A full-avalanche 64-bit finaliser (the public splitmix64 step)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def member_table(members: bytes, invert: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return ~table if invert else table


def word_table() -> np.ndarray:
    """Which bytes belong to words."""
    return member_table(WORD_SPACE, invert=True)


def lower_table() -> np.ndarray:
    """A-Z to a-z; bytes of other characters stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that do not cross a text border: starts, ends, and each text's first run."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    borders = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[borders] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[borders - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def windows(first: np.ndarray, n_words: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all ``width``-word windows inside one text, and each text's first window."""
    counts = np.diff(first)
    n = np.maximum(counts - (width - 1), 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(n, out=at[1:])
    total = int(at[-1])
    starts = np.repeat(first[:-1] - at[:-1], n) + np.arange(total)
    return starts, at


def combine(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of ``width`` consecutive word hashes from each start."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(width):
        out = (out ^ hashes[starts + k]) * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + np.uint64(k + 1)
        out ^= out >> np.uint64(29)
    return mix(out)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the index ranges [first[i], first[i + 1])."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """The text number of every element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hashes made distinct for each text, so that one sort serves a whole piece."""
    return mix(hashes + owners(first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key stands elsewhere too; the key stands earlier."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(n + 1, bool)
    same[1:n] = keys[order[1:]] == keys[order[:-1]]
    shared, again = np.zeros(n, bool), np.zeros(n, bool)
    shared[order] = same[:-1] | same[1:]
    again[order] = same[:-1]
    return shared, again


#: Stands for a null id: such rows come last in id order.
LAST_ID = (1 << 63) - 1


#: Documents in a task that works through ranges of ids, at most (but for repeated ids), and ranges a task.
TASK_DOCS, TASK_RANGES = 10_000, 4


def id_ranges(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """First ids of ranges of like size, each an id of the table, and the number of tasks for them.

    The tasks are those of a shuffle, and more where a task would get over ``TASK_DOCS``
    documents. Aggregates over the id column; ([0], ...) for an empty table.
    """
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, -(-ids.count() // TASK_DOCS))
    shares = [k / (tasks * TASK_RANGES) for k in range(tasks * TASK_RANGES)]
    cuts = ids.agg(F.percentile_approx(column, shares, max(100_000, 20 * len(shares))).alias("q"), F.min(column).alias("least")).first()
    return np.unique(np.array([0] if cuts.least is None else [cuts.least, *cuts.q], np.int64)), tasks


def place_in(begins: np.ndarray):
    """A column function: twice the range number of an id, plus one if the id begins its range."""

    @F.pandas_udf("long")
    def place(sid: pd.Series) -> pd.Series:
        at = np.searchsorted(begins, sid.to_numpy(), "right") - 1
        return pd.Series(2 * at + (begins[at] == sid.to_numpy()))

    return place


Kernel = Callable[[np.ndarray, np.ndarray], Sequence]


def map_texts(docs: DataFrame, keep: Sequence[str], added: str, make: Callable[[], Kernel], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the columns ``added`` (a DDL list) made from its texts.

    ``make()`` runs once a task and returns a kernel; the kernel gets the bytes and offsets
    of some whole texts and returns one array for each added column. Null texts are empty.
    A kept column that has the name of an added one gives way to it.
    """
    new = T.StructType.fromDDL(added)
    keep = [c for c in keep if c not in new.names]
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + new.fields)
    names, n = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            data, offsets = text_bytes(batch.column(n))
            for i, j in pieces(offsets):
                out = kernel(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                arrays = [batch.column(k).slice(i, j - i) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*arrays, *(x if isinstance(x, pa.Array) else pa.array(x) for x in out)], names)
        pa.default_memory_pool().release_unused()  # workers live on and run other tasks

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("_text_")).mapInArrow(run, schema)
