"""Best-fit packing of documents into sequences of several permitted lengths.

Sizes are token ids (with the end id of each document). Documents longer than the largest
length are cut into pieces of that length and a rest. The pieces are dealt by hash to
shards of about ``SHARD`` pieces; each shard is packed by itself, longest piece first:

* a piece goes to the open bin that it leaves the least space in (best fit);
* if none has room, a bin is opened. Its length is chosen among all permitted ones by what a
  token in it will cost: each length is filled, on trial, with the largest pieces still to
  come that fit, is downsized to what it then holds, and the cheapest a token wins (the longest on ties);
* at the end each bin is downsized to the smallest permitted length that holds its contents.

A sequence of n tokens costs OVERHEAD + n + n * n / EVEN: attention grows with the square,
and is as dear as all the rest at EVEN tokens. So long bins are opened where only they can
be filled well, and shorter ones wherever they waste nothing.

A shard loses at most a part of its last bins, so the fill does not depend on the number
of shards, and no task sees more than one shard.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import common as C
from roadspark.llm.tokens import CachedTokenizer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTHS = (256, 512, 1024, 2048)
#: Cost of a sequence besides its tokens; length at which attention costs as much as the rest; pieces in a shard.
OVERHEAD, EVEN, SHARD = 32, 8192, 50_000

PACKED = "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, capacity long"


def cost(n: int) -> float:
    return OVERHEAD + n + n * n / EVEN


class Remaining:
    """Lengths of the pieces still to come, with the largest one up to a limit found at once."""

    def __init__(self, lengths: np.ndarray, most: int) -> None:
        self.count = np.bincount(lengths, minlength=most + 1).tolist()
        self.some = sum(1 << n for n in range(1, most + 1) if self.count[n])

    def drop(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.some &= ~(1 << n)

    def fill(self, space: int) -> int:
        """How much of ``space`` the largest fitting pieces take, one after the other."""
        left, limit, used = space, space, 0
        while left and limit and (fits := self.some & ((1 << (min(left, limit) + 1)) - 1)):
            n = fits.bit_length() - 1
            used = min(self.count[n], left // n)
            left -= used * n
            limit = n - 1
        return space - left


def opening(n: int, still: Remaining, permitted: tuple[int, ...]) -> int:
    """The permitted length to open for a piece of ``n``: least cost a token when filled, the longest on ties."""
    best = None
    for c in permitted:
        if c >= n:
            full = n + still.fill(c - n)
            price = cost(next(p for p in permitted if p >= full)) / full
            if best is None or price <= best[0]:
                best = price, c
    return best[1]


def best_fit(lengths: np.ndarray, permitted: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of pieces given longest first; pieces of length 0 get bin -1."""
    most, still = permitted[-1], Remaining(lengths, permitted[-1])
    spaces: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by space left
    open_ = 0  # bit s is set when a bin has space s
    bins, offsets, used = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64), []
    for k, n in enumerate(lengths.tolist()):
        if not n:
            continue
        still.drop(n)
        fits = open_ >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = spaces[space].pop()
            if not spaces[space]:
                open_ &= ~(1 << space)
        else:
            space, b = opening(n, still, permitted), len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        if space > n:
            spaces[space - n].append(b)
            open_ |= 1 << (space - n)
    sizes = np.array(permitted)[np.searchsorted(permitted, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, np.where(bins >= 0, sizes[bins] if len(sizes) else 0, 0)


def token_sizes(docs: DataFrame, tokenizer_path: str, end_ids: int = 1) -> DataFrame:
    """(doc_id, size): token ids of every row of ``docs`` (doc_id, text) and its end id; a null text has the end id alone."""

    def make() -> C.Kernel:
        tokenizer = CachedTokenizer(tokenizer_path)
        return lambda data, offsets: [tokenizer.counts(data, offsets) + end_ids]

    return C.map_texts(docs, ["doc_id"], "size long", make)


def pack(sizes: DataFrame, permitted: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Pieces of ``sizes`` (doc_id, size), a table in files, with their bins.

    Every row of ``sizes`` is packed, repeated rows as often as they stand. Sizes of null or 0
    give one piece of length 0 with a null bin. Equal lengths are taken by doc_id and
    piece, nulls first. Bins are numbered within their shard (the upper 32 bits of bin_id).
    Rows are dealt by their number in the table as well, so that no id fills a shard.
    """
    most = permitted[-1]
    n = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).cast("long")
    rows = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("size"), F.monotonically_increasing_id().alias("row"))
    count = rows.select(F.sum(F.greatest(F.ceil(F.col("size") / most), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(count) // SHARD))
    pieces = rows.select("doc_id", "row", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / most), F.lit(1)) - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("size") - F.col("piece") * most, F.lit(most)).alias("length"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards))).drop("row")

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        bins, offsets, capacity = best_fit(shard["length"].to_numpy(np.int64), permitted)
        number = pd.Series((shard["shard"].to_numpy(np.int64) << 32) + bins, index=shard.index, dtype="Int64").mask(bins < 0)
        return shard[["doc_id", "piece", "start", "length"]].assign(bin_id=number, bin_offset=offsets, capacity=capacity)

    return pieces.groupBy("shard").applyInPandas(run, PACKED)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.materialize(token_sizes(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")), "sizes"))
