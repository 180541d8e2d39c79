"""Near-duplicate groups: MinHash bands, odd-sketch verification, exact confirmation.

1. One pass turns every text into the set of hashes of its five-word shingles, and keeps
   of it: the set size, a 128-bit key of the set, ``BANDS`` band hashes of MinHash samples,
   and an odd sketch (the samples folded into a parity bitmap).
2. Documents with equal sets are one class; only classes go on. The texts of one doc_id
   are linked with each other through their id.
3. Classes that share a band key are candidates. The members of a key are dealt
   out in blocks of about ``BLOCK``; inside a block, XOR population counts of the odd
   sketches give all similarities at once, and only a maximum spanning forest over the
   pairs that can still be links is emitted: fewer rows than members, never all pairs.
4. Each pair of a forest is confirmed on the full shingle sets; confirmed pairs are links,
   and linked classes are a part.
5. Where a pair is refuted, or a key had several blocks, links between the parts at its
   ends may hide behind the forest. Classes of those parts are joined on their rarest
   shingles: two sets at similarity 0.75 share one that is among the first
   n - ceil(0.75 n) + 1 of the larger set and the first n - ceil(6/7 n) + 1 of the smaller,
   in any fixed order, and rare ones first makes few meet. Pairs of different parts that pass
   set sizes, places of the shared shingle and odd sketches are confirmed on full sets.
   Texts that only share a common template meet on none of their rare shingles.

With 32 bands of 4 samples a pair at similarity 0.75 misses all bands with probability
5e-6; a sketch estimate under ``SURE_BELOW`` is five standard errors under 0.75.
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
from roadspark.llm.components import components
from roadspark.operators.scratch import release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
BLOCK = 512
#: Shingles are ranked by how often their hash bucket occurs; pairs that a task looks at together.
RARITY_BUCKETS, PAIRS_AT_ONCE = 1 << 16, 1 << 18
SURE_BELOW = 0.55
#: The similarity limit as a ratio of integers.
LIMIT = (75, 100)

SIGNED = "n_shingles long, set_key binary, bands array<long>, sketch binary"


class Shingler:
    """Sets of shingle hashes, with the tables of one task."""

    def __init__(self, width: int = WIDTH) -> None:
        self.hasher, self.word, self.lower, self.width = C.Hasher(), C.word_table(), C.lower_table(), width

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text of a piece."""
        starts, ends, first = C.spans(self.word[data], offsets)
        words = self.hasher.of(self.hasher.prefix(self.lower[data]), starts, ends)
        window, at = C.windows(first, len(words), self.width)
        shingles = C.combine(words, window, self.width)
        for k in range(len(first) - 1):
            n = first[k + 1] - first[k]
            if n >= self.width:
                yield np.unique(shingles[at[k] : at[k + 1]])
            elif n:  # the whole short sequence is one shingle; its length keeps it apart from longer ones
                yield C.combine(words, first[k : k + 1], int(n)) + np.uint64(n)
            else:
                yield shingles[:0]


def sample_tables(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every sample's hash over the set, in slices of bounded size."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        x = shingles[i : i + 1024, None] * a + b
        x ^= x >> np.uint64(32)
        np.minimum(least, (x * np.uint64(0x9FB21C651E98DF25)).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Flips one bit for each (sample number, value): the parity of what falls on every bit."""
    at = C.mix(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(bits)
    parity = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def estimates(differing: np.ndarray, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity from the number of differing sketch bits."""
    left = np.maximum(1 - 2 * differing / bits, 1e-9)
    return 1 + bits / (4 * samples) * np.log(left)


def key_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame) -> DataFrame:
    """Set size, set key, band hashes and sketch of each document; texts without words have size 0."""

    def make() -> C.Kernel:
        shingler, (a, b) = Shingler(), sample_tables()
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            sizes, keys, bands, sketches = [], [], [], []
            for s in shingler.sets(data, offsets):
                samples = minhashes(s, a, b)
                sizes.append(len(s))
                keys.append(key_of(s))
                rows = samples.reshape(BANDS, ROWS)
                h = salt.copy()
                for r in range(ROWS):
                    h = C.mix(h ^ rows[:, r])
                bands.append(h.view(np.int64))
                sketches.append(odd_sketch(samples))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands)))
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(sketches, pa.binary())]

        return kernel

    return C.map_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], SIGNED, make)


def forest(similar: np.ndarray, cut: float) -> list[tuple[int, int]]:
    """A maximum spanning forest over the pairs at ``cut`` or above."""
    n, out = len(similar), []
    best, parent, open_ = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        k = int(np.argmax(np.where(open_, best, -2.0)))
        open_[k] = False
        if best[k] >= cut:
            out.append((int(parent[k]), k))
        nearer = open_ & (similar[k] > best)
        best[nearer], parent[nearer] = similar[k][nearer], k
    return out


def similarities(sketch: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Estimates for all pairs of a block; -1 where the set sizes alone rule a link out."""
    differ = np.zeros((len(size), len(size)), np.int64)
    for w in range(sketch.shape[1]):
        differ += np.bitwise_count(sketch[:, w, None] ^ sketch[None, :, w])
    similar = estimates(differ)
    low, high = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    similar[LIMIT[1] * low < LIMIT[0] * high] = -1
    return similar


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of complete groups, from batches sorted by the integer columns ``by``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in by])
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in by):
            yield pa.Table.from_batches(held)
            held = []
        other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        tail = int(other[-1]) + 1 if len(other) else 0  # rows of the last group begin here
        if tail:
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = []
        held.append(batch.slice(tail))
    if held:
        yield pa.Table.from_batches(held)


def group_edges(table: pa.Table, by: list[str]) -> np.ndarray:
    keys = np.stack([table.column(c).to_numpy() for c in by])
    return np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [keys.shape[1]]])


def candidate_pairs(members: DataFrame) -> DataFrame:
    """(a, b, weak) from rows (key, block, rep, head, split, n_shingles, sketch): the forests of all blocks.

    A weak pair only ties a block of a large key to the key's head: it makes them one
    family, whose links are then looked for exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "block"]):
            rep, head, split, size = (table.column(c).to_numpy() for c in ("rep", "head", "split", "n_shingles"))
            sketch = np.frombuffer(b"".join(x.as_py() for x in table.column("sketch").combine_chunks()), np.uint64).reshape(len(rep), -1)
            edge = group_edges(table, ["key", "block"])
            i = edge[:-1][np.diff(edge) == 2]  # most blocks: one pair
            near = estimates(np.bitwise_count(sketch[i] ^ sketch[i + 1]).sum(axis=1)) >= SURE_BELOW
            low, high = np.minimum(size[i], size[i + 1]), np.maximum(size[i], size[i + 1])
            i = i[near & (LIMIT[1] * low >= LIMIT[0] * high)]
            out = [(int(x), int(y), False) for x, y in zip(rep[i], rep[i + 1])]
            for s, e in zip(edge[:-1], edge[1:]):
                if e - s > 2:
                    out += [(int(rep[s + x]), int(rep[s + y]), False) for x, y in forest(similarities(sketch[s:e], size[s:e]), SURE_BELOW)]
                if split[s]:
                    out += [(int(rep[s]), int(head[s]), True)] if rep[s] != head[s] else []
                    out += [(int(r), int(rep[s]), True) for r in rep[s + 1 : e]]
            if out:
                a, b, weak = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(weak)], ["a", "b", "weak"])

    return members.mapInArrow(run, "a long, b long, weak boolean")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked): 100 * |intersection| >= 75 * |union| on the full sets.

    ``sets`` has rep and shingles (sorted 64-bit hashes as bytes). Both joins are on one
    document of the pair; AQE splits a document that stands in very many pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left_set"), batch.column("right_set")
            linked = []
            for x, y in zip(left, right):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                shared = int((q[at] == p).sum())
                linked.append(LIMIT[1] * shared >= LIMIT[0] * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right_set"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left_set", "right_set").mapInArrow(run, "a long, b long, linked boolean")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the wanted classes (rep, doc_id, set_key) only, from a text with that set.

    A merge join at every size: the wanted ids grow with the corpus. On large inputs Spark
    filters the documents by the ids' Bloom filter before it shuffles them.
    """

    def make() -> C.Kernel:
        shingler = Shingler()

        def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            sets = list(shingler.sets(data, offsets))
            return [pa.array([key_of(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]

        return kernel

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id")
    sets = C.map_texts(texts, ["rep", "set_key"], "text_key binary, shingles binary", make).filter("text_key = set_key")
    return sets.select("rep", "shingles").dropDuplicates(["rep"])


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - RARITY_BUCKETS.bit_length() + 1)).astype(np.int64)


def rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` (shingles) fall in each hash bucket; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RARITY_BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column("shingles"):
                n += np.bincount(bucket_of(np.frombuffer(x.as_buffer(), np.uint64)), minlength=RARITY_BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    counted = sets.select("shingles").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(RARITY_BUCKETS, np.int64)
    table[np.asarray(counted.column("bucket"))] = np.asarray(counted.column("n"))
    return table


def prefix_length(n):
    """Shingles of a set of n among which it shares one with any set at the limit, in any fixed order."""
    return n - -(-LIMIT[0] * n // LIMIT[1]) + 1


def index_length(n):
    """The same where the other set is at least as large and is looked through to its prefix_length."""
    return n - -(-2 * LIMIT[0] * n // (LIMIT[0] + LIMIT[1])) + 1


PREFIX = "shingle long, place long, indexed boolean, rep long, part long, n_shingles long, sketch binary"


def rare_prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``PREFIX`` rows: the rarest shingles of each row of ``docs`` (rep, part, n_shingles, sketch, shingles)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                first = []
                for x in part.column("shingles"):
                    h = np.frombuffer(x.as_buffer(), np.uint64)
                    first.append(h[np.lexsort((h, table[bucket_of(h)]))[: prefix_length(len(h))]])
                n = np.array([len(f) for f in first])
                take = np.repeat(np.arange(len(first)), n)
                place = np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
                indexed = place < index_length(part.column("n_shingles").to_numpy())[take]
                rest = [part.column(c).take(pa.array(take)) for c in ("rep", "part", "n_shingles", "sketch")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(place), pa.array(indexed), *rest], [f.split()[0] for f in PREFIX.split(", ")])

    return docs.select("rep", "part", "n_shingles", "sketch", "shingles").mapInArrow(run, PREFIX)


def cross_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of different parts that share a shingle of ``rows`` and pass sizes, places and sketches.

    At a shingle, indexed rows outside its largest part meet all rows, and those of its
    largest part meet the rows outside it. Both sides are cut into pieces of about
    ``BLOCK`` rows, and every piece of one side meets every piece of the other.
    """
    parts = rows.groupBy("shingle", "part").agg(F.count("*").alias("n"), F.count_if("indexed").alias("i"))
    whole = parts.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("i").alias("i"), F.max(F.struct("n", "part", "i")).alias("most"), F.count("*").alias("parts")).filter("parts > 1 AND i > 0")

    def pieces(n):
        return F.ceil(n / BLOCK).cast("long")

    sized = whole.select(
        "shingle", F.col("most.part").alias("main"), pieces(F.col("i") - F.col("most.i")).alias("l0"), pieces(F.col("n")).alias("r0"), pieces(F.col("most.i")).alias("l1"), pieces(F.col("n") - F.col("most.n")).alias("r1")
    )
    docs, zero = rows.join(sized.hint("merge"), "shingle"), F.lit(0).cast("long")
    kept = ["left", "place", "rep", "part", "n_shingles", "sketch"]
    inside = F.col("part") == F.col("main")
    every = lambda n: F.explode(F.sequence(zero, n - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), n)
    left = docs.filter("indexed").withColumns({"left": F.lit(1), "kind": inside.cast("int")})
    left = left.select("shingle", "kind", own(F.when(inside, F.col("l1")).otherwise(F.col("l0"))).alias("x"), every(F.when(inside, F.col("r1")).otherwise(F.col("r0"))).alias("y"), *kept)
    right = docs.withColumn("left", F.lit(0))
    to_all = right.filter("l0 > 0").select("shingle", F.lit(0).alias("kind"), every(F.col("l0")).alias("x"), own(F.col("r0")).alias("y"), *kept)
    to_main = right.filter(~inside & (F.col("l1") > 0)).select("shingle", F.lit(1).alias("kind"), every(F.col("l1")).alias("x"), own(F.col("r1")).alias("y"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["shingle", "kind", "x", "y"]
        for table in whole_groups(batches, by):
            edge = group_edges(table, by)
            is_left, place, part, rep, size = (table.column(c).to_numpy() for c in ("left", "place", "part", "rep", "n_shingles"))
            sketch = np.frombuffer(b"".join(x.as_py() for x in table.column("sketch").combine_chunks()), np.uint64).reshape(len(rep), -1)
            n_left = np.add.reduceat(is_left, edge[:-1])
            # each left row meets the right rows, which stand before the left ones of its group
            left = np.flatnonzero(is_left)
            begin, count = np.repeat(edge[:-1], n_left), np.repeat(np.diff(edge) - n_left, n_left)
            upto, out = np.cumsum(count), []
            i = 0
            while i < len(left):
                done = upto[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, "right")))
                a = np.repeat(left[i:j], count[i:j])
                b = np.repeat(begin[i:j] - (upto[i:j] - count[i:j] - done), count[i:j]) + np.arange(len(a))
                i = j
                most = np.minimum(size[a] - place[a], size[b] - place[b])  # shared ones, if this is their first
                ok = (part[a] != part[b]) & (size[a] <= size[b]) & (LIMIT[1] * size[a] >= LIMIT[0] * size[b]) & (sum(LIMIT) * most >= LIMIT[0] * (size[a] + size[b]))
                a, b = a[ok], b[ok]
                ok = estimates(np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1)) >= SURE_BELOW
                u, v = rep[a[ok]], rep[b[ok]]
                out.append(np.stack([np.minimum(u, v), np.maximum(u, v)]))
            if out:
                a, b = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = left.union(to_all).union(to_main).repartition("shingle", "kind", "x", "y").sortWithinPartitions("shingle", "kind", "x", "y", "left", "rep")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def linked_parts(found: DataFrame, links: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, component) of the classes in pairs ``found`` (a, b, weak), from confirmed links and from those that hide behind the pairs."""
    parts = C.materialize(components(links), "parts")
    ends = found.select(F.col("a").alias("rep")).union(found.select("b")).union(links.select("u")).union(links.select("v")).distinct()
    named = C.materialize(ends.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("part")), "named")
    part_of = lambda end: named.select(F.col("rep").alias(end), F.col("part").alias(f"part_{end}"))
    torn = found.join(part_of("a"), "a").join(part_of("b"), "b").filter("part_a <> part_b")
    open_ = C.materialize(torn.select(F.explode(F.array("part_a", "part_b")).alias("part")).distinct(), "open")
    if open_.isEmpty():
        C.discard(open_, parts)
        return named.select("rep", F.col("part").alias("component"))
    docs = named.join(open_, "part", "left_semi").join(reps.select("rep", "n_shingles", "sketch"), "rep").join(sets, "rep")
    docs = C.materialize(docs.select("rep", "part", "n_shingles", "sketch", "shingles"), "torn")
    pairs = cross_pairs(rare_prefixes(docs, rarity(docs)))
    fresh = pairs.join(found.filter(~F.col("weak")).select("a", "b"), ["a", "b"], "left_anti")
    hidden = confirm(fresh, docs.select("rep", "shingles")).filter("linked").join(part_of("a"), "a").join(part_of("b"), "b")
    hidden = C.materialize(hidden.select(F.col("part_a").alias("u"), F.col("part_b").alias("v")).distinct(), "hidden")
    joined = components(hidden) if not hidden.isEmpty() else hidden.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = C.materialize(named.join(joined.withColumnRenamed("node", "part"), "part", "left").select("rep", F.coalesce("component", "part").alias("component")), "labels")
    C.discard(open_, parts, named, docs, hidden)
    return out


def links_of_ids(usable: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v): links between the classes of ids that have several texts."""
    several = C.materialize(usable.groupBy("doc_id").agg(F.min("set_key").alias("k"), F.max("set_key").alias("k2")).filter("k <> k2").select("doc_id"), "several")
    if several.isEmpty():  # as a rule; nothing else is planned then
        return reps.select(F.col("rep").alias("u"), F.col("rep").alias("v")).limit(0)
    own = usable.join(several, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(reps.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    head = own.groupBy("doc_id").agg(F.min("rep").alias("v"))
    return own.join(head, "doc_id").filter("rep <> v").select(F.col("rep").alias("u"), "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have no shingles and are linked with nothing. Several
    texts under one doc_id are linked with each other, and all rows of the id get their
    component. A null doc_id cannot be linked: its row has a null component and is
    kept. An empty table gives an empty result.
    """
    signed = C.materialize(sign(docs), "signatures")
    usable = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # equal sets have equal bands and sketches; the number of a class holds from here on, as it is in a file
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = C.materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("head")).filter("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK)
    members = keyed.join(shared, "key").select(
        "key", "rep", F.pmod(F.xxhash64("rep", "key"), blocks).alias("block"), "head", (blocks > 1).alias("split")
    )
    members = members.join(reps.select("rep", "n_shingles", "sketch"), "rep").select("key", "block", "rep", "head", "split", "n_shingles", "sketch")
    found = C.materialize(candidate_pairs(members.repartition("key", "block").sortWithinPartitions("key", "block", "rep")).groupBy("a", "b").agg(F.min("weak").alias("weak")), "pairs")
    same_id = C.materialize(links_of_ids(usable, reps), "id-links")
    release(docs.sparkSession)
    grouped = reps.select("set_key", F.col("doc_id").alias("component_id"))
    if not found.isEmpty() or not same_id.isEmpty():
        wanted = found.select(F.col("a").alias("rep")).union(found.select("b")).distinct().join(reps.select("rep", "doc_id", "set_key"), "rep")
        sets = C.materialize(full_sets(docs, wanted), "sets")
        links = confirm(found.filter(~F.col("weak")).select("a", "b"), sets).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = C.materialize(links.union(same_id), "links")
        release(docs.sparkSession)
        labels = linked_parts(found, links, sets, reps)
        named = reps.select("set_key", "doc_id", "rep").join(labels, "rep", "left")
        least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
        grouped = C.materialize(named.join(least, "component", "left").select("set_key", F.coalesce("least", "doc_id").alias("component_id")), "groups")
        C.discard(sets, links)
        release(docs.sparkSession)
    C.discard(found, same_id)
    # a row without a set keeps a null key here and stands for itself
    out = signed.withColumn("_key", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")))
    out = out.select("doc_id", "n_shingles", "_key").join(grouped.withColumnRenamed("set_key", "_key"), "_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))


#: All links by shared shingles, then least labels to a fixpoint.
OP6_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM w, range(1, greatest(len(w) - 3, 2)) r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
c(node, label) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.v, min(c.label) FROM c JOIN e ON e.u = c.node JOIN recurring.c r ON r.node = e.v WHERE c.label < r.label GROUP BY e.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.label AS component_id, d.doc_id = c.label AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
