"""Table operators: merges, ranking, prefix sums and paging without a single global task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.operators.scratch import settle


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions for a table, so that about ``rows`` rows are in each however large it is. The table is counted."""
    return max(1, -(-df.count() // rows))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Upsert: of all rows with a key, the one with the largest version (new rows after old ones on ties)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(c) for c in old.columns])
    best = both.groupBy(*keys).agg(F.max_by(row, F.struct(*version, F.col("_new"))).alias("_row"))
    return best.select("_row.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the new rows whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def accumulate(log: DataFrame, keys: list[str], at: str, payload: str) -> DataFrame:
    """Access log to one row a key: number of accesses, the last one, and its payload."""
    return log.groupBy(*keys).agg(F.count("*").alias("access_count"), F.max(at).alias("accessed_at"), F.max_by(payload, F.struct(at, payload)).alias("payload"))


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def value_at(df: DataFrame, keys: list[str], value: str, share: float, most: int = 1 << 16, cells: int = 4096) -> DataFrame:
    """(keys, n, value): of each group's n values in order, the one at place floor(share * n), counted from 0. Exact.

    No group is gathered or sorted whole. A histogram between its least and greatest value shows the cell
    of the wanted place; only that cell is cut again, until at most ``most`` rows are left in it or they are all
    equal, and then its distinct values are put in order. Values that are null or not finite are
    left out, groups without others too; null keys are a group of their own. ``df`` is read once a round and twice more.
    """
    v, group = F.col("_v"), Window.partitionBy(*keys)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def inside(state: DataFrame) -> DataFrame:
        on = F.lit(True)
        for k, n in zip(keys, names):
            state, on = state.withColumnRenamed(k, n), on & F.col(k).eqNullSafe(F.col(n))
        return rows.join(state, on).filter(v.between(F.col("_lo"), F.col("_hi")))

    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = state.select("*", F.least(F.floor(F.col("n") * share), F.col("n") - 1).cast("long").alias("_at"), F.col("n").alias("_m"))
    state = settle(state, "places")
    while not state.filter((F.col("_m") > most) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        width = F.col("_hi") - F.col("_lo")
        cell = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width * cells), F.lit(cells - 1))).otherwise(0).alias("_cell")
        counts = inside(state).groupBy(*keys, "n", "_at", cell).agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        counts = counts.withColumn("_upto", F.sum("_m").over(group.orderBy("_cell"))).filter("_upto > _at")
        found = counts.groupBy(*keys).agg(F.min(F.struct("_cell", "n", "_lo", "_hi", "_at", "_m", "_upto")).alias("f"))
        state = settle(found.select(*keys, "f.n", "f._lo", "f._hi", (F.col("f._at") - (F.col("f._upto") - F.col("f._m"))).alias("_at"), "f._m"), "places")
    counts = inside(state).groupBy(*keys, "n", "_at", "_v").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_upto", F.sum("_c").over(group.orderBy("_v"))).filter("_upto > _at")
    return counts.groupBy(*keys).agg(F.max("n").alias("n"), F.min("_v").alias(value))


def with_running_sums(df: DataFrame, order: str, values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds, for each name, the sum of its value over all rows before this one in ``order``.

    Two levels: rows are dealt to key ranges, sums of whole ranges are carried over, and only the
    rows of one range are sorted together. The ranges' sums are the only thing that one task sees.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    number = F.lit(0)
    for q in cuts:
        number = number + F.when(F.col(order) >= q, 1).otherwise(0)
    ranged = df.withColumn("_range", number)
    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in values])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{n}") for n, v in values.items()])
    joined = local.join(F.broadcast(carried), "_range")  # one row a range, at most ``parts``
    return joined.select(*df.columns, *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in values])


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 in ``order``."""
    numbered = with_running_sums(df, order, {"_row": F.lit(1)})
    return numbered.filter((F.col("_row") >= offset) & (F.col("_row") < offset + limit)).drop("_row")


def changed_rows(old: DataFrame, new: DataFrame, key: str, value: Column) -> DataFrame:
    """Keys that were added, changed or removed between two snapshots."""
    a = old.select(F.col(key), value.alias("_a"))
    b = new.select(F.col(key), value.alias("_b"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, kind.alias("change"))
