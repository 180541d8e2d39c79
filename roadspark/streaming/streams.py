"""Structured Streaming forms of the continuous feeds; each has a batch twin among the queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from roadspark.operators.tables import latest_wins
from roadspark.sources.osm import log_rows


def read_events(spark: SparkSession, folder: str, schema: T.StructType, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, ``per_batch`` files a micro batch; ``ts`` as a zoned timestamp."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def volume_stream(bookings: DataFrame, late: str = "2 hours") -> DataFrame:
    """(node_id, starts, volume): signed bookings per 300-second slot; later ones than ``late`` are dropped, as a cleared slot drops them."""
    w = F.window("ts", "300 seconds")
    out = bookings.withWatermark("ts", late).groupBy("node_id", w).agg(F.sum("delta").alias("volume"))
    return out.select("node_id", F.col("window.start").alias("starts"), F.greatest("volume", F.lit(0)).alias("volume"))


def rate_stream(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Milliseconds an edge over one-minute windows every 15 seconds."""
    w = F.window("ts", "1 minute", "15 seconds")
    out = requests.withWatermark("ts", late).groupBy(w).agg(F.sum("duration_ms").alias("ms"), F.sum("edges_found").alias("edges"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("starts"), (F.col("ms") / F.col("edges")).alias("ms_per_edge"), "n")


def success_stream(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    out = requests.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes")).agg(F.avg("success").alias("share"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("starts"), (F.col("share") * 100).alias("success_pct"), "n")


def histogram_stream(requests: DataFrame, limits: list[float], late: str = "10 minutes") -> DataFrame:
    """Cumulative latency buckets for every five minutes."""
    counts = [F.count_if(F.col("duration_ms") <= v).alias(f"n{k}") for k, v in enumerate(limits)]
    out = requests.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes")).agg(*counts)
    buckets = F.array(*[F.struct(F.lit(v).alias("le"), F.col(f"n{k}").alias("n")) for k, v in enumerate(limits)])
    return out.select(F.col("window.start").alias("starts"), F.explode(buckets).alias("b")).select("starts", "b.le", "b.n")


def log_stream(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Errors by logger and exception over five minutes, from JSON lines."""
    rows = log_rows(lines).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "5 minutes"), "logger", "exception").agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count("*").alias("n"))


def trip_stream(fixes: DataFrame, gap: str = "10 hours", late: str = "1 hour") -> DataFrame:
    """Trips: fixes of an agent with no pause beyond ``gap``."""
    out = fixes.withWatermark("ts", late).groupBy("agent_id", F.session_window("ts", gap)).agg(F.count("*").alias("fixes"), F.max("speed_kmh").alias("top_kmh"))
    return out.select("agent_id", F.col("session_window.start").alias("starts"), "fixes", "top_kmh")


class TeleportDetector(StatefulProcessor):
    """Keeps each agent's last fix; reports steps that are too long for the time between them.

    Fixes older than the last one are left out.
    """

    def __init__(self, most_kmh: float = 150.0, slack: float = 1.5) -> None:
        self.most_mps, self.slack = most_kmh / 3.6, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sec double, lon double, lat double, running boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import math

        out = []
        fixes = pd.concat(list(rows)).sort_values(["sec", "event_id"])
        before = self.last.get() if self.last.exists() else None
        for f in fixes.itertuples():
            if before is not None:
                sec, lon, lat, running = before
                if f.sec < sec:  # later than a fix that was handled already
                    continue
                a = math.sin(math.radians(f.lat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(f.lat)) * math.sin(math.radians(f.lon - lon) / 2) ** 2
                metres = 2 * 6371000.0 * math.asin(math.sqrt(a))
                if running and f.is_running and metres > self.most_mps * (f.sec - sec) * self.slack:
                    out.append((int(f.event_id), key[0], metres))
            before = (float(f.sec), float(f.lon), float(f.lat), bool(f.is_running))
        if before is not None:
            self.last.update(before)
        yield pd.DataFrame(out, columns=["event_id", "agent_id", "metres"])

    def close(self) -> None:
        pass


def teleport_stream(fixes: DataFrame, most_kmh: float = 150.0, slack: float = 1.5) -> DataFrame:
    """(event_id, agent_id, metres) of impossible steps; needs the RocksDB state store."""
    rows = fixes.select("agent_id", "event_id", (F.unix_micros("ts") / 1e6).alias("sec"), "lon", "lat", "is_running")
    return rows.groupBy("agent_id").transformWithStateInPandas(
        statefulProcessor=TeleportDetector(most_kmh, slack), outputStructType="event_id long, agent_id long, metres double", outputMode="Append", timeMode="None"
    )


class TaskProgress(StatefulProcessor):
    """Keeps each task's start and latest progress; a task without news for the retention time is dropped by an event-time timer."""

    def __init__(self, retention_s: float) -> None:
        self.retention_s = retention_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "first double, last double, done double, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        first, last, done, due = self.task.get() if self.task.exists() else (None, None, 0.0, None)
        for r in pd.concat(list(rows)).sort_values(["sec", "done"]).itertuples():
            first = r.sec if first is None else min(first, r.sec)
            if last is not None and r.sec < last:  # older than what is known
                continue
            last, done = float(r.sec), max(done, float(r.done))
            share = min(done / r.total, 1.0) if r.total > 0 else 0.0
            rate = done / (last - first) if last > first else None
            left = (r.total - done) / rate if rate else None
            out.append((key[0], last, 100.0 * share, left, False))
        if last is not None:
            now = int((last + self.retention_s) * 1000)
            if due is not None and due != now:
                self.handle.deleteTimer(due)
            if due != now:
                self.handle.registerTimer(now)
            self.task.update((float(first), last, done, now))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, done, due = self.task.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.task.clear()
        yield self._frame([(key[0], last, None, None, True)])

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["task", "sec", "percent", "left_s", "expired"]).astype({"task": "object", "sec": "float64", "percent": "float64", "left_s": "float64", "expired": "bool"})

    def close(self) -> None:
        pass


def task_stream(news: DataFrame, retention: float = 86_400.0, late: str = "10 minutes") -> DataFrame:
    """(task, sec, percent, left_s, expired) from news (task string, ts, done, total): progress and time left as news comes in, and one
    row with ``expired`` when a task's state has been dropped after ``retention`` seconds of event time without news; needs the RocksDB state store.
    """
    rows = news.withWatermark("ts", late).select("task", "ts", (F.unix_micros("ts") / 1e6).alias("sec"), F.col("done").cast("double").alias("done"), F.col("total").cast("double").alias("total"))
    return rows.groupBy("task").transformWithStateInPandas(
        statefulProcessor=TaskProgress(retention), outputStructType="task string, sec double, percent double, left_s double, expired boolean", outputMode="Append", timeMode="EventTime"
    )


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, top, top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """bucket -> generation of a bucketed table, as of its newest whole batch (before batch ``below``)."""
    jvm, top, fs = _files(spark, f"{path}/manifest")
    if not fs.exists(top):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(top)]
    known = [int(n) for n in names if n.isdigit() and (below is None or int(n) < below)]
    if not known:
        return {}
    rows = spark.read.schema("bucket int, generation long").parquet(f"{path}/manifest/{max(known):09d}").collect()  # a row a bucket
    return {r.bucket: r.generation for r in rows}


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, generations: dict[int, int] | None = None) -> DataFrame:
    """A bucketed table as of a manifest; what later batches write does not change it."""
    at = manifest(spark, path) if generations is None else generations
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/generation={g:09d}/bucket={b}" for b, g in sorted(at.items())])


def upsert_buckets(path: str, keys: list[str], version: list[str], buckets: int = 64):
    """A foreachBatch function that merges each batch into the table at ``path``, newest version first, touching few files.

    Rows lie in ``buckets`` buckets by the hash of their keys. A batch rewrites the buckets that it has rows for, as a new generation beside the
    old one, and then puts a manifest (bucket -> generation) in place by renaming it. Readers see whole batches; a batch that failed half-way, or is run again,
    starts from the manifest before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = manifest(spark, path, below=number)
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        old = read_buckets(spark, path, batch.schema, {b: g for b, g in at.items() if b in touched})
        table = latest_wins(old, batch, keys, [F.col(v) for v in version]).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        table.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/generation={number:09d}")
        rows = sorted({**at, **{b: number for b in touched}}.items())
        made = f"{path}/manifest/_new-{number:09d}"
        spark.createDataFrame(rows, "bucket int, generation long").coalesce(1).write.mode("overwrite").parquet(made)
        jvm, top, fs = _files(spark, f"{path}/manifest/{number:09d}")
        fs.delete(top, True)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(made), top):
            raise OSError(f"{made} could not be renamed")

    return merge


def upsert_into(path: str, keys: list[str], version: list[str]):
    """A foreachBatch function that merges each batch into the Parquet table at ``path``, newest version first.

    Every batch writes a new generation beside the old one, so a failed batch can be run
    again; ``current(path)`` names the newest complete one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path, below=number)
        table = latest_wins(spark.read.parquet(old), batch, keys, [F.col(v) for v in version]) if old else latest_wins(batch.limit(0), batch, keys, [F.col(v) for v in version])
        table.write.mode("overwrite").parquet(f"{path}/generation={number:09d}")

    return merge


def current(spark: SparkSession, path: str, below: int | None = None) -> str | None:
    """The newest generation of a merged table (before batch ``below``) that was written whole."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    done = []
    for s in fs.listStatus(top):
        name = s.getPath().getName()
        if name.startswith("generation=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            n = int(name.partition("=")[2])
            if below is None or n < below:
                done.append((n, s.getPath().toString()))
    return max(done)[1] if done else None
