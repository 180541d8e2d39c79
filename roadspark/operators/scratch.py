"""Cutting lineage between rounds of iterative operators with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset: a temporary folder if driver and executors are one local process,
    else a folder of the warehouse, which all machines of a cluster reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        root = tempfile.mkdtemp(prefix="roadspark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: what follows depends on files, not on how they were made."""
    path = f"{scratch_dir(df.sparkSession)}/rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the broadcasts, shuffle files and plans of finished jobs now.

    Spark's cleaner drops them once the driver's collector has found them unused, which
    between many small jobs may be late; one collection costs a fraction of a second.
    """
    spark.sparkContext._jvm.java.lang.System.gc()
