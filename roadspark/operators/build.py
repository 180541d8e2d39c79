"""Stages of a graph build with checkpoints: each one is a table; finished ones are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def is_done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def build(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], overwrite: bool = False, redo: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Runs the stages in order; each gets the tables before it.

    A stage runs if its table is not complete, if ``overwrite`` is set, or if it or one
    before it is in ``redo``.
    """
    tables: dict[str, DataFrame] = {}
    again = overwrite
    for name, make in stages:
        path = f"{folder}/{name}"
        again = again or name in redo
        if again or not is_done(spark, path):
            make(tables).write.mode("overwrite").parquet(path)
            again = True
        tables[name] = spark.read.parquet(path)
    return tables
