"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.operators.graph import weak_components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v bigint); component is its least node.

    Self links and repeated links change nothing; nodes without links do not appear.
    """
    return weak_components(edges.select(F.col("u").alias("s"), F.col("v").alias("t")))
