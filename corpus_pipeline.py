"""A corpus pipeline: documents in, packed training sequences out.

Each stage gets what its predecessor kept, from Parquet in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadspark.llm import stages
from roadspark.llm.common import documents, materialize
from roadspark.operators.scratch import release

STAGES = [
    ("quality classifier", stages.quality),
    ("toxicity", stages.toxicity),
    ("near-duplicates", stages.deduplicate),
    ("mixing sources", stages.mix),
    ("best-fit packing", stages.pack),
]

#: The fitted scores of the first stages have no SQL form; tests hold each stage against its operator's rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
            release(spark)
    return docs
