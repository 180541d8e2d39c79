"""What near-duplicates need not plan."""

from pyspark.sql import functions as F

from roadspark.llm import near_dedup


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_ids_with_one_text_each_plan_no_joins(spark):
    reps = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 2)], "rep long, set_key string, doc_id long")
    alone = near_dedup.links_of_ids(reps.filter("set_key < 'c'").select("doc_id", "set_key"), reps)
    assert alone.dtypes == [("u", "bigint"), ("v", "bigint")] and alone.isEmpty() and _joins(alone) == 0
    several = near_dedup.links_of_ids(reps.select("doc_id", "set_key"), reps)
    assert [tuple(r) for r in several.collect()] == [(2, 1)] and _joins(several) > 0


def test_parts_without_open_pairs_keep_their_labels(spark):
    found = spark.createDataFrame([(1, 2, False), (3, 4, False)], "a long, b long, weak boolean")
    links = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
    got = near_dedup.linked_parts(found, links, None, None)  # looks at no sets where no pair was refuted
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 3), (4, 3)]
