"""Near-duplicates under repeated and negative ids."""

from roadspark.llm import near_dedup
from tests.llm.test_near_dedup import brute, corpus


def test_links_are_confirmed_on_the_chosen_text(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(7, None), (7, text), (8, text + " more"), (9, None), (9, text + " and"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in near_dedup.near_duplicates(df).collect() if r.n_shingles} == {7}


def test_negative_ids_in_split_keys(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rows = [(i - 1000, t) for i, t in corpus(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()} == brute(rows)


def test_all_texts_of_an_id_are_linked(spark):
    a, b = " ".join(f"first{k}" for k in range(40)), " ".join(f"second{k}" for k in range(40))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, b + " more"), (5, "something else altogether in this text"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    assert len(got) == len(rows)
