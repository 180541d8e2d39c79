"""Table operators against plain Python."""

import random

import pytest

from roadspark.operators import tables


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_value_at_equals_the_sorted_list(spark, share):
    rng = random.Random(5)
    rows = [("ties", float(rng.randint(0, 3))) for _ in range(300)] + [("wide", rng.lognormvariate(0, 40)) for _ in range(300)] + [(None, -rng.random()) for _ in range(40)]
    rows += [("one", 7.0), ("same", 1.5)] + [("same", 1.5)] * 99 + [("odd", None), ("odd", float("nan")), ("odd", float("inf")), ("ties", None)]
    got = tables.value_at(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", share, most=5, cells=4).collect()
    want = {}
    for g in {"ties", "wide", None, "one", "same"}:
        values = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = (len(values), values[min(int(share * len(values)), len(values) - 1)])
    assert {r.g: (r.n, r.x) for r in got} == want


def test_value_at_of_nothing(spark):
    assert tables.value_at(spark.createDataFrame([], "g string, x double"), ["g"], "x", 0.5).collect() == []
