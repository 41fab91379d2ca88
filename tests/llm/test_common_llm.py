"""Connected components and vector checks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from churnwise.llm.common import connected_components, usable_vector


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 40)] + [(50, i) for i in range(20, 60)],
    [(random.Random(3).randrange(200), random.Random(i).randrange(200)) for i in range(150)],
    [(5, 5)],
    [],
])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    want = {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert {r["node"]: r["root"] for r in got} == want
    assert len(got) == len(want)


def test_usable_vector(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), (None,), ([1.0, None],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(usable_vector(F.col("v")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False, False, False, False]
