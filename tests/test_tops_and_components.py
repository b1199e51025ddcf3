"""Order of near vectors, components by contraction, counts of words by one pass."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import graph, learning


def test_the_nearest_are_ordered_before_they_are_rounded(spark):
    rows = [(i, [1.0, (40 - i) * 1e-4]) for i in range(1, 31)]
    top = learning.vector_top(spark.createDataFrame(rows, "id long, embedding array<double>"), [1.0, 0.0], 5)
    assert [r["id"] for r in top.collect()] == [30, 29, 28, 27, 26] and top.first()["cosine"] == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_paths_hubs_loops_and_nulls(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(range(10_000), 400)
    edges = [(names[k], names[k + 1]) for k in range(150)] + [(names[200], names[201 + k]) for k in range(60)]
    edges += [(names[k], names[rng.randrange(300, 380)]) for k in range(300, 340)] + [(names[399], names[399]), (None, names[398])]
    over = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            over[max(x, y)] = min(x, y)
    found = graph.connected(spark.createDataFrame(edges, "src long, dst long"), most=9)
    assert {r["id"]: r["component"] for r in found.collect()} == {x: root(x) for x in over} | {None: names[398]}
    assert graph.connected(spark.createDataFrame([], "src string, dst string"), most=None).count() == 0


def test_words_are_hashed_once(spark):
    rows = spark.createDataFrame([("a b  A\tc",), ("",), (None,)], "text string").select(C.hashed_words(F.col("text"), 8).alias("v"))
    assert [sum(r["v"]) for r in rows.collect()] == [4, 0, 0]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5") < plan.index("array_repeat") if "array_repeat" in plan else "filter(transform" not in plan
