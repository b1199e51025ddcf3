"""Fast random projection."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph


def test_vectors_are_the_same_in_each_run_and_zero_for_isolated_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    once, again = ({r["id"]: r["vector"] for r in graph.fastrp(edges.repartition(n), nodes=nodes, size=16).collect()} for n in (1, 3))
    assert set(once) == set(range(1, 7)) and once[6] == [0.0] * 16
    for i in once:
        assert once[i] == pytest.approx(again[i])
    assert any(once[1]) and any(once[4])
    # 4's only neighbour is 5: after one round it has 5's start, after two its own.
    one, two = ({r["id"]: r["vector"] for r in graph.fastrp(edges, size=16, weights=w).collect()} for w in ((1.0,), (0.0, 1.0)))
    assert two[4] == pytest.approx(one[5]) and two[5] == pytest.approx(one[4])
    assert all(sum(x * x for x in v) == pytest.approx(1.0) or not any(v) for v in two.values())


def test_weights_of_edges_and_of_degrees(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0)], "src long, dst long, w double")
    start = {r["id"]: r["vector"] for r in graph.fastrp(edges, "w", size=32, weights=(1.0,)).collect()}
    round_one = {r["id"]: r["vector"] for r in graph.fastrp(edges, "w", size=32, weights=(0.0, 1.0)).collect()}
    signs = lambda v: [(x > 0) - (x < 0) for x in v]
    mean = [0.75 * a + 0.25 * b for a, b in zip(signs(start[2]), signs(start[3]))]
    norm = sum(x * x for x in mean) ** 0.5
    assert round_one[1] == pytest.approx([x / norm for x in mean])
    assert graph.fastrp(edges, size=4, weights=(0.0,)).filter(F.exists("vector", lambda x: x != 0)).count() == 0
