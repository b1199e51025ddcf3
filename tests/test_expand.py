"""Edges around seeds against all paths of small graphs."""

import random

import pytest

from tidemark.operators import graph


def expand_brute(edges, seeds, depth):
    found, paths = set(), [(s, ()) for s in seeds]
    for hop in range(1, depth + 1):
        paths = [(y, (*path, e)) for at, path in paths for e in edges if e not in path for x, y in (e, e[::-1]) if x == at]
        found |= {(*e, hop) for _, path in paths for e in path}
    return found


@pytest.mark.parametrize("seed", range(4))
def test_expand_equals_all_paths(spark, seed):
    draw = random.Random(seed)
    names = "abcdefgh"[: 4 + seed]
    edges = {(draw.choice(names), draw.choice(names)) for _ in range(4 + 2 * seed)} | {("a", "b"), ("x", "y"), ("y", "x"), ("y", "z")}
    if seed == 3:
        edges |= {("hub", f"n{i}") for i in range(12)} | {("a", "hub"), ("n1", "n2")}
    seeds = ["a", "x"] if seed % 2 else ["a"]
    got = graph.expand(spark.createDataFrame(sorted(edges) * 2, "src string, dst string"), spark.createDataFrame([(s,) for s in seeds * 2], "id string"), 3, None).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expand_brute(sorted(edges), seeds, 3)
