"""Communities by modularity."""

import itertools

from tidemark.operators import graph


def clique(first, n):
    return [(first + i, first + j, 1.0) for i, j in itertools.combinations(range(n), 2)]


def groups(spark, edges):
    frame = spark.createDataFrame(edges, "src long, dst long, w double")
    found = graph.louvain(frame, "w")
    return {r["id"]: r["community"] for r in found.collect()}, graph.modularity(frame, found, "w").first()[0]


def plain_modularity(edges, label):
    m = sum(w for *_, w in edges)
    degree, inner = {}, 0.0
    for a, b, w in edges:
        inner += w * (label[a] == label[b])
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0.0) + w
    return inner / m - sum(d * d for d in degree.values()) / (4 * m * m)


def test_two_cliques_and_a_bridge(spark):
    edges = [*clique(1, 5), *clique(11, 5), (1, 11, 1.0)]
    label, quality = groups(spark, edges)
    assert label == {i: 1 if i < 10 else 11 for i in [*range(1, 6), *range(11, 16)]}
    assert abs(quality - plain_modularity(edges, label)) < 1e-9


def test_ring_of_cliques(spark):
    edges = [e for k in range(6) for e in clique(10 * k, 5)] + [(10 * k + 4, 10 * ((k + 1) % 6), 1.0) for k in range(6)]
    label, quality = groups(spark, edges)
    assert label == {10 * k + i: 10 * k for k in range(6) for i in range(5)}
    assert abs(quality - plain_modularity(edges, label)) < 1e-9


def test_large_graphs_move_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", 3)
    edges = [*clique(1, 4), *clique(11, 4), (1, 11, 1.0)]
    label, _ = groups(spark, edges)
    assert label == {i: 1 if i < 10 else 11 for i in [*range(1, 5), *range(11, 15)]}


def test_modularity_on_tables_is_at_least_label_propagations(spark):
    from tests.helpers import SMALL, duck
    from tidemark.plans.lineage import cut
    from tidemark.plans.relations import SHARED, small_edges

    edges = cut(small_edges(spark, SMALL))
    plain = [tuple(r) for r in duck(f"WITH {SHARED} SELECT src, dst, w FROM s WHERE src < dst", SMALL).itertuples(index=False)]
    score = lambda frame: plain_modularity(plain, {r["id"]: r["community"] for r in frame.collect()})
    assert score(graph.louvain(edges, "shared")) >= score(graph.communities(edges, "shared")) - 1e-9
