"""Density clustering against plain loops over all pairs."""

import math
import random

import pytest

from tidemark.operators import density


def points(seed=3, spread=(0.05, 0.4, 0.15), each=14, noise=10):
    rng = random.Random(seed)
    out = []
    for k, s in enumerate(spread):
        out += [[3.0 * k + rng.gauss(0, s), (k % 2) * 2 + rng.gauss(0, s), rng.gauss(0, s)] for _ in range(each)]
    out += [[rng.uniform(-2, 9), rng.uniform(-2, 5), rng.uniform(-2, 2)] for _ in range(noise)]
    out += [out[0], out[0], out[-1]]  # equal vectors
    return {i + 1: v for i, v in enumerate(out)}


def brute_tree(rows, k):
    k = min(k, len(rows) - 1)
    core = {a: sorted(math.dist(v, w) for b, w in rows.items() if a != b)[k - 1] for a, v in rows.items()}
    edges = sorted((max(core[a], core[b], math.dist(rows[a], rows[b])), a, b) for a in rows for b in rows if a < b)
    over, tree = {a: a for a in rows}, []

    def find(x):
        while over[x] != x:
            x = over[x]
        return x

    for w, a, b in edges:
        if find(a) != find(b):
            over[find(b)] = find(a)
            tree.append((a, b, w))
    return tree


class Node:
    """A node of the whole dendrogram: two halves that part at lambda, or a point."""

    def __init__(self, members, at=math.inf, halves=()):
        self.members, self.at, self.halves = members, at, halves


def brute_labels(tree, ids, least, method):
    """Top down: the dendrogram is walked from the root, clusters are the parts of ``least`` points or more."""
    home = {i: Node([i]) for i in ids}
    for a, b, w in sorted(tree, key=lambda e: (e[2], e[0], e[1])):
        one, two = home[a], home[b]
        new = Node(one.members + two.members, 1 / w, (one, two))
        for i in new.members:
            home[i] = new
    root = home[next(iter(ids))]
    clusters = []  # birth, exits {point: lambda}, children, parent

    def grow(node, birth, parent):
        own = {"birth": birth, "exits": {}, "children": [], "parent": parent, "size": len(node.members), "split": None}
        clusters.append(own)
        while True:
            big = [h for h in node.halves if len(h.members) >= least]
            if len(big) == 1:
                own["exits"].update({i: node.at for h in node.halves if h is not big[0] for i in h.members})
                node = big[0]
                continue
            if len(big) == 2:
                own["split"] = node.at
                own["children"] = [grow(h, node.at, own) for h in node.halves]
            else:
                own["exits"].update({i: node.at for i in node.members})
            return own

    if len(root.members) >= least:
        grow(root, 0.0, None)

    def stability(c):
        return sum(x - c["birth"] for x in c["exits"].values()) + sum(k["size"] * (c["split"] - c["birth"]) for k in c["children"])

    def best(c):
        below = sum(best(k) for k in c["children"])
        c["wins"] = (not c["children"]) if method == "leaf" else not c["children"] or stability(c) >= below
        return max(stability(c), below) if c["children"] else stability(c)

    def deepest(c):
        return max([*c["exits"].values(), *([c["split"]] if c["split"] else []), *(deepest(k) for k in c["children"])])

    if clusters:
        best(clusters[0])
        clusters[0]["wins"] = False
    out = {}
    for c in clusters:
        chain, at = [], c
        while at:
            chain.append(at)
            at = at["parent"]
        top = next((k for k in reversed(chain) if k["wins"]), None)
        for i, x in c["exits"].items():
            most = max([*top["exits"].values(), *([top["split"]] if top["split"] else [])]) if top else 0
            out[i] = (top, min(x, most) / most if top else 0.0, (deepest(c) - x) / deepest(c))
    first = {}
    for i, (top, _, _) in out.items():
        if top is not None:
            first[id(top)] = min(i, first.get(id(top), i))
    names = {k: n for n, (k, _) in enumerate(sorted(first.items(), key=lambda kv: kv[1]))}
    return {i: (names[id(t)] if t is not None else -1, p, o) for i, (t, p, o) in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, embedding array<double>").repartition(3)


def result(out):
    return {r["id"]: (r["label"], r["probability"], r["outlier"]) for r in out.collect()}


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(brute_tree(points(), 4), "a long, b long, w double")


@pytest.mark.parametrize("few", [1_000_000, 3])
def test_spanning_tree_is_the_lightest(spark, few, monkeypatch):
    """Also by rounds that join components in parallel."""
    monkeypatch.setattr(density, "FEW_LINKS", few)
    rows = points(each=6, noise=3)
    found = sorted(r["w"] for r in density.spanning_tree(frame(spark, rows), 3).collect())
    assert found == pytest.approx(sorted(w for *_, w in brute_tree(rows, 3)))


@pytest.mark.parametrize("method,bucket", [("eom", 1_000_000), ("leaf", 1_000_000), ("eom", 30)])
def test_labels_probabilities_and_outliers_equal_a_walk_from_the_root(spark, tree, method, bucket, monkeypatch):
    """Also when the tree is worked on in many buckets."""
    monkeypatch.setattr(density, "BUCKET", bucket)
    edges = [(r["a"], r["b"], r["w"]) for r in tree.collect()]
    want = brute_labels(edges, list(points()), 5, method)
    got = result(density.hdbscan(frame(spark, points()), 5, 4, method, tree))
    assert set(got) == set(want) and len({x for x, *_ in want.values()}) == 4  # three clusters and noise
    for i, row in want.items():
        assert got[i] == pytest.approx(row), i


def test_vectors_that_are_none_too_few_and_all_equal(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 0.0]), (4, [5.0, 5.0])], "id long, embedding array<double>")
    assert {i: (x, p) for i, (x, p, _) in result(density.hdbscan(rows, 5)).items()} == {i: (-1, 0.0) for i in (1, 2, 3, 4)}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(8)], "id long, embedding array<double>")
    assert {x for x, _, _ in result(density.hdbscan(same, 3)).values()} == {-1}  # only the cluster of all rows


def brute_validity(edges, labels):
    most = max(w for *_, w in edges)
    score = 0.0
    for c in {x for x in labels.values() if x >= 0}:
        sparse = max([w for a, b, w in edges if labels[a] == labels[b] == c], default=0.0)
        apart = min([w for a, b, w in edges if labels[a] != labels[b] and c in (labels[a], labels[b]) and min(labels[a], labels[b]) >= 0], default=2 * most)
        score += sum(x == c for x in labels.values()) * (apart - sparse) / max(apart, sparse)
    return score / len(labels)


def test_validity_equals_plain_loops(spark, tree):
    edges = [(r["a"], r["b"], r["w"]) for r in tree.collect()]
    labels = {i: (i * 7 % 5) - 1 if i > 30 else i // 11 for i in points()}
    row = density.validity(tree, spark.createDataFrame(list(labels.items()), "id long, label int")).first()
    sizes = sorted(sum(x == c for x in labels.values()) for c in range(4))
    assert row["dbcv"] == pytest.approx(brute_validity(edges, labels), abs=1e-6)
    assert (row["clusters"], row["noise_ratio"], row["least_size"], row["most_size"], row["median_size"]) == (4, round(sum(x < 0 for x in labels.values()) / len(labels), 6), sizes[0], sizes[-1], (sizes[1] + sizes[2]) / 2)
    none = density.validity(tree, spark.createDataFrame([(i, -1) for i in labels], "id long, label int")).first()
    assert (none["clusters"], none["noise_ratio"], none["dbcv"]) == (0, 1.0, None)
