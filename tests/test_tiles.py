"""Pairs in tiles against all pairs, and how many rows the tiles give."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import density, learning, tiles

SHAPE = "id long, embedding array<double>"


def brute(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def crowded(n=900, hot=300, size=16):
    """Evenly spread directions, and a crowd of near copies."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, size))
    x[:hot] = x[0] + rng.normal(size=(hot, size)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x[rng.permutation(n)]


@pytest.fixture
def many_groups(monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 200)


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SHAPE).repartition(3)


def test_dbscan_gives_links_not_pairs(spark, many_groups):
    x = crowded()
    eps, least = 0.7, 6
    d = brute(x)
    near = d <= eps
    core = near.sum(axis=1) >= least
    name = np.where(core, np.arange(len(x)), len(x))
    while True:
        step = np.where(core, np.where(near & core[None, :], name[None, :], len(x)).min(axis=1), len(x))
        if (step == name).all():
            break
        name = step
    want = {i: int(name[i]) if core[i] else min(((d[i, j], int(name[j])) for j in np.nonzero(near[i] & core)[0]), default=(0, -1))[1] for i in range(len(x))}
    assert {r["id"]: r["cluster"] for r in learning.dbscan(frame(spark, x), eps, least).collect()} == want
    marked = frame(spark, x).withColumn("core", F.lit(True))
    links = tiles.linked(marked, marked.drop("core"), eps)
    assert len(links.collect()) < 2 * len(x) * tiles.groups(len(x)) < int(near.sum()) - len(x)


def test_distances_of_evenly_spread_vectors(spark, many_groups):
    x = np.concatenate([crowded(), np.zeros((3, 16)), np.eye(16)])
    want = np.sort(brute(x), axis=1)
    same = learning.distinct_vectors(frame(spark, x))
    for k in (1, 5, 250):
        got = {r["id"]: r["d"] for r in learning.kth_nearest(same, k).collect()}
        assert all(got[i] == pytest.approx(want[i, k], abs=1e-12) for i in got) and len(got) == len(x) - 2
    assert len(tiles.neighbours(same, same, 5).collect()) <= 5 * len(x) * tiles.groups(len(x))


def test_vectors_of_other_lengths_and_far_from_zero(spark):
    rows = [(1, [1e6, 1e6]), (2, [1e6 + 0.001, 1e6]), (3, [1e6, 1e6 + 0.003]), (4, [1e6]), (5, [1e6 + 0.001])]
    same = learning.distinct_vectors(spark.createDataFrame(rows, SHAPE))
    got = {r["id"]: round(r["d"], 9) for r in learning.kth_nearest(same, 1).collect()}
    assert got == {1: 0.001, 2: 0.001, 3: 0.003, 4: 0.001, 5: 0.001}


def test_spanning_tree_of_a_crowd_and_scattered_vectors(spark, many_groups):
    """Most vectors are joined by later rounds, which look among all."""
    x, k = crowded(700, 250), 5
    d = brute(x)
    core = np.sort(d, axis=1)[:, k]
    w = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    best, at, total = np.full(len(x), np.inf), 0, []
    left = np.ones(len(x), bool)
    for _ in range(len(x) - 1):  # Prim
        left[at] = False
        best = np.minimum(best, w[at])
        at = int(np.argmin(np.where(left, best, np.inf)))
        total.append(best[at])
    tree = density.spanning_tree(frame(spark, x), k).collect()
    assert sorted(r["w"] for r in tree) == pytest.approx(sorted(total), abs=1e-12)
    points = density.core_distances(frame(spark, x), k).select("id", "embedding", "core")
    assert len(tiles.reach_links(points, 3.0).collect()) < 2 * len(x) * tiles.groups(len(x))


def test_silhouette_is_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5400, 3))
    label = np.arange(len(x)) % 3
    x[:, 0] += label
    label[5000:] = rng.integers(0, 3, 400)
    label[7] = 3  # alone
    label[8] = -1
    fine = label >= 0
    d, labels = brute(x[fine]), label[fine]
    sums = np.stack([d[:, labels == c].sum(axis=1) for c in range(4)], axis=1)
    size = np.bincount(labels)
    value = []
    for i, own in enumerate(labels):
        if size[own] == 1:
            value.append(0.0)
            continue
        inner, outer = sums[i, own] / (size[own] - 1), min(sums[i, c] / size[c] for c in range(4) if c != own)
        value.append((outer - inner) / max(inner, outer))
    rows = spark.createDataFrame([(i, int(c), v) for i, (c, v) in enumerate(zip(label, x.tolist(), strict=True))], "id long, label int, embedding array<double>")
    assert learning.silhouette(rows).first()[0] == pytest.approx(math.fsum(value) / len(value), abs=1e-4)


def test_search_gives_few_rows_of_each_tile(spark, tmp_path, many_groups):
    from tidemark.operators import vector_index

    x = crowded(600, 200)
    vector_index.build(frame(spark, x), f"{tmp_path}/i", lists=9)
    asked = frame(spark, x[::7]).withColumnRenamed("id", "query")
    c = np.round(x[::7] @ x.T, 6)
    want = {(q, rank): round(float(c[q, i]), 5) for q in range(len(c)) for rank, i in enumerate(np.lexsort((np.arange(len(x)), -c[q]))[:4], 1)}
    for probes in (None, 9):
        hits = vector_index.search(spark, f"{tmp_path}/i", asked, 4, probes)
        assert {(r["query"], r["rank"]): round(r["cosine"], 5) for r in hits.collect()} == pytest.approx(want, abs=1.1e-5)
        assert "zip_with" not in hits._jdf.queryExecution().optimizedPlan().toString()
    few = vector_index.search(spark, f"{tmp_path}/i", asked, 4, 2)
    assert few.count() == 4 * len(c) and few.groupBy("query").agg(F.countDistinct("list").alias("n")).agg(F.max("n")).first()[0] <= 2


def test_a_frame_meets_itself_once(spark, many_groups):
    x = crowded()
    rows = frame(spark, x)

    def pairs(a, b):
        n = len(a) * len(b) if tiles.two_groups(a) else len(a) * (len(a) - 1) // 2
        return pa.table({"pairs": pa.array([n], pa.int64())})

    met = [r["pairs"] for r in tiles.met_once(rows, pairs, "pairs long").collect()]
    g = tiles.groups(len(x))
    assert len(met) == g * (g + 1) // 2 and sum(met) == len(x) * (len(x) - 1) // 2


@pytest.mark.parametrize("own", [True, False])
def test_both_sides_of_a_tile_of_many_strips(monkeypatch, own):
    """The tasks' work itself, over strips that end within labels and rows."""
    for name, value in {"STRIP": 8, "WIDE": 12, "kind": lambda _: ("long", pa.int64())}.items():
        monkeypatch.setattr(tiles, name, value)
    works = []
    monkeypatch.setattr(tiles, "met_once", lambda rows, work, schema: works.append(work))
    rng = np.random.default_rng(7)
    x, label, n = rng.normal(size=(90, 5)), rng.integers(0, 6, 90), rng.integers(1, 4, 90)
    x[80:] = x[0]
    parts = [np.arange(90), np.arange(90)] if own else [np.arange(0, 90, 2), np.arange(1, 90, 2)]
    sides = [pa.table({"id": p, "embedding": pa.array(x[p].tolist()), "label": label[p], "n": n[p], "_g": np.zeros(len(p), "int32"), "_h": np.full(len(p), int(not own), "int32")}) for p in parts]
    both = [parts] if own else [parts, parts[::-1]]
    d = brute(x)
    tiles.label_sums(None), tiles.counted(None, 2.0), tiles.neighbours(None, None, 3)
    sums, near, nearest = (work(*sides).to_pylist() for work in works)
    want = {}
    for p, q in both:
        for i in p:
            for g in set(label[q]):
                others = [j for j in q if label[j] == g and j != i]
                want |= {(i, label[i], g): (d[i, others].sum(), len(others))} if others else {}
    got = {(r["a"], r["la"], r["lb"]): (r["s"], r["n"]) for r in sums}
    assert len(sums) == len(got) and got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-6) and got[k][1] == want[k][1] for k in want)
    assert {r["id"]: r["near"] for r in near} == {i: m for p, q in both for i in p if (m := int(sum(n[j] for j in q if j != i and d[i, j] <= 2.0)))}
    for p, q in both:
        for i in p:
            ranked = sorted(d[i, j] for j in q if j != i)[:3]
            assert sorted(r["d"] for r in nearest if r["a"] == i) == pytest.approx(ranked, abs=1e-12)


@pytest.mark.parametrize("own", [True, False])
def test_links_of_tiles_that_meet_once(monkeypatch, own):
    """Pairs are handed on in parts, rows that are no cores stand on either side, and several radii are counted together."""
    for name, value in {"FINE": 8, "FINE_WIDE": 12, "HELD": 20, "kind": lambda _: ("long", pa.int64())}.items():
        monkeypatch.setattr(tiles, name, value)
    works = []
    monkeypatch.setattr(tiles, "met_once", lambda rows, work, schema: works.append(work))
    rng = np.random.default_rng(8)
    x, core, n = rng.normal(size=(90, 4)), rng.random(90) < 0.6, rng.integers(1, 4, 90)
    x[80:] = x[0]
    parts = [np.arange(90), np.arange(90)] if own else [np.arange(0, 90, 2), np.arange(1, 90, 2)]
    sides = [pa.table({"id": p, "embedding": pa.array(x[p].tolist()), "core": core[p], "n": n[p], "_g": np.zeros(len(p), "int32"), "_h": np.full(len(p), int(not own), "int32")}) for p in parts]
    both = [parts] if own else [parts, parts[::-1]]
    d = brute(x)
    tiles.linked_once(None, 1.5), tiles.counted(None, 0.0, 1.0, 2.0)
    links, near = (work(*sides).to_pylist() for work in works)
    edges = {(r["a"], r["b"]): r["d"] for r in links if r["d"] is not None}
    assert edges == {(i, j): pytest.approx(d[i, j], abs=1e-12) for p, q in both for i in p for j in q if i != j and d[i, j] <= 1.5 and core[j] and not core[i]}
    assert len(edges) == sum(r["d"] is not None for r in links) > 20
    pairs = [(i, j) for i in parts[0] for j in parts[1] if i != j and d[i, j] <= 1.5 and core[i] and core[j]]
    root = [tiles.united(np.arange(90), *np.array(ab).T) for ab in (pairs, [(r["a"], r["b"]) for r in links if r["d"] is None])]
    assert (root[0] == root[1]).all()
    want = {(i, r): m for r in (0.0, 1.0, 2.0) for p, q in both for i in p if (m := int(sum(n[j] for j in q if j != i and d[i, j] <= r)))}
    assert {(r["id"], r["radius"]): r["near"] for r in near} == want and len(near) == len(want)


def test_dbscan_of_equal_vectors_and_of_vectors_with_nulls(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.5, 0.0]), (4, [9.0, 9.0]), (5, None), (6, [0.0, None])]
    for ids, want in (({1, 2, 3, 4, 5, 6}, {1: 1, 2: 1, 3: 1, 4: -1, 5: -1, 6: -1}), ({1, 3, 4, 6}, {1: -1, 3: -1, 4: -1, 6: -1})):
        some = spark.createDataFrame([r for r in rows if r[0] in ids], SHAPE)
        assert {r["id"]: r["cluster"] for r in learning.dbscan(some, 1.0, 3).collect()} == want
