"""Inverted lists against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vector_index as I

SHAPE = "id long, embedding array<float>"


def brute(rows, queries, k):
    """query -> [(id, cosine)] by one product of matrices."""
    fine = [(i, np.array(e, float)) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    ids, m = [i for i, _ in fine], np.array([e / np.linalg.norm(e) for _, e in fine])
    out = {}
    for q, e in queries:
        c = np.round(m @ (np.array(e, float) / np.linalg.norm(e)), 6)
        out[q] = sorted(zip(ids, c.tolist()), key=lambda h: (-h[1], h[0]))[:k]
    return out


def made(spark, tmp_path, rows, **how):
    I.build(spark.createDataFrame(rows, SHAPE), f"{tmp_path}/i", **how)
    return f"{tmp_path}/i"


def asked(spark, rows):
    return spark.createDataFrame(rows, "query long, embedding array<float>")


def same(hits, want):
    got = {}
    for r in hits.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["cosine"]))
    assert set(got) == set(want)
    for q, rows in got.items():
        assert [c for _, c in rows] == pytest.approx([c for _, c in want[q]], abs=2e-6)
        assert len({i for i, _ in rows} & {i for i, _ in want[q]}) >= len(rows) - 1  # a tie at the sixth place


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    hot = rng.normal(size=24)
    return [(i, (hot + rng.normal(size=24) * 0.05 if i % 3 == 0 else centres[i % 12] + rng.normal(size=24) * 0.6).astype("float32").tolist()) for i in range(1500)]


def test_recall_and_exact_search(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_ROWS", 100)  # the hot list, a third of all rows, is dealt into blocks
    folder = made(spark, tmp_path, rows)
    queries = [(i, e) for i, e in rows if i % 50 == 0]
    q = asked(spark, queries)
    exact = I.search(spark, folder, q, 10)
    same(exact, brute(rows, queries, 10))
    probes = I.probes_needed(spark, folder, q, 10)
    found = I.recall(I.search(spark, folder, q, 10, probes), exact).first()
    lists = spark.read.parquet(f"{folder}/centroids").count()
    assert found["recall"] >= 0.9 and found["queries"] == len(queries) and probes < lists
    assert spark.read.parquet(f"{folder}/lists").count() == len(rows)


def test_vectors_without_direction_repeated_rows_and_small_tables(spark, tmp_path):
    odd = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0]), (8, [float("inf"), 1.0])]
    folder = made(spark, tmp_path, odd)
    assert spark.read.parquet(f"{folder}/lists").count() == len(odd)
    q = [(1, [2.0, 0.0]), (9, [0.0, 0.0]), (10, None)]
    got = [tuple(r) for r in I.search(spark, folder, asked(spark, q), 10).select("query", "id", "cosine", "rank").orderBy("rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (1, 7, -1.0, 3), (1, 7, -1.0, 4)]


def test_empty_index(spark, tmp_path):
    folder = made(spark, tmp_path, [])
    q = asked(spark, [(1, [1.0, 0.0])])
    assert I.search(spark, folder, q, 3).count() == 0 and I.search(spark, folder, q, 3, 2).count() == 0
    assert I.probes_needed(spark, folder, q, 3) == 1


def test_a_search_reads_the_folders_of_its_lists(spark, tmp_path, rows):
    folder = made(spark, tmp_path, rows)
    plan = I.search(spark, folder, asked(spark, [rows[0]]), 3, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "list#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_low_confidence_keeps_three(spark):
    hits = spark.createDataFrame([(1, i, c, i) for i, c in ((1, 0.9), (2, 0.4), (3, 0.39))] + [(2, i, 0.4 - i / 10, i) for i in range(1, 5)], "query long, id long, cosine double, rank int")
    got = I.confident(hits).groupBy("query", "low_confidence").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {(r["query"], r["low_confidence"], *r["ids"]) for r in got} == {(1, False, 1, 2), (2, True, 1, 2, 3)}
