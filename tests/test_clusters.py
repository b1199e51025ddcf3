"""Serving of clusters on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters as K
from tidemark.operators import graph


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_lookup_finds_names_in_any_case_and_rejects_noise(spark):
    members = spark.createDataFrame([("Kubernetes", 1), ("kubernetes", -1), ("React", -1), ("Postgres", 2), (None, 3)], "name string, label int")
    asked = spark.createDataFrame([("KUBERNETES",), (" kubernetes ",), ("kubernets",), ("react",), ("reactt",), ("postgress",), ("zzz",), ("",), (None,), ("zzz",)], "name string")
    got = K.lookup(asked, members)
    assert rows(got, "name", "matched", "label", "status") == sorted(
        [("KUBERNETES", "kubernetes", 1, "found"), (" kubernetes ", "kubernetes", 1, "found"), ("kubernets", "kubernetes", 1, "provisional"), ("react", "react", -1, "found"), ("reactt", None, None, "missing"),
         ("postgress", "postgres", 2, "provisional"), ("zzz", None, None, "missing"), ("", None, None, "missing"), (None, None, None, "missing")], key=repr)
    assert tuple(K.batch_counts(got).first()) == (9, 3, 2, 4)
    assert tuple(K.batch_counts(K.lookup(asked.limit(0), members)).first()) == (0, 0, 0, 0)


def test_context_counts_pairs_once_and_breaks_ties_by_user(spark):
    members = spark.createDataFrame([("a", 0), ("b", 0), ("c", -1)], "name string, label int")
    users = spark.createDataFrame([("u", "a"), ("u", "a"), ("v", "a"), ("v", "b"), ("t", "b"), ("w", "c")], "user string, name string")
    assert rows(K.context(members, users, "job", 2), "label", "kind", "user", "n", "rank") == [(0, "job", "t", 1, 2), (0, "job", "v", 2, 1)]


def test_temporal_defaults(spark):
    day = lambda d: dt.date(2026, 1, d)
    m = spark.createDataFrame([("a", day(1), 0.5), ("a", day(9), None), ("a", day(10), 0.1), ("b", None, 0.9), ("c", day(5), None)], "name string, day date, sentiment double")
    got = {r["name"]: tuple(r)[1:] for r in K.temporal(m, F.lit(day(11))).collect()}
    assert got["b"] == (-1, -1, 0.0, 0.0) and got["c"] == (6, 6, None, 0.0)
    assert got["a"][:2] == (10, 1) and got["a"][3] == pytest.approx(0.3) and got["a"][2] == pytest.approx(1.652, abs=1e-3)


def test_categories_and_pending_names(spark):
    nodes = spark.createDataFrame([(f"n{i:03}", "x" if i == 0 else " " if i == 1 else None) for i in range(120)], "name string, category string")
    given = spark.createDataFrame([("n000", ""), ("n002", "b"), ("n002", "a"), ("lost", "c"), ("n003", None)], "name string, category string")
    now = K.categorised(nodes, given)
    assert {r["name"]: r["category"] for r in now.filter("trim(category) <> ''").collect()} == {"n000": "x", "n002": "a"}
    chunks = K.pending(now).groupBy("chunk").agg(F.count("*").alias("n"), F.min("name").alias("m")).orderBy("chunk").collect()
    assert [(r["chunk"], r["n"], r["m"]) for r in chunks] == [(0, 50, "n001"), (1, 50, "n052"), (2, 18, "n102")]  # n001, then n003 on


def test_first_categories_and_edges_between(spark):
    merges = spark.createDataFrame([("js", "JavaScript"), ("ecma", "JavaScript"), ("py", "Python"), ("go", "Go")], "name string, canonical string")
    known = spark.createDataFrame([("js", "web"), ("ecma", "script"), ("py", "other"), ("Python", "language"), ("go", " ")], "name string, category string")
    assert rows(K.first_categories(merges, known), "canonical", "category") == [("Go", None), ("JavaScript", "script"), ("Python", "language")]
    edges = spark.createDataFrame([(1, 2, "A"), (1, 2, "B"), (2, 1, "A"), (1, 3, "A")], "src long, dst long, type string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (9, 9)], "src long, dst long")
    assert rows(graph.edges_between(edges, pairs), "src", "dst", "type") == [(1, 2, "A"), (1, 2, "B")]
