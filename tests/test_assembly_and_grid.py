"""Feature assembly against numpy, before and after loading; grids of clusterings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import assembly, grid

NAN, INF = float("nan"), float("inf")
ROWS = [(1, 2.0, 7.0, [1.0, 5.0], 3), (2, 4.0, 7.0, [2.0, NAN], 3), (3, None, 7.0, None, 1), (4, 10.0, 7.0, [INF, 1.0], None), (5, NAN, 7.0, [0.5], 2)]
SHAPE = "id long, a double, flat double, e array<double>, community int"


def numpy_way(values, scaler, weight):
    x = np.array([0.0 if v is None else v for v in values], float)
    fine = x[np.isfinite(x)]
    low, middle, high = np.percentile(fine, [25, 50, 75])
    centre, width = {"standard": (fine.mean(), fine.std()), "minmax": (fine.min(), np.ptp(fine)), "robust": (middle, high - low)}[scaler]
    return [weight * (v - centre) / width if math.isfinite(v) and width else 0.0 for v in x]


@pytest.mark.parametrize("scaler", assembly.SCALERS)
def test_groups_are_scaled_and_weighted(spark, tmp_path, scaler):
    rows = spark.createDataFrame(ROWS, SHAPE)
    groups = {"stats": ["a", "flat"], "content": assembly.elements("e", 2), "hot": assembly.one_hot(rows, "community", 4)}
    model = assembly.fit(rows, groups, scaler, {"content": 0.5})
    get = lambda i: [None if r[3] is None or len(r[3]) <= i else r[3][i] for r in ROWS]
    hot = [[float((r[4] or 0) == v) for r in ROWS] for v in (3, 0, 1, 2)]  # by count, then value
    columns = [([r[1] for r in ROWS], 1), ([7.0] * 5, 1), (get(0), 0.5), (get(1), 0.5), *((h, 1) for h in hot)]
    want = np.array([numpy_way(v, scaler, w) for v, w in columns]).T
    model.save(f"{tmp_path}/m")
    for m in (model, assembly.Assembly.load(f"{tmp_path}/m")):
        got = m.apply(rows).orderBy("id")
        assert np.allclose([r["features"].toArray() for r in got.collect()], want)
        assert got.columns == ["id", "a", "flat", "e", "community", "stats", "content", "hot", "features"]


def test_later_rows_lost_columns_and_an_empty_table(spark):
    rows = spark.createDataFrame(ROWS, SHAPE)
    model = assembly.fit(rows, {"stats": ["a"], "content": assembly.elements("e", 1)})
    later = model.apply(spark.createDataFrame([(9, 4.0)], "id long, a double")).first()
    assert later["stats"][0] == pytest.approx(0.0) and later["content"][0] == pytest.approx(-0.875 / np.std([1, 2, 0, 0.5]))
    nothing = assembly.fit(rows.limit(0), {"stats": ["a"]})
    assert nothing.apply(rows.limit(0)).count() == 0 and [r["features"][0] for r in nothing.apply(rows).collect()] == [0.0] * 5


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = [(0, 0), (8, 0), (0, 8)]
    rows = [(i, [float(c + x) for c, x in zip(centres[i % 3], rng.normal(size=2) * 0.4)]) for i in range(90)]
    return spark.createDataFrame([*rows, (90, [30.0, 30.0])], "id long, embedding array<double>")


def test_a_grid_with_a_failed_trial(spark, blobs):
    trials = [("kmeans", p) for p in grid.parameter_grid({"k": [2, 4, 500]})] + [("dbscan", p) for p in grid.parameter_grid({"eps": [1.5], "least": [4, 200]})] + [("unknown", {})]
    related = spark.createDataFrame([(0, 3), (3, 0), (1, 4), (0, 1), (0, 90)], "a long, b long")
    rows = {r["trial"]: r for r in grid.judged(grid.search(blobs, trials, related), 3, 0.2, 10, 0.5).collect()}
    assert [rows[i]["clusters"] for i in range(1, 7)] == [2, 4, 0, 3, 0, 0]
    assert "500" in rows[3]["failure"] and rows[6]["failure"] and rows[3]["noise"] == 1.0 and rows[1]["failure"] is None
    assert rows[4]["noise"] == pytest.approx(1 / 91, abs=1e-6) and rows[4]["split"] == pytest.approx(1 / 3, abs=1e-4) and rows[4]["silhouette"] > 0.8
    assert rows[5]["noise"] == 1.0 and rows[5]["silhouette"] is None
    assert [i for i in rows if rows[i]["passed"]] == [4]  # three clusters are the most reached within the limits
    assert grid.best(spark.createDataFrame(list(rows.values()), grid.TRIAL + ", passed boolean")).first()["trial"] == 4


def test_trials_that_decompose_at_the_same_time(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(120)]
    trials = [("dbscan", {"eps": e, "least": 3}) for e in (5.0, 5.5, 6.0, 6.5)]
    got = grid.search(spark.createDataFrame(rows, "id long, embedding array<double>"), trials).collect()
    assert [r["failure"] for r in got] == [None] * 4


def test_ties_and_no_trial(spark):
    shape = grid.TRIAL + ", passed boolean"
    rows = [(i, "kmeans", "{}", k, noise, 0.5, None, None, split, 1.0, None, ok) for i, k, noise, split, ok in ((1, 3, 0.1, 0.2, True), (2, 3, 0.1, 0.1, True), (3, 4, 0.1, 0.1, True), (4, 9, 0.0, 0.0, False))]
    assert grid.best(spark.createDataFrame(rows, shape)).first()["trial"] == 3
    assert grid.best(spark.createDataFrame(rows[3:], shape)).count() == 0
    assert grid.judged(spark.createDataFrame([], grid.TRIAL), 3, 0.2, 2).count() == 0


def test_trials_share_the_neighbours_of_all_radii(spark, blobs, monkeypatch):
    calls, counted = [], grid.L.tiles.counted
    monkeypatch.setattr(grid.L.tiles, "counted", lambda rows, *radii: (calls.append(radii), counted(rows, *radii))[1])
    trials = [("dbscan", p) for p in grid.parameter_grid({"eps": [1.5, 1, 40.0], "least": [4, 200]})] + [("dbscan", {"eps": None, "least": 4}), ("dbscan", {"eps": 1.0})]
    rows = {r["trial"]: r for r in grid.search(blobs, trials).collect()}
    assert calls == [(1.0, 1.5, 40.0)]
    for i, (_, p) in enumerate(trials[:6], 1):
        alone = grid.L.dbscan(blobs, float(p["eps"]), p["least"]).filter("cluster >= 0").agg(F.countDistinct("cluster").alias("k"), F.count("*").alias("n")).first()
        assert (rows[i]["clusters"], rows[i]["noise"], rows[i]["failure"]) == (alone["k"], pytest.approx(1 - alone["n"] / 91, abs=1e-6), None)
    assert rows[7]["failure"] and rows[8]["failure"]
