"""Operators on small frames."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gold, graph, learning, serving
from tidemark.sources import sinks


def month(text):
    return dt.date.fromisoformat(text)


def test_analytics_compares_jobs_with_articles_of_months_without_jobs(spark):
    jobs = spark.createDataFrame([("x", month("2026-05-01"), 1)], "tech string, month date, job_count long")
    articles = spark.createDataFrame([("x", month("2026-04-01"), 1)], "tech string, month date, article_count long")
    snapshot = spark.createDataFrame([("x", 3), ("y", 5)], "tech string, job_count long")
    now = spark.createDataFrame([(month("2026-06-01"),)], "as_of date")
    rows = {(r["tech"], str(r["month"])): r for r in gold.tech_analytics(jobs, articles, snapshot, now).collect()}
    assert rows["x", "2026-05-01"]["mom_growth"] == 0.0
    assert rows["x", "2026-06-01"]["job_count"] == 3 and rows["x", "2026-06-01"]["mom_growth"] == 200.0
    assert rows["y", "2026-06-01"]["ranking"] == 1 and rows["x", "2026-06-01"]["ranking"] == 2
    assert rows["x", "2026-05-01"]["ranking"] is None


def test_growth_of_sparse_months_never_skips(spark):
    s = spark.createDataFrame([("x", month("2026-01-01"), 10), ("x", month("2026-03-01"), 20)], "tech string, month date, v long")
    assert [r["mom_growth"] for r in gold.with_growth(s, "v").orderBy("month").collect()] == [0.0, 0.0]


def path_graph(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")


def test_shortest_path_and_components(spark):
    assert graph.shortest_path(path_graph(spark), "a", "d") == ["a", "b", "c", "d"]
    assert graph.shortest_path(path_graph(spark), "a", "y") is None
    assert {(r["id"], r["component"]) for r in graph.connected(path_graph(spark)).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}


def test_expand_uses_no_edge_twice(spark):
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r["src"], r["dst"], r["hop"]) for r in graph.expand(path_graph(spark), seeds, 2).collect()} == {("a", "b", 1), ("a", "b", 2), ("b", "c", 2)}


def test_pagerank_of_a_pair_is_even(spark):
    e = spark.createDataFrame([("x", "y")], "src string, dst string")
    assert {r["id"]: round(r["pagerank"], 6) for r in graph.pagerank(e, rounds=5).collect()} == {"x": 1.0, "y": 1.0}


def test_communities_find_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 5) for i in range(4) for j in range(i)]
    e = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0", 1)], "src string, dst string, w int")
    c = {r["id"]: r["community"] for r in graph.communities(e, "w").collect()}
    assert len({c[f"a{i}"] for i in range(4)}) == 1 and len({c[f"b{i}"] for i in range(4)}) == 1 and c["a1"] != c["b1"]


def test_merge_redirects_and_drops_loops(spark):
    e = spark.createDataFrame([("a", "b"), ("A", "b"), ("a", "A")], "src string, dst string")
    m = spark.createDataFrame([("A", "a")], "dup string, canonical string")
    once = graph.merge_nodes(e, m)
    assert [tuple(r) for r in once.collect()] == [("a", "b")]
    assert [tuple(r) for r in graph.merge_nodes(once, m).collect()] == [("a", "b")]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "", 2), (3, "c", 2), (3, "d", 3)], "k int, v string, at int")
    assert {tuple(r) for r in serving.upsert(old, new, ["k"], "at").collect()} == {(1, "", 2), (2, "b", 1), (3, "d", 3)}
    assert {tuple(r) for r in serving.upsert(old, new, ["k"], "at", keep=("v",)).collect()} == {(1, "a", 2), (2, "b", 1), (3, "d", 3)}
    assert {tuple(r) for r in serving.insert_absent(old, new, "k", "at").collect()} == {(1, "a", 1), (2, "b", 1), (3, "c", 2)}


def test_first_seen(spark):
    rows = spark.createDataFrame([(1, "h"), (2, "h"), (3, "g")], "id int, h string")
    assert {tuple(r) for r in serving.first_seen(rows, "h", ["id"], "id").collect()} == {(1, "h", False, None), (2, "h", True, 1), (3, "g", False, None)}


def clusters(spark):
    rows = [(i, [float(i % 2) * 10 + (i // 2) * 0.1, 0.0], i % 2) for i in range(10)] + [(99, [100.0, 100.0], -1)]
    return spark.createDataFrame(rows, "id int, embedding array<double>, label int")


def test_dbscan_and_silhouette(spark):
    got = {r["id"]: r["cluster"] for r in learning.dbscan(clusters(spark).select("id", "embedding"), 0.5, 3).collect()}
    assert got[99] == -1 and {got[i] for i in range(0, 10, 2)} == {0} and {got[i] for i in range(1, 10, 2)} == {1}
    assert learning.silhouette(clusters(spark)).first()["silhouette"] > 0.95


def test_spread_against_plain_python(spark):
    pts = {0: [i * 0.1 for i in range(5)], 1: [10 + i * 0.1 for i in range(5)]}
    mean = {k: sum(v) / 5 for k, v in pts.items()}
    whole = sum(map(sum, pts.values())) / 10
    within = sum((x - mean[k]) ** 2 for k, v in pts.items() for x in v)
    between = sum(5 * (mean[k] - whole) ** 2 for k in pts)
    s = {k: sum(abs(x - mean[k]) for x in v) / 5 for k, v in pts.items()}
    row = learning.cluster_spread(clusters(spark)).first()
    assert row["calinski_harabasz"] == pytest.approx(between / (within / 8), rel=1e-3)
    assert row["davies_bouldin"] == pytest.approx((s[0] + s[1]) / abs(mean[0] - mean[1]), abs=1e-3)


def test_tfidf_rows_have_unit_length(spark):
    c = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 1)], "doc string, token string, tf int")
    got = {(r["doc"], r["token"]): r["weight"] for r in learning.tfidf(c).collect()}
    assert got == {("a", "x"): 1.0, ("b", "x"): 1.0}
    got = {(r["doc"], r["token"]): r["weight"] for r in learning.tfidf(c, 1).collect()}
    x, y = 1.0, 2 * (math.log(3 / 2) + 1)
    assert got["a", "y"] == pytest.approx(y / math.hypot(x, y), abs=1e-5)


def test_trial_selection_lowers_the_floor_to_what_was_reached(spark):
    t = spark.createDataFrame([("a", 0.9, 2, 0.1, 0.0, 1.0), ("b", 0.5, 4, 0.1, 0.0, 1.0), ("c", 0.99, 9, 0.9, 0.0, 1.0)], "trial string, metric double, clusters int, noise double, split double, seconds double")
    assert learning.select_trial(t, 10, 0.5, 0.5, 6).first()["trial"] == "b"


def test_outbox_and_soft_delete(spark):
    e = spark.createDataFrame([(1, "PENDING", 0, 3), (2, "FAILED", 5, 1), (3, "FAILED", 1, 2)], "id int, status string, attempts int, created_at int")
    assert [r["id"] for r in sinks.outbox_next(e, 5, 10).collect()] == [3, 1]
    done = {r["id"]: (r["status"], r["attempts"]) for r in sinks.outbox_mark(e, spark.createDataFrame([(1, True), (3, False)], "id int, ok boolean")).collect()}
    assert done == {1: ("PUBLISHED", 0), 2: ("FAILED", 5), 3: ("FAILED", 2)}
    rows = spark.createDataFrame([(1, None), (2, None)], "id int, deleted_at timestamp")
    gone = sinks.soft_delete(rows, spark.createDataFrame([(2,)], "id int"), "id", "2026-01-01 00:00:00")
    assert {r["id"]: r["deleted_at"] is not None for r in gone.collect()} == {1: False, 2: True}


def test_snapshot_is_written_once(spark, tmp_path):
    f = {"t": spark.range(3)}
    sinks.write_snapshot(f, str(tmp_path), "v1")
    assert sinks.read_snapshot(spark, str(tmp_path), "v1", ["t"])["t"].count() == 3
    with pytest.raises(Exception):
        sinks.write_snapshot(f, str(tmp_path), "v1")


def test_export_quotes(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', 1, 2.5)], "technology_name string, job_count int, growth_rate double")
    sinks.export_trends(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"')
    assert back.first()["technology_name"] == 'a "b", c'


def test_checks_report_orphans(spark):
    parent, child = spark.range(3), spark.createDataFrame([(1,), (7,), (None,)], "k long")
    got = {r["check"]: r["n"] for r in serving.checks({"p": (parent, "id", [])}, {"c": (child, parent)}).collect()}
    assert got == {"p.rows": 3, "p.repeated": 0, "p.null_id": 0, "c.orphans": 1}


def test_forecast_needs_three_months(spark):
    s = spark.createDataFrame([("x", month("2026-01-01"), 1, 1.0, 1.0), ("x", month("2026-02-01"), 4, 2.0, 2.0)], "tech string, month date, job_count long, growth_rate double, mom_growth double")
    row = gold.forecast_signals(s).first()
    assert row["slope"] is None and row["job_change"] == 3
    assert s.filter(F.col("tech") == "x").count() == 2


def vectors_with_copies(spark, n=240):
    """Points of three clumps and of noise, with many copies of some, points that lie exactly one grid width apart, and ones that can't be measured."""
    r = random.Random(5)
    rows = [[(k % 3) * 4 + r.gauss(0, 0.4), (k % 3) * 2 + r.gauss(0, 0.4), r.gauss(0, 0.2), r.uniform(0, 1)] for k in range(n)]
    rows += [[0.0, 0.0, 0.0, 0.5]] * 40 + [[20.0 + k, 0.0, 0.0, 0.0] for k in range(6)] + [[-50.0, 1.0, 0.0, 0.0]]
    odd = [None, [1.0, None, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0]]
    return spark.createDataFrame(list(enumerate(rows + odd)), "id long, embedding array<double>"), rows


def test_close_pairs_distances_and_clusters_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(learning, "BLOCK_ROWS", 7)
    frame, rows = vectors_with_copies(spark)
    d = [[math.dist(x, y) for y in rows] for x in rows]
    same = learning.distinct_vectors(frame)
    ids = [r["id"] for r in same.collect()]
    got = [(r["a"], r["b"]) for r in learning.close_pairs(same, same, 1.0, learning.grid_axes(same)).collect()]
    assert sorted(got) == sorted((a, b) for a in ids for b in ids if a != b and d[a][b] <= 1.0)
    for k in (1, 4, 45):
        want = {i: sorted(x for j, x in enumerate(r) if j != i)[k - 1] for i, r in enumerate(d)}
        out = sorted(learning.nearest_distance(frame, k).collect(), key=lambda r: r["rank"])
        assert [r["rank"] for r in out] == list(range(1, len(rows) + 1))
        assert [(r["id"], r["d"]) for r in out] == [(i, x) for x, i in sorted((r["d"], r["id"]) for r in out)]
        assert all(abs(r["d"] - want[r["id"]]) < 2e-6 for r in out) and out[0]["step"] is None
        assert all(abs(y["step"] - (y["d"] - x["d"])) < 1e-9 for x, y in zip(out, out[1:], strict=False))
    eps, least = 0.5, 4
    core = {i for i, r in enumerate(d) if sum(x <= eps for x in r) >= least}
    name = {i: i for i in core}
    for _ in core:
        step = {i: min(name[j] for j in core if d[i][j] <= eps) for i in core}
        if step == name:
            break
        name = step
    want = {i: name[i] if i in core else min(((x, name[j]) for j, x in enumerate(r) if j in core and x <= eps), default=(0, -1))[1] for i, r in enumerate(d)}
    got = {r["id"]: r["cluster"] for r in learning.dbscan(frame, eps, least).collect()}
    assert got == want | {len(rows) + k: -1 for k in range(3)}


def test_distances_of_few_vectors(spark):
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    one = spark.createDataFrame([(3, [1.0, 2.0])], "id long, embedding array<float>")
    assert learning.nearest_distance(empty, 2).count() == 0 and learning.dbscan(empty, 1.0, 2).count() == 0
    assert learning.nearest_distance(one, 1).count() == 0
    assert [tuple(r) for r in learning.dbscan(one, 1.0, 1).collect()] == [(3, 3)]
