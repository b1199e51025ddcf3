"""Operators of curation and their streams, against plain Python."""

import collections
import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import SMALL
from tidemark.functions import columns as C
from tidemark.operators import curation, graph
from tidemark.plans import registry
from tidemark.streaming import keyed, streams

DAY = dt.date


@pytest.mark.parametrize("name,first,last", [
    ("2024-Q4", DAY(2024, 10, 1), DAY(2024, 12, 31)), ("2024-Q2", DAY(2024, 4, 1), DAY(2024, 6, 30)), ("2024-02", DAY(2024, 2, 1), DAY(2024, 2, 29)), ("2023", DAY(2023, 1, 1), DAY(2023, 12, 31)),
    (None, DAY(2026, 2, 1), DAY(2026, 5, 2)), ("", DAY(2026, 2, 1), DAY(2026, 5, 2)), ("2024-Q5", None, None), ("2024-13", None, None), ("last year", None, None),
])
def test_periods(spark, name, first, last):
    row = spark.createDataFrame([(name,)], "name string").select(C.period(F.col("name"), F.lit(DAY(2026, 5, 2))).alias("p")).first()["p"]
    assert (row["first"], row["last"]) == (first, last)


def test_name_components_against_numpy(spark):
    got = {r["id"]: np.array(r["reduced"]) for r in registry.QUERIES["o188_name_pca"](spark, SMALL).collect()}
    names = sorted(got)

    def counts(name):
        words = [*name.lower().split(), *(c for c in name.lower() if c != " ")]
        c = collections.Counter(int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16 for w in words)
        return [c[i] for i in range(16)]

    x = np.array([counts(n) for n in names], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([got[n] for n in names])
    assert y.shape[1] == min(16, len(names)) and np.allclose(x @ x.T, y @ y.T, atol=1e-6)  # all components: a rotation
    spread = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(np.var(y, axis=0, ddof=1), spread, atol=1e-6)


def test_keys_are_new_once_also_after_a_restart(spark, tmp_path):
    folder, seen = str(tmp_path), []
    for part, keys in enumerate(([1, 2, 2], [2, 3], [3, 1, 4])):
        rows = [(10 * part + i, k, f"2026-01-0{part + 1} 00:00:0{i}") for i, k in enumerate(keys)]
        spark.createDataFrame(rows, "id long, key long, ts string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = streams.event_time(spark.readStream.schema("id long, key long, ts string").parquet(f"{folder}/in"))
        marks = keyed.marked(stream, "id", "key", "ts", 30 * 86400, folder)
        seen.append({r["key"] for r in marks.filter(f"duplicate_of IS NULL AND id >= {10 * part}").collect()})
    assert seen == [{"1", "2"}, {"3"}, {"4"}]


def test_late_rows_leave_no_window_behind(spark, tmp_path):
    """Rows later than the watermark are dropped, in a stream only."""
    rows = [("2026-01-01 00:00:30", "a", 1.0), ("2026-01-01 05:00:30", "a", 1.0), ("2026-01-01 06:00:30", "a", 1.0), ("2026-01-01 07:00:30", "a", 1.0), ("2026-01-01 00:00:40", "a", 5.0), ("2026-01-01 09:00:00", "a", 1.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, k string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, k string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.collected(streams.tumbling(streams.event_time(stream), "ts", "k", "value", "1 hour"), str(tmp_path / "s"))
    assert {(r["n"], r["total"]) for r in out.collect()} == {(1, 1.0)}


def test_proposals(spark):
    groups = spark.createDataFrame([(["K8s", "Kubernetes"], "Kubernetes", "high"), (["Go", "Golang", "golang"], "Golang", "low"), (["Vue", "VueJS"], "VueJS", None), (["x"], "x", "high"), (["a", "b"], None, "high")], "names array<string>, canonical string, confidence string")
    decided = spark.createDataFrame([("vuejs ", "VUE")], "name_a string, name_b string")
    assert {tuple(r) for r in curation.proposed(groups, decided).collect()} == {("K8s", "Kubernetes", "merge"), ("Go", "Golang", "review"), ("golang", "Golang", "review")}


def test_gate(spark):
    rows = [(1.0, 2.0, "silhouette", False, False), (1.0, 2.0, "davies_bouldin", False, True), (2.0, 2.0, "silhouette", False, False), (None, 2.0, "silhouette", False, False), (1.0, None, "silhouette", False, True), (1.0, 2.0, "silhouette", True, True)]
    f = spark.createDataFrame(rows, "a double, b double, m string, forced boolean, want boolean")
    assert f.filter(curation.promoted(F.col("a"), F.col("b"), F.col("m"), F.col("forced")) != F.col("want")).count() == 0


def test_names_with_letters_beside_them_are_other_names(spark):
    texts = spark.createDataFrame([(1, "We met FPT Software, and fpt."), (2, "FPTs and xFPT"), (3, None), (4, "a.b (c++) x")], "id long, text string")
    names = spark.createDataFrame([("FPT",), ("FPT Software",), ("c++",), ("...",)], "name string")
    assert {tuple(r) for r in curation.known_names(texts, names).collect()} == {(1, "FPT"), (1, "FPT Software"), (4, "c++")}


def test_components_that_are_not_done_are_told(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.connected(chain, 1)
