"""Merging batches into a table by key."""

from pyspark.sql import functions as F

from tidemark.sources.keyed_table import KeyedTable

SCHEMA = {"k": "bigint", "version": "bigint", "v": "string"}


def rows(spark, data):
    return spark.createDataFrame(data, "k long, version long, v string")


def state(table):
    return {r["k"]: (r["version"], r["v"], r["deleted_at"] and str(r["deleted_at"].date())) for r in table.read(deleted=True).collect()}


def test_batches_repeated_cut_off_and_late(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "version", buckets=4)
    assert table.read().count() == 0
    table.merge(rows(spark, [(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (None, 1, "n")]), 0)
    want = {1: (2, "b", None), 2: (1, "x", None), None: (1, "n", None)}
    assert state(table) == want
    second = [(1, 1, "late"), (2, 1, "same version, later batch"), (3, 5, "new")]
    part = [r for r in second if r[0] == 3]  # what a batch that was cut off has written
    table.merge(rows(spark, part), 1)
    table.merge(rows(spark, second), 1)
    once = state(table)
    table.merge(rows(spark, second), 1)
    assert state(table) == once == {1: (2, "b", None), 2: (1, "same version, later batch", None), 3: (5, "new", None), None: (1, "n", None)}


def test_blank_values_keep_older_ones_and_deleted_rows_their_time(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "version", ("v",), buckets=4)
    table.merge(rows(spark, [(1, 1, "a"), (2, 1, "b"), (3, 1, None)]), 0)
    table.merge(rows(spark, [(1, 2, None), (2, 2, ""), (3, 2, "c")]), 1)
    assert state(table) == {1: (2, "a", None), 2: (2, "b", None), 3: (2, "c", None)}
    table.merge(rows(spark, [(1, 5, ""), (2, 5, "e")]), 2)
    table.merge(rows(spark, [(1, 3, "d"), (2, 3, "d")]), 2)  # late, but newer than what was kept for 1
    assert state(table) == {1: (5, "d", None), 2: (5, "e", None), 3: (2, "c", None)}
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    day = lambda d: F.to_timestamp(F.lit(d))
    table.delete(keys(1, 9), 2, day("2026-06-01"))
    table.delete(keys(1, 2), 3, day("2026-07-01"))
    table.delete(keys(1, 2), 3, day("2026-07-01"))
    assert state(table) == {1: (5, "d", "2026-06-01"), 2: (5, "e", "2026-07-01"), 3: (2, "c", None)}
    table.merge(rows(spark, [(2, 6, "back")]), 4)
    assert state(table)[2] == (6, "back", None) and table.read().count() == 2


def test_other_partitions_are_left_alone(spark, tmp_path):
    import os

    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "version", buckets=8)
    table.merge(rows(spark, [(i, 1, "a") for i in range(64)]), 0)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")}
    before = files()
    table.merge(rows(spark, [(5, 2, "b")]), 1)
    assert len(before - files()) == 1 and table.read().count() == 64
