"""State by key over batches, restarts and expiry."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import keyed, streams

DAY = 86400


def write(spark, folder, rows):
    spark.createDataFrame([(i, k, dt.datetime(2026, 1, 1) + dt.timedelta(days=d)) for i, k, d in rows], "id long, key string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def result(frame):
    return {r["id"]: r["duplicate_of"] for r in frame.collect()}


def test_later_rows_are_marked_also_after_a_restart_and_forgotten_ones_are_new(spark, tmp_path):
    folder = str(tmp_path)
    marks = lambda: result(keyed.marked(stream(spark, f"{folder}/in"), "id", "key", "ts", 30 * DAY, folder))
    write(spark, f"{folder}/in", [(2, "a", 1), (1, "a", 0), (3, "b", 0), (4, "a", 1), (5, None, 0), (6, None, 0)])
    assert marks() == {1: None, 2: 1, 3: None, 4: 1}
    write(spark, f"{folder}/in", [(7, "a", 2), (8, "c", 2), (9, "c", 2)])
    after = marks()  # goes on from the checkpoint, without the first batch's rows
    assert after == {1: None, 2: 1, 3: None, 4: 1, 7: 1, 8: None, 9: 8}
    write(spark, f"{folder}/in", [(10, "d", 60)])
    marks()
    write(spark, f"{folder}/in", [(11, "a", 61), (12, "a", 62)])
    assert {i: x for i, x in marks().items() if i > 9} == {10: None, 11: None, 12: 11}
    assert marks() == marks()  # nothing new, nothing changes


def test_state_is_bounded_by_time(spark, tmp_path):
    folder = str(tmp_path)
    for start in (0, 100, 200, 300):
        write(spark, f"{folder}/in", [(start + i, f"k{start + i}", start) for i in range(20)])
    rows = keyed.mark_duplicates(stream(spark, f"{folder}/in"), "id", "key", "ts", 10 * DAY)
    with keyed.rocksdb(spark):
        query = rows.writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) < 80 * 2 and held[-1] <= 45  # of 80 keys, each a value and a timer, the last 20 are left


def test_many_keys_share_calls_and_rows_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKETS", 8)
    folder, keep = str(tmp_path), 5
    batches = [[(b * 1000 + i, f"k{i * 7 % 150}", b * 3 + i % 3) for i in range(600)] for b in range(3)]
    want, first = {}, {}
    for batch in batches:
        write(spark, f"{folder}/in", batch)
        for i, k, day in sorted(batch, key=lambda r: (r[2], r[0])):
            fresh = k not in first or day - first[k][1] > keep
            first[k] = (i, day) if fresh else first[k]
            want[i] = None if fresh else first[k][0]
    rows = keyed.mark_duplicates(stream(spark, f"{folder}/in"), "id", "key", "ts", keep * DAY, late="30 days")
    with keyed.rocksdb(spark):
        query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert result(spark.read.parquet(f"{folder}/out")) == want
    assert 0 < max(held) <= 8  # of 150 keys
