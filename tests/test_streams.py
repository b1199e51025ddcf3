"""Streams from files, against the same rows in batch."""

import json

from pyspark.sql import functions as F

from tests.helpers import SMALL
from tidemark.streaming import streams


def messages():
    return [
        {"message_type": "article", "source_platform": "p", "crawled_at": "2026-06-01T00:00:00", "data": {"title": "A long enough title", "content": "x" * 300, "source_url": "u1", "publish_date": "01/06/2026", "entities": {"tech": ["Java"]}}},
        {"message_type": "article", "source_platform": "p", "crawled_at": "2026-06-01T00:00:00", "data": {"title": "A  LONG enough title", "content": "x" * 300, "source_url": "u2", "technologies": ["Go"]}},
        {"message_type": "article", "source_platform": "p", "crawled_at": "2026-06-01T00:00:00", "data": {"title": "no link", "content": ""}},
        {"message_type": "job", "source_platform": "p", "crawled_at": "2026-06-01T00:00:00", "data": {"job_title": "Dev", "company_name": "C", "level": "Senior", "source_url": "j1", "skills": ["Java"]}},
        {"message_type": "job", "source_platform": "p", "crawled_at": "2026-06-01T00:00:00", "data": {"job": {"title": "Ops", "level": "intern", "source_url": "j2"}, "company": {"name": "D"}, "technologies": ["Go"]}},
    ]


def write(folder):
    folder.mkdir()
    for i, m in enumerate(messages()):
        (folder / f"{i}.json").write_text(json.dumps(m))
    return str(folder)


def test_silver_streams_deduplicate(spark, tmp_path):
    rows = streams.deduplicated(streams.articles(streams.envelopes(spark, write(tmp_path / "in"))), "content_hash")
    seen = []
    streams.run_available(rows, lambda f, n: seen.extend(f.collect()), str(tmp_path / "cp"))
    assert len(seen) == 1 and seen[0]["quality_score"] == 0.7 and seen[0]["source_url"] in ("u1", "u2")
    streams.run_available(rows, lambda f, n: seen.extend(f.collect()), str(tmp_path / "cp"))
    assert len(seen) == 1  # nothing new after a restart


def test_postings_flat_and_nested(spark, tmp_path):
    rows = streams.postings(spark.read.schema(streams.ENVELOPE).json(write(tmp_path / "in")))
    assert {(r["job_title"], r["company_name"], r["level"], tuple(r["technologies"])) for r in rows.collect()} == {("Dev", "C", "Senior", ("Java",)), ("Ops", "D", "Intern", ("Go",))}


def test_tumbling_stream_equals_batch(spark, tmp_path):
    batch = streams.tumbling(streams.event_time(spark.read.parquet(f"{SMALL}/events.parquet")), "ts", "event_type", "value", "1 hour")
    (tmp_path / "ev").mkdir()
    spark.read.parquet(f"{SMALL}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "ev"))
    source = spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema).parquet(str(tmp_path / "ev"))
    rows = streams.tumbling(streams.event_time(source), "ts", "event_type", "value", "1 hour", "60 days")
    seen = {}
    streams.run_available(rows, lambda f, n: seen.update({(r["start"], r["event_type"]): (r["n"], r["total"]) for r in f.collect()}), str(tmp_path / "cp"), "update")
    assert seen == {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in batch.collect()}


def test_job_alerts(spark):
    jobs = spark.createDataFrame([("j", ["Java"])], "id string, technologies array<string>")
    users = spark.createDataFrame([(1, ["java"], []), (2, ["go"], ["Java"]), (3, ["go"], [])], "user_id int, technologies array<string>, target_skills array<string>")
    assert {tuple(r) for r in streams.job_alerts(jobs, users).collect()} == {("j", 1, True), ("j", 2, False)}
    assert streams.deduplicated(jobs, "id").filter(F.col("id") == "j").count() == 1
