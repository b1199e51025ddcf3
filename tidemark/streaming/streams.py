"""Structured Streaming: envelopes in, silver rows, windows and alerts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import filled, filled_array, fingerprint, level, published_at, quality, url_id
from tidemark.operators.curation import newest_top

ENTITIES = "struct<tech: array<string>, org: array<string>, loc: array<string>>"
#: Every alias that producers use, flat or nested.
ENVELOPE = (
    "message_type string, source_platform string, crawled_at string, data struct<"
    "title: string, publish_date: string, published_at: string, content: string, source_url: string, url: string, job_title: string, company_name: string, location: string, salary: string, level: string, "
    f"description: string, requirement: string, benefit: string, posted_date: string, size: string, field: string, skills: array<string>, technologies: array<string>, entities: {ENTITIES}, "
    "job: struct<title: string, description: string, requirement: string, benefit: string, salary: string, level: string, source_url: string>, company: struct<name: string, size: string, field: string, location: string>>"
)


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON envelopes from files."""
    return spark.readStream.schema(ENVELOPE).json(folder)


def articles(messages: DataFrame) -> DataFrame:
    """Silver articles from envelopes; rows without a link are dropped."""
    d = lambda n: F.col(f"data.{n}")
    url = filled(d("source_url"), d("url"))
    out = messages.filter(F.col("message_type") == "article").select(url_id(url).alias("id"), url.alias("source_url"), "source_platform", d("title").alias("title"), d("content").alias("content"), published_at(filled(d("published_at"), d("publish_date"))).alias("published_at"), filled_array(d("entities.tech"), d("technologies")).alias("entity_techs"), fingerprint(d("title"), d("content")).alias("content_hash"), quality(d("title"), d("content")).alias("quality_score"))
    return out.filter(F.col("source_url").isNotNull())


def postings(messages: DataFrame) -> DataFrame:
    """Silver jobs from flat or nested envelopes; rows without a link are dropped."""
    d = lambda n: F.col(f"data.{n}")
    url = filled(d("job.source_url"), d("source_url"), d("url"))
    title, description = filled(d("job.title"), d("job_title"), d("title")), filled(d("job.description"), d("description"))
    company = filled(d("company.name"), d("company_name"))
    raw_level = filled(d("job.level"), d("level"))
    return messages.filter(F.col("message_type") == "job").select(url_id(url).alias("id"), url.alias("source_url"), "source_platform", title.alias("job_title"), company.alias("company_name"), filled(d("company.location"), d("location")).alias("company_location"), filled(d("job.salary"), d("salary")).alias("salary"), level(raw_level).alias("level"), description.alias("description"), filled_array(d("technologies"), d("skills"), d("entities.tech")).alias("technologies"), fingerprint(title, description).alias("content_hash"), d("posted_date").alias("posted_date")).filter(F.col("source_url").isNotNull())


def deduplicated(rows: DataFrame, key: str, at: str | None = None, late: str = "1 day") -> DataFrame:
    """First row of each key; with an event time column, state older than ``late`` is dropped."""
    return rows.dropDuplicates([key]) if at is None else rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, at: str, key: str, value: str, size: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of fixed (or, with slide, overlapping) windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def job_alerts(new_jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """job, user_id, matches_current: users whose technologies or target skills overlap a job's; works on streams against a static profile table."""
    techs = new_jobs.select("id", F.explode(F.transform("technologies", F.lower)).alias("tech"))
    wanted = profiles.select("user_id", F.explode(F.transform(F.array_union("technologies", "target_skills"), F.lower)).alias("tech"), F.transform("technologies", F.lower).alias("own"))
    hits = techs.join(wanted, "tech")
    return hits.select(F.col("id").alias("job"), "user_id", F.array_contains("own", F.col("tech")).alias("matches_current"))


def run_available(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything there is, in micro-batches handed to ``write`` with their numbers; a restart goes on from the checkpoint."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def file_stream(frame: DataFrame, folder: str, files: int | None = None, per_batch: int | None = None) -> DataFrame:
    """The frame's rows, written to a folder, as a stream; ``per_batch`` files make a batch.  There are as many files as the frame has partitions unless ``files`` says so."""
    (frame if files is None else frame.repartition(files)).write.parquet(folder)
    reader = frame.sparkSession.readStream.schema(frame.schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def collected(rows: DataFrame, folder: str) -> DataFrame:
    """What an append stream gives for all rows there are, written and read back."""
    rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


def appended(rows: DataFrame, folder: str) -> DataFrame:
    """The same through micro-batches, each written under its number, so that a batch that is run again replaces what it wrote."""
    run_available(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/state")
    return rows.sparkSession.read.parquet(f"{folder}/out")


def canonical_stream(rows: DataFrame, column: str, aliases: Callable[[], DataFrame], folder: str) -> DataFrame:
    """rows with names through an alias table (alias, canonical) that every micro-batch reads anew."""

    def write(batch: DataFrame, n: int) -> None:
        known = aliases()
        named = batch.join(known, F.lower(F.trim(column)) == known["alias"], "left").withColumn(column, F.coalesce("canonical", column)).drop("alias", "canonical")
        named.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    run_available(rows, write, f"{folder}/state")
    return rows.sparkSession.read.parquet(f"{folder}/out").drop("batch")


def pushed_top(rows: DataFrame, key: str, n: int, folder: str) -> DataFrame:
    """key, total, place: the snapshot of the n most frequent keys, written anew after each batch; the last one."""
    spark, last = rows.sparkSession, [0]

    def write(batch: DataFrame, number: int) -> None:
        newest_top(batch.select(F.col(key).alias("key"), F.col("count").alias("total")), n).write.mode("overwrite").parquet(f"{folder}/snapshot/{number}")
        last[0] = number

    run_available(rows.groupBy(key).count(), write, f"{folder}/state", "complete")
    return spark.read.parquet(f"{folder}/snapshot/{last[0]}")


def met_within(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str = "10 minutes") -> DataFrame:
    """key, left's and right's time of pairs in which right comes up to ``within`` after left; both may be streams, whose state is dropped by watermarks."""
    a = left.withWatermark(at, late).select(F.col(key).alias("a_key"), F.col(at).alias("a_at"))
    b = right.withWatermark(at, late).select(F.col(key).alias("b_key"), F.col(at).alias("b_at"))
    return a.join(b, F.expr(f"a_key = b_key AND b_at >= a_at AND b_at <= a_at + INTERVAL {within}")).select(F.col("a_key").alias(key), "a_at", "b_at")
