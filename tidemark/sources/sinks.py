"""Writers: partitioned raw files, snapshots, CSV exports, upserts, outbox and run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_raw(messages: DataFrame, folder: str) -> None:
    """gzip JSON by content type, source and day of crawled_at; a folder's messages are brought together first, so that they make few files."""
    day = F.to_date(F.substring("crawled_at", 1, 10))
    parts = {"content_type": F.col("message_type"), "source": F.col("source_platform"), "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}
    messages.withColumns(parts).repartition(*parts).write.mode("append").partitionBy(*parts).option("compression", "gzip").json(folder)


def write_snapshot(frames: dict[str, DataFrame], root: str, tag: str) -> None:
    """One Parquet folder for each frame; a tag is written once."""
    for name, frame in frames.items():
        frame.write.mode("errorifexists").parquet(f"{root}/snapshot_{tag}/{name}")


def read_snapshot(spark: SparkSession, root: str, tag: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/snapshot_{tag}/{n}") for n in names}


def export_trends(series: DataFrame, folder: str) -> None:
    """CSV with a header, quotes doubled."""
    series.select("technology_name", "job_count", "growth_rate").write.mode("overwrite").csv(folder, header=True, quote='"', escape='"')


def soft_delete(rows: DataFrame, ids: DataFrame, key: str, at: str) -> DataFrame:
    """rows with deleted_at set for the keys; rows deleted before keep their time."""
    gone = ids.select(F.col(key).alias("_k")).distinct()
    return rows.join(gone, rows[key] == gone["_k"], "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_k").isNotNull(), F.to_timestamp(F.lit(at))))).drop("_k")


def outbox_next(events: DataFrame, most_attempts: int, n: int) -> DataFrame:
    """The oldest events that are pending, or failed with attempts left."""
    return events.filter((F.col("status") == "PENDING") | ((F.col("status") == "FAILED") & (F.col("attempts") < most_attempts))).orderBy("created_at", "id").limit(n)


def outbox_mark(events: DataFrame, outcome: DataFrame) -> DataFrame:
    """events after an attempt; outcome: id, ok."""
    j = events.join(outcome, "id", "left")
    return j.withColumns({"status": F.when(F.col("ok"), "PUBLISHED").when(~F.col("ok"), "FAILED").otherwise(F.col("status")), "attempts": F.col("attempts") + F.when(~F.col("ok"), 1).otherwise(0)}).drop("ok")


def run_durations(log: DataFrame) -> DataFrame:
    """The newest run of each job with its seconds; log: job, run_id, status, started_at, finished_at."""
    last = log.withColumn("_n", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("started_at"), F.desc("run_id")))).filter("_n = 1").drop("_n")
    return last.withColumn("seconds", F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))
