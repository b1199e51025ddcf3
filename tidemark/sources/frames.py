"""Loaders, and the frames of the analytics over the star-schema tables.

part.p_name stands for a technology, an order for a job posting, a line item for a dated
article that mentions a technology, a customer for the company that posts, a supplier for
a company that uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_table(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multiline)


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


def series(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(name))


def kafka_topics(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """topic, value, timestamp of a Kafka subscription from the earliest offsets; needs the connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return raw.select("topic", F.col("value").cast("string").alias("value"), "timestamp")


def part_techs(spark: SparkSession, folder: str) -> DataFrame:
    """l_orderkey, l_linenumber, l_suppkey, l_shipdate, tech of every line."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("tech"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).drop("l_partkey", "p_partkey")


def requires(spark: SparkSession, folder: str) -> DataFrame:
    """job, tech, each pair once."""
    return part_techs(spark, folder).select(F.col("l_orderkey").alias("job"), "tech").distinct()


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """article, tech, day."""
    return part_techs(spark, folder).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article"), "tech", F.col("l_shipdate").cast("date").alias("day"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """job, company, posted, level, pay."""
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("company"), F.col("o_orderdate").cast("date").alias("posted"), F.col("o_orderpriority").alias("level"), F.col("o_totalprice").alias("pay"))


def as_of(rows: DataFrame, day: str = "posted") -> DataFrame:
    """One row: the month of the latest day, the clock of every query."""
    return rows.agg(F.trunc(F.max(day), "month").alias("as_of"))
