"""Serving of named clusters: lookups by name, what a cluster's members are used by, and what members still lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import learning as L
from tidemark.operators.names import nearest_names


def lookup(asked: DataFrame, members: DataFrame, least: float = 0.8) -> DataFrame:
    """name, matched, label, status of asked names against members (name, label), in any case: ``found``; ``provisional`` if the nearest
    name has a ratio of ``least`` or more and is no noise; ``missing`` otherwise.

    Each asked name is looked up once; blanks around names don't count, null names are missing.
    Members of one name in different cases give the smallest label that isn't noise, if there is one."""
    one = members.select(F.lower(F.trim("name")).alias("key"), "label").filter("key IS NOT NULL").groupBy("key").agg(F.coalesce(F.min(F.when(F.col("label") >= 0, F.col("label"))), F.lit(-1)).alias("label"))
    rows = asked.select("name").distinct().withColumn("key", F.lower(F.trim("name")))
    hit = rows.join(one, "key", "left")
    lost = hit.filter("label IS NULL AND key IS NOT NULL").select("key").distinct()
    near = nearest_names(lost.select(F.col("key").alias("q")), one.select(F.col("key").alias("name")), least)
    near = near.select(F.col("q").alias("key"), F.col("name").alias("_near")).join(one.filter("label >= 0").select(F.col("key").alias("_near"), F.col("label").alias("_label")), "_near")
    out = hit.join(near, "key", "left")
    status = F.when(F.col("label").isNotNull(), "found").when(F.col("_label").isNotNull(), "provisional").otherwise("missing")
    matched = F.when(F.col("label").isNotNull(), F.col("key")).otherwise(F.col("_near"))
    return out.select("name", matched.alias("matched"), F.coalesce("label", "_label").alias("label"), status.alias("status"))


def batch_counts(looked_up: DataFrame) -> DataFrame:
    """One row: asked, found, provisional, missing."""
    return looked_up.agg(F.count("*").alias("asked"), *(F.count_if(F.col("status") == s).alias(s) for s in ("found", "provisional", "missing")))


def context(members: DataFrame, users: DataFrame, kind: str, most: int = 8) -> DataFrame:
    """label, kind, user, n, rank: the users that the most members of a cluster are joined with; users (user, name) are pairs, each counted once, ties to the smaller user; without noise."""
    pairs = users.select("user", "name").distinct().join(members.filter("label >= 0").select("name", "label").distinct(), "name")
    n = pairs.groupBy("label", "user").agg(F.count("*").alias("n"))
    by = Window.partitionBy("label").orderBy(F.desc("n"), "user")
    return n.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most).select("label", F.lit(kind).alias("kind"), "user", "n", F.col("rank").cast("long").alias("rank"))


def temporal(mentions: DataFrame, today: Column) -> DataFrame:
    """name, first_days, last_days, skew, sentiment of mentions (name, day, sentiment); -1, -1, 0 and 0 for names without a day.

    Sentiment is the mean of the known ones (0 without); skew is null for fewer than three days."""
    ago = mentions.select("name", F.date_diff(today, "day").cast("double").alias("ago"), "sentiment")
    dated = F.count("ago") > 0
    return ago.groupBy("name").agg(
        F.when(dated, F.max("ago")).otherwise(-1).cast("int").alias("first_days"), F.when(dated, F.min("ago")).otherwise(-1).cast("int").alias("last_days"),
        F.when(dated, L.adjusted_skew("ago")).otherwise(0.0).alias("skew"), F.when(dated, F.coalesce(F.avg("sentiment"), F.lit(0.0))).otherwise(0.0).alias("sentiment"),
    )


def categorised(nodes: DataFrame, given: DataFrame) -> DataFrame:
    """Nodes (name, category, ...) with the categories given (name, category) in place of their own; null and blank ones change nothing, of several the smallest counts."""
    new = given.filter(F.trim("category") != "").groupBy("name").agg(F.min("category").alias("_given"))
    return nodes.join(new, "name", "left").withColumn("category", F.coalesce("_given", "category")).select(*nodes.columns)


def pending(nodes: DataFrame, size: int = 50) -> DataFrame:
    """name, chunk: names without a category, in order, in chunks of ``size`` numbered from 0."""
    names = nodes.filter(F.col("category").isNull() | (F.trim("category") == "")).select("name").filter("name IS NOT NULL").distinct()
    return L.ordered(names, "name").select("name", F.floor((F.col("rank") - 1) / size).alias("chunk"))


def first_categories(merges: DataFrame, categories: DataFrame) -> DataFrame:
    """canonical, category: the canonical name's own category, or else that of the first of the names merged into it (name, canonical) that has one."""
    known = categories.filter(F.trim("category") != "").groupBy("name").agg(F.min("category").alias("category"))
    own = merges.select("canonical").distinct().select("canonical", F.col("canonical").alias("name"), F.lit(0).alias("_own"))
    rows = own.unionByName(merges.select("canonical", "name", F.lit(1).alias("_own"))).join(known, "name", "left")
    return rows.groupBy("canonical").agg(F.min_by("category", F.when(F.col("category").isNotNull(), F.struct("_own", "name"))).alias("category"))
