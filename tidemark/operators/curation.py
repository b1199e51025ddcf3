"""Keeping names in order: alias groups, review queues, retrieval plans, signals and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import tech_key


def representatives(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """id, representative, canonical of nodes (id, name, canonical): of a group with one canonical key the node that has the canonical name, then most jobs (id, jobs), then the shortest name."""
    rows = nodes.join(jobs, "id", "left").withColumns({"key": tech_key(F.col("canonical")), "exact": F.trim("name") == F.col("canonical"), "jobs": F.coalesce("jobs", F.lit(0))})
    first = rows.groupBy("key").agg(F.min_by(F.struct("id", "canonical"), F.struct(~F.col("exact"), -F.col("jobs"), F.length("name"), F.col("name"), F.col("id"))).alias("first"))
    return rows.join(first, "key").select("id", F.col("first.id").alias("representative"), F.col("first.canonical").alias("canonical"))


def rewritten(edges: DataFrame, columns: list[str], mapping: DataFrame) -> DataFrame:
    """edges with the ids in ``columns`` replaced by their representatives (id, representative), each edge once, without loops between two such columns."""
    out = edges
    for c in columns:
        names = mapping.select(F.col("id").alias("_id"), F.col("representative").alias("_to"))
        out = out.join(names, out[c] == names["_id"], "left").withColumn(c, F.coalesce("_to", c)).drop("_id", "_to")
    return (out.filter(F.col(columns[0]) != F.col(columns[1])) if len(columns) == 2 else out).distinct()


def unordered(a: str, b: str) -> Column:
    """A key of two names in either order and any case."""
    return F.array_sort(F.array(F.lower(F.trim(a)), F.lower(F.trim(b))))


def known_merges(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, canonical of names that an alias (alias_normalized, canonical_name) gives another name."""
    known = aliases.select(F.col("alias_normalized").alias("_k"), F.col("canonical_name").alias("canonical"))
    return names.join(known, F.lower(F.trim("name")) == F.col("_k")).filter("name <> canonical").select("name", "canonical")


def proposed(groups: DataFrame, decided: DataFrame) -> DataFrame:
    """name, canonical, outcome of proposed groups (names, canonical, confidence): ``merge`` for those of high confidence, ``review`` for the others but for pairs (name_a, name_b) that were decided before."""
    rows = groups.filter(F.col("canonical").isNotNull() & (F.size("names") >= 2)).select(F.explode("names").alias("name"), "canonical", F.coalesce("confidence", F.lit("low")).alias("confidence")).filter("name <> canonical")
    merges = rows.filter("confidence = 'high'").select("name", "canonical", F.lit("merge").alias("outcome"))
    keyed = rows.filter("confidence <> 'high'").withColumn("pair", unordered("name", "canonical"))
    fresh = keyed.join(decided.select(unordered("name_a", "name_b").alias("pair")).distinct(), "pair", "left_anti")
    queue = fresh.groupBy("pair").agg(F.min(F.struct("name", "canonical")).alias("x")).select("x.name", "x.canonical", F.lit("review").alias("outcome"))
    return merges.distinct().unionByName(queue)


def retrieval_plan(queries: DataFrame, most_hops: int = 2) -> DataFrame:
    """id, branches: what is searched for a query (id, techs, others, analytics, multi_hop): vectors always, the graph and its expansion with entities, analytics with technologies and that intent."""
    some = (F.size("techs") > 0) | (F.size("others") > 0)
    depth = F.least(F.when(F.col("multi_hop"), 2).otherwise(1), F.lit(most_hops))
    branches = F.array_compact(F.array(F.lit("vector"), F.when(some, F.lit("graph")), F.when(some & (depth > 0), F.concat(F.lit("expansion"), depth.cast("string"))), F.when((F.size("techs") > 0) & F.col("analytics"), F.lit("sql"))))
    return queries.select("id", branches.alias("branches"))


def retrieved(plan: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """id, branch, hit, score of all planned branches; each frame has id, hit, score.  A branch's frame is only joined with the queries that asked for it."""
    asked = plan.select("id", F.explode("branches").alias("branch"))
    parts = [frame.join(asked.filter(F.col("branch") == name), "id").select("id", "branch", "hit", "score") for name, frame in branches.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def strategy_shares(rows: DataFrame) -> DataFrame:
    """One row: shares of queries (use_graph, depth, use_sql, triples) that used the graph, expansion, analytics; mean number of triples."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return rows.agg(share(F.col("use_graph")).alias("pct_graph"), share(F.coalesce("depth", F.lit(0)) > 0).alias("pct_expansion"), share(F.col("use_sql")).alias("pct_sql"), F.round(F.avg("triples"), 6).alias("avg_triples"))


def sentiment_signal(articles: DataFrame, as_of: str, days: int = 90, weight: float = 0.20) -> DataFrame:
    """tech, articles, sentiment (mean of those scored, 0 if none is), weight of the articles (tech, day, score) of the last days."""
    recent = articles.filter(F.col("day") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    return recent.groupBy("tech").agg(F.count("*").alias("articles"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("sentiment")).withColumn("weight", F.lit(weight))


def roadmap_alerts(recommendations: DataFrame, threshold: float) -> DataFrame:
    """user, tech, growth: the first recommendation (user, place, tech, growth) of each user, where it grows enough."""
    first = recommendations.groupBy("user").agg(F.min_by(F.struct("tech", "growth"), "place").alias("x"))
    return first.select("user", "x.tech", "x.growth").filter((F.col("growth") >= threshold) & (F.trim("tech") != ""))


def promoted(challenger: Column, champion: Column, metric: Column, forced: Column) -> Column:
    """Whether a model takes the champion's place: forced, without one, or better; of davies_bouldin less is better."""
    sign = F.when(metric == "davies_bouldin", -1).otherwise(1)
    return forced | champion.isNull() | F.coalesce(challenger * sign > champion * sign, F.lit(False))


def filled_vectors(rows: DataFrame) -> DataFrame:
    """id, vector of rows (id, n, content, name_vector): the content's vector, or the name's where no content is (n = 0), with length 1 (zeros stay)."""
    chosen = rows.select("id", F.transform(F.when(F.col("n") == 0, F.col("name_vector")).otherwise(F.col("content")), lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return chosen.withColumn("norm", norm).select("id", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("vector"))


def pending(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """rows without a vector (key, embedding)."""
    return rows.join(vectors.filter(F.col("embedding").isNotNull()).select(key), key, "left_anti")


def ablation(rows: DataFrame, groups: dict[str, list[str]], metric: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """variant and the metric's columns with all groups of features, and without each of them."""
    left = {"baseline_all": groups} | {f"no_{g}": {k: v for k, v in groups.items() if k != g} for g in groups}
    out = None
    for name, kept in left.items():
        row = metric(rows, [c for columns in kept.values() for c in columns]).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def known_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, name: names that stand in a text (id, text) with no letter or digit beside them, in any case.

    A name is looked for only in texts that have its longest word, by an equality join."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    keyed = names.distinct().withColumn("word", F.array_max(F.transform(words("name"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]).filter("word IS NOT NULL")
    there = texts.select("id", "text", F.explode(F.array_distinct(words("text"))).alias("word")).join(keyed, "word")
    at = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), "name", F.lit(r"\E(?![\p{L}\p{N}])"))
    return there.filter(F.regexp_like("text", at)).select("id", "name").distinct()


def bridge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """a, b and the number of keys that have both, of pairs (key, a) and (key, b)."""
    return left.distinct().join(right.distinct(), key).groupBy("a", "b").agg(F.count("*").alias("shared"))


def newest_top(counts: DataFrame, n: int) -> DataFrame:
    """key, total, place: the n largest."""
    top = counts.orderBy(F.desc("total"), "key").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "key")))
