"""Serving queries: matching, similarity, health, recommendation, feeds, activity, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def job_match(requires: DataFrame, skills: list[str], n: int = 300) -> DataFrame:
    """job, matched, required, score: share of a job's required names that the skills have, any case."""
    own = F.array(*(F.lit(s.lower()) for s in skills))
    out = requires.groupBy("job").agg(F.countDistinct(F.when(F.array_contains(own, F.lower("tech")), F.col("tech"))).alias("matched"), F.countDistinct("tech").alias("required"))
    return out.filter("matched > 0").withColumn("score", F.round(F.col("matched") / F.col("required"), 4)).orderBy(F.desc("score"), F.desc("matched"), "job").limit(n)


def similar_sets(sets: DataFrame, key: str, target, n: int) -> DataFrame:
    """key, shared, jaccard of the sets (key, tech) against one of them, best first."""
    sizes = sets.groupBy(key).agg(F.count("*").alias("size"))
    mine = sets.filter(F.col(key) == F.lit(target)).select("tech")
    shared = sets.filter(F.col(key) != F.lit(target)).join(mine, "tech").groupBy(key).agg(F.count("*").alias("shared"))
    own = mine.agg(F.count("*").alias("own"))
    out = shared.join(sizes, key).crossJoin(F.broadcast(own)).withColumn("jaccard", F.round(F.col("shared") / (F.col("size") + F.col("own") - F.col("shared")), 4))
    return out.select(key, "shared", "jaccard").orderBy(F.desc("jaccard"), key).limit(n)


def company_health(stack: DataFrame, latest: DataFrame) -> DataFrame:
    """company, techs, score (mean of 50 + growth / 2 in 0 to 100), label, strengths (60 or more, best 3), watch (below 40, worst 3)."""
    s = stack.join(latest.select("tech", "growth_rate"), "tech").withColumn("s", F.least(F.greatest(50 + F.coalesce("growth_rate", F.lit(0.0)) / 2, F.lit(0.0)), F.lit(100.0)))
    pick = lambda keep, sign: F.transform(F.slice(F.sort_array(F.collect_list(F.when(keep, F.struct((sign * F.col("s")).alias("k"), "tech")))), 1, 3), lambda x: x["tech"])
    out = s.groupBy("company").agg(F.count("*").alias("techs"), F.round(F.avg("s")).cast("int").alias("score"), F.array_join(pick(F.col("s") >= 60, -1), ",").alias("strengths"), F.array_join(pick(F.col("s") < 40, 1), ",").alias("watch"))
    return out.withColumn("label", F.when(F.col("score") >= 70, "strong").when(F.col("score") >= 45, "stable").otherwise("weak"))


def recommend(related: DataFrame, latest: DataFrame, owned: list[str], n: int = 30) -> DataFrame:
    """tech, co, score: neighbours of owned technologies; 0.6 by shared evidence, 0.4 by growth, each over its largest."""
    both = related.select(F.col("tech_a").alias("a"), F.col("tech_b").alias("b")).union(related.select(F.col("tech_b"), F.col("tech_a")))
    near = both.filter(F.col("a").isin(owned) & ~F.col("b").isin(owned)).groupBy(F.col("b").alias("tech")).agg(F.count("*").alias("co")).orderBy(F.desc("co"), "tech").limit(n)
    rows = near.join(latest.select("tech", F.coalesce("mom_growth", F.lit(0.0)).alias("mom")), "tech", "left").fillna({"mom": 0.0})
    most = rows.agg(F.max("co").alias("max_co"), F.max(F.abs("mom")).alias("max_mom"))
    one = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    score = F.round(0.6 * F.col("co") / one("max_co") + 0.4 * F.col("mom") / one("max_mom"), 3)
    return rows.crossJoin(F.broadcast(most)).select("tech", "co", score.alias("score"))


def role_skills(requires: DataFrame, jobs: DataFrame, role, level=None, n: int = 15, least: int = 5) -> DataFrame:
    """tech, jobs: the skills most asked for in a role's jobs; those of the level if it has ``least`` skills, else of all levels."""
    rows = requires.join(jobs.filter(role).select("job", "level"), "job")
    top = lambda r, tier: r.groupBy("tech").agg(F.count("*").alias("jobs")).orderBy(F.desc("jobs"), "tech").limit(n).withColumn("tier", F.lit(tier))
    both = top(rows, 1) if level is None else top(rows.filter(F.col("level") == level), 0).unionByName(top(rows, 1))
    few = both.groupBy("tier").agg(F.count("*").alias("size")).filter((F.col("tier") == 1) | (F.col("size") >= least)).agg(F.min("tier").alias("tier"))
    return both.join(F.broadcast(few), "tier").select("tech", "jobs")


def skill_gap(required: DataFrame, owned: list[str], steps: int = 5, most: int = 10) -> DataFrame:
    """tech, jobs, step: required skills that aren't owned (any case), the first ``steps`` of them numbered."""
    gap = required.filter(~F.lower("tech").isin([o.lower() for o in owned])).orderBy(F.desc("jobs"), "tech").limit(most)
    at = F.row_number().over(Window.orderBy(F.desc("jobs"), "tech"))
    return gap.withColumn("at", at).select("tech", "jobs", F.when(F.col("at") <= steps, F.col("at")).alias("step"))


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.max_by(F.struct(at, *rest), F.struct(at, *rest)).alias("x")).select(key, "x.*")


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new whose key it lacks; of equal keys in new the first in order."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The last version of each key; columns of ``keep`` take their last value that isn't null or empty."""
    rest = [c for c in old.columns if c not in keys]
    by = F.col(version)
    aggs = [(F.max_by(c, F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), by)) if c in keep else F.max_by(c, by)).alias(c) for c in rest]
    return old.unionByName(new.select(*old.columns)).groupBy(*keys).agg(*aggs).select(*old.columns)


def first_seen(rows: DataFrame, key: str, order: list[str], identity: str) -> DataFrame:
    """rows with is_duplicate and duplicate_of: the first identity of the key."""
    first = F.first(identity).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_f", first).withColumns({"is_duplicate": F.col("_f") != F.col(identity), "duplicate_of": F.when(F.col("_f") != F.col(identity), F.col("_f"))}).drop("_f")


def binary_metrics(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """limit, tp, fp, tn, fn, accuracy, precision, recall, f1 of (score, label) at each limit; limits are few rows."""
    rows = scored.crossJoin(F.broadcast(limits))
    hit = F.col("score") >= F.col("limit")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    g = rows.groupBy("limit").agg(count(hit & (F.col("label") == 1))("tp"), count(hit & (F.col("label") == 0))("fp"), count(~hit & (F.col("label") == 0))("tn"), count(~hit & (F.col("label") == 1))("fn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 4))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return g.select("limit", "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def checks(frames: dict[str, tuple[DataFrame, str, list[str]]], references: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """check, severity, n: rows, null and repeated keys, nulls of required columns of frames; values of references (child, parent) without a parent."""
    parts = []
    for name, (f, key, required) in frames.items():
        one = f.agg(F.count("*").alias("rows"), (F.count(key) - F.countDistinct(key)).alias("repeated"), *(F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"null_{c}") for c in [key, *required]))
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(f"{name}.{c}").alias("check"), F.lit("info" if c == "rows" else "error").alias("severity"), F.col(c).cast("long").alias("n")) for c in one.columns))).alias("x")).select("x.*"))
    for name, (child, parent) in references.items():
        parts.append(child.toDF("k").filter("k IS NOT NULL").join(parent.toDF("k").distinct(), "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{name}.orphans").alias("check"), F.lit("warn").alias("severity"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
