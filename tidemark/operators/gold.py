"""Monthly series, derived edges and statistics of technologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import growth, month_index, month_of
from tidemark.operators.learning import ordered, running
from tidemark.plans.lineage import cut


def monthly_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("tech", month_of(F.col("day")).alias("month")).agg(F.count("*").alias("article_count"))


def monthly_jobs(requires: DataFrame, jobs: DataFrame) -> DataFrame:
    """requires has each (job, tech) once, so jobs need no distinct count."""
    return requires.join(jobs.select("job", "posted"), "job").groupBy("tech", month_of(F.col("posted")).alias("month")).agg(F.count("*").alias("job_count"))


def demand(requires: DataFrame) -> DataFrame:
    return requires.groupBy("tech").agg(F.count("*").alias("job_count"))


def with_growth(series: DataFrame, value: str) -> DataFrame:
    """prev, prev_year (the values of exactly one and twelve months before), mom_growth and yoy_growth of a sparse monthly series."""
    by = Window.partitionBy("tech").orderBy("month_idx")
    at = lambda n: F.sum(value).over(by.rangeBetween(-n, -n))
    out = series.withColumn("month_idx", month_index(F.col("month"))).withColumns({"prev": at(1), "prev_year": at(12)})
    return out.withColumns({"mom_growth": growth(F.col(value), F.col("prev")), "yoy_growth": growth(F.col(value), F.col("prev_year"))})


def tech_analytics(job_months: DataFrame, article_months: DataFrame, snapshot: DataFrame, as_of: DataFrame) -> DataFrame:
    """tech, month, job_count, article_count, mom_growth, yoy_growth, growth_rate, ranking.

    The snapshot (tech, job_count) folds into the month of as_of by the larger value; growth
    compares jobs, or articles of months without jobs; only the as_of month is ranked.  Months
    after as_of (articles dated ahead of the last posting) aren't part of the series."""
    now = as_of.select(F.col("as_of").alias("month"))
    rows = (
        job_months.select("tech", "month", "job_count", F.lit(0).cast("long").alias("article_count"), F.lit(0).cast("long").alias("snapshot"))
        .unionByName(article_months.select("tech", "month", F.lit(0).cast("long").alias("job_count"), "article_count", F.lit(0).cast("long").alias("snapshot")))
        .unionByName(snapshot.crossJoin(F.broadcast(now)).select("tech", "month", F.lit(0).cast("long").alias("job_count"), F.lit(0).cast("long").alias("article_count"), F.col("job_count").alias("snapshot")))
    )
    rows = rows.crossJoin(F.broadcast(as_of)).filter(F.col("month") <= F.col("as_of")).drop("as_of")
    months = rows.groupBy("tech", "month").agg(F.sum("job_count").alias("j"), F.sum("article_count").alias("article_count"), F.max("snapshot").alias("s")).select("tech", "month", F.greatest("j", "s").alias("job_count"), "article_count")
    grown = with_growth(months.withColumn("activity", F.when(F.col("job_count") > 0, F.col("job_count")).otherwise(F.col("article_count"))), "activity")
    current = grown.crossJoin(F.broadcast(as_of)).withColumn("now", F.col("month") == F.col("as_of"))
    ranked = snapshot_rank(current.filter("now").select("tech", "job_count"))
    return current.join(ranked, "tech", "left").select("tech", "month", "job_count", "article_count", "mom_growth", "yoy_growth", F.col("mom_growth").alias("growth_rate"), F.when(F.col("now"), F.col("ranking")).alias("ranking"))


def snapshot_rank(counts: DataFrame) -> DataFrame:
    """tech, ranking by job_count, ties by name; sorted in ranges, so no task orders all technologies."""
    keyed = counts.select((-F.col("job_count")).alias("_down"), "tech")
    return ordered(keyed, "_down", "tech").select("tech", F.col("rank").alias("ranking"))


def rank_by_month(series: DataFrame) -> DataFrame:
    return series.withColumn("ranking", F.rank().over(Window.partitionBy("month").orderBy(F.desc("job_count"))))


def latest(series: DataFrame) -> DataFrame:
    """The newest month of each technology."""
    rest = [c for c in series.columns if c not in ("tech", "month")]
    return series.groupBy("tech").agg(F.max_by(F.struct("month", *rest), "month").alias("x")).select("tech", "x.*")


def top_technologies(series: DataFrame, n: int = 10) -> DataFrame:
    """n of 0 or less means 10, 100 is the most."""
    return latest(series).orderBy(F.desc("job_count"), "tech").limit(10 if n <= 0 else min(n, 100))


def new_by_month(series: DataFrame) -> DataFrame:
    """month, new_technologies: how many technologies a month is the first of."""
    return series.groupBy("tech").agg(F.min("month").alias("month")).groupBy("month").agg(F.count("*").alias("new_technologies"))


def new_technologies(series: DataFrame, as_of: DataFrame) -> DataFrame:
    """One row: the technologies whose first month is the current one."""
    first = new_by_month(series).join(F.broadcast(as_of), F.col("month") == F.col("as_of"))
    return first.agg(F.coalesce(F.sum("new_technologies"), F.lit(0).cast("long")).alias("new_technologies"))


def trending(series: DataFrame, n: int = 10) -> DataFrame:
    last = series.agg(F.max("month").alias("last"))
    return series.join(F.broadcast(last), series["month"] == last["last"]).drop("last").orderBy(F.coalesce("mom_growth", F.lit(0.0)).desc(), "tech").limit(n)


def uses(evidence: DataFrame) -> DataFrame:
    """company, tech with the number of supporting rows and their first and last day; evidence: company, tech, day."""
    return evidence.groupBy("company", "tech").agg(F.count("*").alias("evidence_count"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))


def related(pairs: DataFrame, key: str) -> DataFrame:
    """tech_a < tech_b and the number of keys (articles, jobs) that have both."""
    a, b = pairs.select(key, F.col("tech").alias("tech_a")), pairs.select(key, F.col("tech").alias("tech_b"))
    return a.join(b, key).filter("tech_a < tech_b").groupBy("tech_a", "tech_b").agg(F.count("*").alias("shared"))


def tech_stats(mentions: DataFrame, requires: DataFrame) -> DataFrame:
    m = mentions.groupBy("tech").agg(F.countDistinct("article").alias("article_count"), F.count("*").alias("mention_count"))
    return m.join(demand(requires), "tech", "full").select("tech", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("article_count", "mention_count", "job_count")))


def trend_score(stats: DataFrame) -> DataFrame:
    most = stats.filter("mention_count > 0").agg(F.max("mention_count").alias("most"))
    score = F.round((2 * F.col("mention_count") + F.col("job_count")) / (3 * F.col("most") + 1) * 100) / 100
    return stats.crossJoin(F.broadcast(most)).select("tech", score.alias("trend_score"))


def quantiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """tech and its exact quantiles, interpolated, of values (tech, pay): one column for each of ``shares``; nulls don't count.

    Equal pays are counted first, and the counts summed along sorted ranges, so that no task or
    buffer holds a technology's pays."""
    counts = values.filter("pay IS NOT NULL").groupBy("tech", "pay").agg(F.count("*").alias("c"))
    rows = running(counts, "c", "tech", "pay")
    sizes = rows.groupBy("tech").agg(F.min(F.col("total") - F.col("c")).alias("start"), F.sum("c").alias("n"))
    placed = rows.join(sizes, "tech").withColumn("upto", F.col("total") - F.col("start"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("pay").cast("double")))
    place = {c: (F.col("n") - 1) * p for c, p in shares.items()}
    ends = placed.groupBy("tech", "n").agg(*(at(f(x)).alias(f"{side}_{c}") for c, x in place.items() for side, f in (("low", F.floor), ("high", F.ceil))))
    return ends.select("tech", *((F.col(f"low_{c}") + (F.col(f"high_{c}") - F.col(f"low_{c}")) * (x - F.floor(x))).alias(c) for c, x in place.items()))


def pay_statistics(pays: DataFrame, least: int, n: int) -> DataFrame:
    """tech, jobs, median, mean, extremes and quartiles of pays (tech, pay) with ``least`` jobs, the n best paid of the 3 n most wanted."""
    out = pays.groupBy("tech").agg(F.count("*").alias("jobs"), F.avg("pay").alias("mean_pay"), F.min("pay").alias("min_pay"), F.max("pay").alias("max_pay"))
    wanted = cut(out.filter(F.col("jobs") >= least).orderBy(F.desc("jobs"), "tech").limit(3 * n))
    q = quantiles(pays.join(F.broadcast(wanted.select("tech")), "tech"), {"median_pay": 0.5, "p25_pay": 0.25, "p75_pay": 0.75})
    rounded = (F.round(c, 1).alias(c) for c in ("median_pay", "mean_pay", "min_pay", "max_pay", "p25_pay", "p75_pay"))
    return wanted.join(q, "tech", "left").select("tech", "jobs", *rounded).orderBy(F.desc("median_pay"), "tech").limit(n)


def co_required(requires: DataFrame, n: int | None = None, tech: str | None = None) -> DataFrame:
    """tech, other, jobs that want both (directed)."""
    a = requires if tech is None else requires.filter(F.lower("tech") == tech.lower())
    out = a.join(requires.select("job", F.col("tech").alias("other")), "job").filter("tech <> other").groupBy("tech", "other").agg(F.count("*").alias("jobs"))
    return out if n is None else out.orderBy(F.desc("jobs"), "tech", "other").limit(n)


def period_report(series: DataFrame, first: str, last: str, n: int) -> DataFrame:
    """Mean growth, sums and peak of each technology in a period, best growth first."""
    rows = series.filter(F.col("month").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).groupBy("tech")
    out = rows.agg(F.round(F.avg("growth_rate"), 4).alias("avg_growth"), F.sum("job_count").alias("jobs"), F.sum("article_count").alias("articles"), F.max("mom_growth").alias("peak_mom"))
    return out.filter("avg_growth IS NOT NULL").orderBy(F.desc("avg_growth"), "tech").limit(n)


def forecast_signals(series: DataFrame) -> DataFrame:
    """Slope and spread of growth (3 months or more), momentum (mean of the last 3), change of demand (2 or more)."""
    by = Window.partitionBy("tech")
    rows = series.withColumns({"x": F.row_number().over(by.orderBy("month")) - 1, "back": F.row_number().over(by.orderBy(F.desc("month")))})
    g = rows.groupBy("tech").agg(
        F.count("*").alias("n"),
        F.regr_slope("growth_rate", F.col("x").cast("double")).alias("slope"),
        F.stddev_samp("growth_rate").alias("spread"),
        F.avg(F.when(F.col("back") <= 3, F.col("mom_growth"))).alias("momentum"),
        (F.max_by("job_count", "month") - F.min_by("job_count", "month")).alias("change"),
    )
    three, two = F.col("n") >= 3, F.col("n") >= 2
    return g.select("tech", "n", F.when(three, F.round("slope", 3)).alias("slope"), F.when(three, F.round("momentum", 2)).alias("momentum"), F.when(three, F.round("spread", 2)).alias("volatility"), F.when(two, F.col("change")).alias("job_change"))


def trend_alerts(series: DataFrame, as_of: DataFrame, least: float = 30.0) -> DataFrame:
    now = series.join(F.broadcast(as_of), series["month"] == as_of["as_of"]).drop("as_of")
    return now.filter((F.col("job_count") > 0) & (F.col("mom_growth") >= least))


def keyword_digest(series: DataFrame, n: int = 5) -> DataFrame:
    """month, the n best ranked technologies in one text."""
    ranked = series.withColumn("r", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("job_count"), "tech"))).filter(F.col("r") <= n)
    return ranked.groupBy("month").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "tech"))), lambda x: x["tech"]), ", ").alias("digest"))


def compare(series: DataFrame, techs: list[str]) -> DataFrame:
    """Monthly rows of some technologies beside their latest growth."""
    rows = series.filter(F.lower("tech").isin([t.lower() for t in techs]))
    head = rows.groupBy("tech").agg(F.max_by(F.struct("mom_growth", "yoy_growth"), "month").alias("h")).select("tech", F.col("h.mom_growth").alias("latest_mom"), F.col("h.yoy_growth").alias("latest_yoy"))
    return rows.join(head, "tech").select("tech", "month", "job_count", "article_count", "latest_mom", "latest_yoy")
