"""Queries over technologies, jobs and companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import growth, level_rank, llm_cost
from tidemark.operators import gold, serving
from tidemark.plans.registry import query
from tidemark.sources import frames as S

# Common parts of the SQL.
R = "r AS (SELECT DISTINCT l_orderkey AS job, p_name AS tech FROM lineitem JOIN part ON l_partkey = p_partkey)"
M = "mm AS (SELECT l_orderkey * 10 + l_linenumber AS article, p_name AS tech, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey)"
J = "jb AS (SELECT o_orderkey AS job, o_custkey AS company, CAST(o_orderdate AS DATE) AS posted, o_orderpriority AS level, o_totalprice AS pay FROM orders)"
MONTHS = f"""{R}, {M}, {J},
ao AS (SELECT CAST(date_trunc('month', max(posted)) AS DATE) AS as_of FROM jb),
jm AS (SELECT tech, CAST(date_trunc('month', posted) AS DATE) AS month, count(*) AS job_count FROM r JOIN jb USING (job) GROUP BY 1, 2),
am AS (SELECT tech, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS article_count FROM mm GROUP BY 1, 2),
sn AS (SELECT tech, count(*) AS job_count FROM r GROUP BY 1),
un AS (SELECT tech, month, job_count, 0 AS article_count, 0 AS s FROM jm UNION ALL SELECT tech, month, 0, article_count, 0 FROM am UNION ALL SELECT tech, as_of, 0, 0, job_count FROM sn, ao),
mo AS (SELECT tech, month, greatest(CAST(sum(job_count) AS BIGINT), max(s)) AS job_count, CAST(sum(article_count) AS BIGINT) AS article_count, year(month) * 12 + month(month) AS i FROM un, ao WHERE month <= as_of GROUP BY tech, month),
ac AS (SELECT *, CASE WHEN job_count > 0 THEN job_count ELSE article_count END AS activity FROM mo),
gr AS (SELECT a.tech, a.month, a.job_count, a.article_count,
  CASE WHEN coalesce(p.activity, 0) = 0 THEN 0.0 ELSE round((a.activity - p.activity) / CAST(p.activity AS DOUBLE) * 100.0, 2) END AS mom_growth,
  CASE WHEN coalesce(y.activity, 0) = 0 THEN 0.0 ELSE round((a.activity - y.activity) / CAST(y.activity AS DOUBLE) * 100.0, 2) END AS yoy_growth
  FROM ac a LEFT JOIN ac p ON a.tech = p.tech AND p.i = a.i - 1 LEFT JOIN ac y ON a.tech = y.tech AND y.i = a.i - 12),
ta AS (SELECT *, mom_growth AS growth_rate FROM gr),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY month DESC) AS rn FROM ta) WHERE rn = 1)"""


def analytics(spark, d):
    jobs, requires = S.jobs(spark, d), S.requires(spark, d)
    return gold.tech_analytics(gold.monthly_jobs(requires, jobs), gold.monthly_mentions(S.mentions(spark, d)), gold.demand(requires), S.as_of(jobs))


@query("o072_tech_analytics", f"WITH {MONTHS} SELECT tech, month, job_count, article_count, mom_growth, yoy_growth, growth_rate, CASE WHEN month = as_of THEN row_number() OVER (PARTITION BY month ORDER BY job_count DESC, tech) END AS ranking FROM ta, ao")
def tech_analytics(spark, d):
    return analytics(spark, d).withColumn("ranking", F.col("ranking").cast("long"))


@query("o103_top_technologies", f"WITH {MONTHS} SELECT tech, month, job_count, article_count, mom_growth FROM la ORDER BY job_count DESC, tech LIMIT 10")
def top_technologies(spark, d):
    return gold.top_technologies(analytics(spark, d)).select("tech", "month", "job_count", "article_count", "mom_growth")


@query("o058_latest_per_tech", f"WITH {MONTHS} SELECT tech, month, job_count FROM la")
def latest_per_tech(spark, d):
    return gold.latest(analytics(spark, d)).select("tech", "month", "job_count")


@query("o099_mom_yoy_growth", f"WITH {MONTHS} SELECT tech, month, mom_growth, yoy_growth FROM ta")
def mom_yoy(spark, d):
    return analytics(spark, d).select("tech", "month", "mom_growth", "yoy_growth")


@query("o069_mentions_by_month", f"WITH {M} SELECT tech, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS article_count FROM mm GROUP BY 1, 2")
def mentions_by_month(spark, d):
    return gold.monthly_mentions(S.mentions(spark, d))


@query("o070_postings_by_month", f"WITH {R}, {J} SELECT tech, CAST(date_trunc('month', posted) AS DATE) AS month, count(*) AS job_count FROM r JOIN jb USING (job) GROUP BY 1, 2")
def postings_by_month(spark, d):
    return gold.monthly_jobs(S.requires(spark, d), S.jobs(spark, d))


@query("o071_demand", f"WITH {R} SELECT tech, count(*) AS job_count FROM r GROUP BY 1")
def demand(spark, d):
    return gold.demand(S.requires(spark, d))


@query("o097_demand_ranking", f"WITH {R}, c AS (SELECT tech, count(*) AS n FROM r GROUP BY 1) SELECT tech, row_number() OVER (ORDER BY n DESC, tech) AS ranking FROM c")
def demand_ranking(spark, d):
    return gold.snapshot_rank(gold.demand(S.requires(spark, d))).withColumn("ranking", F.col("ranking").cast("long"))


@query("o098_rank_by_month", f"WITH {R}, {J}, c AS (SELECT tech, CAST(date_trunc('month', posted) AS DATE) AS month, count(*) AS job_count FROM r JOIN jb USING (job) GROUP BY 1, 2) SELECT tech, month, job_count, rank() OVER (PARTITION BY month ORDER BY job_count DESC) AS ranking FROM c")
def rank_by_month(spark, d):
    return gold.rank_by_month(gold.monthly_jobs(S.requires(spark, d), S.jobs(spark, d))).withColumn("ranking", F.col("ranking").cast("long"))


@query("o104_trending", f"WITH {MONTHS} SELECT tech, month, mom_growth FROM ta WHERE month = (SELECT max(month) FROM ta) ORDER BY coalesce(mom_growth, 0) DESC, tech LIMIT 10")
def trending(spark, d):
    return gold.trending(analytics(spark, d)).select("tech", "month", "mom_growth")


@query("o083_new_technologies", f"WITH {MONTHS}, f AS (SELECT tech, min(month) AS first FROM ta GROUP BY tech) SELECT count(*) AS new_technologies FROM f, ao WHERE first = as_of")
def new_technologies(spark, d):
    return gold.new_technologies(analytics(spark, d), S.as_of(S.jobs(spark, d)))


@query(
    "o083_new_by_month",
    f"WITH {MONTHS}, f AS (SELECT tech, min(month) AS month FROM ta GROUP BY tech) SELECT month, count(*) AS new_technologies FROM f GROUP BY month",
)
def new_by_month(spark, d):
    """The same count for every month of the data."""
    return gold.new_by_month(analytics(spark, d))


@query("o081_period_report", f"WITH {MONTHS} SELECT tech, round(avg(growth_rate), 4) AS avg_growth, CAST(sum(job_count) AS BIGINT) AS jobs, CAST(sum(article_count) AS BIGINT) AS articles, max(mom_growth) AS peak_mom FROM ta WHERE month BETWEEN DATE '1997-01-01' AND DATE '1997-12-01' GROUP BY tech ORDER BY avg_growth DESC, tech LIMIT 10")
def period_report(spark, d):
    return gold.period_report(analytics(spark, d), "1997-01-01", "1997-12-01", 10)


@query("o082_top_mentioned", f"WITH {M} SELECT tech, count(*) AS n FROM mm WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' GROUP BY 1 ORDER BY n DESC, tech LIMIT 10")
def top_mentioned(spark, d):
    return S.mentions(spark, d).filter(F.col("day").between(F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1997-03-31")))).groupBy("tech").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tech").limit(10)


@query("o084_job_market", f"WITH {J} SELECT level, count(*) AS jobs, round(avg(pay), 2) AS mean_pay FROM jb WHERE level IS NOT NULL GROUP BY level")
def job_market(spark, d):
    return S.jobs(spark, d).filter(F.col("level").isNotNull()).groupBy("level").agg(F.count("*").alias("jobs"), F.round(F.avg("pay"), 2).alias("mean_pay"))


@query("o119_compare_series", f"WITH {MONTHS}, three AS (SELECT tech FROM sn ORDER BY job_count DESC, tech LIMIT 3) SELECT ta.tech, ta.month, ta.job_count, ta.article_count, la.mom_growth AS latest_mom, la.yoy_growth AS latest_yoy FROM ta JOIN three USING (tech) JOIN la USING (tech)")
def compare_series(spark, d):
    series = analytics(spark, d)
    three = gold.demand(S.requires(spark, d)).orderBy(F.desc("job_count"), "tech").limit(3)
    head = gold.latest(series).select("tech", F.col("mom_growth").alias("latest_mom"), F.col("yoy_growth").alias("latest_yoy"))
    return series.join(F.broadcast(three.select("tech")), "tech").join(head, "tech").select("tech", "month", "job_count", "article_count", "latest_mom", "latest_yoy")


@query("o029_date_window", f"WITH {MONTHS} SELECT tech, month, job_count FROM ta, ao WHERE month >= as_of - INTERVAL 6 MONTH AND month <= as_of")
def date_window(spark, d):
    now = S.as_of(S.jobs(spark, d))
    return analytics(spark, d).crossJoin(F.broadcast(now)).filter((F.col("month") >= F.add_months("as_of", -6)) & (F.col("month") <= F.col("as_of"))).select("tech", "month", "job_count")


@query("o120_forecast_signals", f"""WITH {MONTHS}, x AS (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY month) - 1 AS i, row_number() OVER (PARTITION BY tech ORDER BY month DESC) AS back FROM ta)
SELECT tech, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(regr_slope(growth_rate, i), 3) END AS slope, CASE WHEN count(*) >= 3 THEN round(avg(CASE WHEN back <= 3 THEN mom_growth END), 2) END AS momentum,
CASE WHEN count(*) >= 3 THEN round(stddev_samp(growth_rate), 2) END AS volatility, CASE WHEN count(*) >= 2 THEN max_by(job_count, month) - min_by(job_count, month) END AS job_change FROM x GROUP BY tech""")
def forecast(spark, d):
    return gold.forecast_signals(analytics(spark, d))


@query("o122_trend_alerts", f"WITH {MONTHS} SELECT tech, month, job_count, mom_growth FROM ta, ao WHERE month = as_of AND job_count > 0 AND mom_growth >= 30")
def alerts(spark, d):
    return gold.trend_alerts(analytics(spark, d), S.as_of(S.jobs(spark, d))).select("tech", "month", "job_count", "mom_growth")


@query("o125_keyword_digest", f"WITH {R}, {J}, c AS (SELECT tech, CAST(date_trunc('month', posted) AS DATE) AS month, count(*) AS job_count FROM r JOIN jb USING (job) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY job_count DESC, tech) AS rn FROM c) SELECT month, string_agg(tech, ', ' ORDER BY rn) AS digest FROM k WHERE rn <= 5 GROUP BY month")
def digest(spark, d):
    return gold.keyword_digest(gold.monthly_jobs(S.requires(spark, d), S.jobs(spark, d)))


@query("o126_latest_lines", f"WITH {MONTHS} SELECT tech, printf('%s: MoM %.2f%%, YoY %.2f%%', tech, mom_growth, yoy_growth) AS line FROM la")
def latest_lines(spark, d):
    return gold.latest(analytics(spark, d)).select("tech", F.format_string("%s: MoM %.2f%%, YoY %.2f%%", "tech", "mom_growth", "yoy_growth").alias("line"))


@query("o035_growth", "WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.event_type, a.day, a.n, CASE WHEN coalesce(b.n, 0) = 0 THEN 0.0 ELSE round((a.n - b.n) / CAST(b.n AS DOUBLE) * 100.0, 2) END AS growth FROM c a LEFT JOIN c b ON a.event_type = b.event_type AND b.day = a.day - INTERVAL 1 DAY")
def daily_growth(spark, d):
    c = S.table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    b = c.select("event_type", F.date_add("day", 1).alias("day"), F.col("n").alias("before"))
    return c.join(b, ["event_type", "day"], "left").select("event_type", "day", "n", growth(F.col("n"), F.col("before")).alias("growth"))


USES = f"{R}, {J}, ev AS (SELECT company, tech, posted AS day FROM r JOIN jb USING (job) UNION ALL SELECT l_suppkey, p_name, CAST(l_shipdate AS DATE) FROM lineitem JOIN part ON l_partkey = p_partkey)"


def evidence(spark, d):
    posted = S.requires(spark, d).join(S.jobs(spark, d), "job").select("company", "tech", F.col("posted").alias("day"))
    return posted.unionByName(S.part_techs(spark, d).select(F.col("l_suppkey").alias("company"), "tech", F.col("l_shipdate").cast("date").alias("day")))


@query("o073_uses_evidence", f"WITH {USES} SELECT company, tech, count(*) AS evidence_count, min(day) AS first_seen, max(day) AS last_seen FROM ev GROUP BY 1, 2")
def uses(spark, d):
    return gold.uses(evidence(spark, d))


@query("o074_related_to", f"WITH {R} SELECT a.tech AS tech_a, b.tech AS tech_b, count(*) AS shared FROM r a JOIN r b ON a.job = b.job AND a.tech < b.tech GROUP BY 1, 2")
def related(spark, d):
    return gold.related(S.requires(spark, d), "job")


STATS = f"{R}, {M}, st AS (SELECT coalesce(a.tech, b.tech) AS tech, coalesce(article_count, 0) AS article_count, coalesce(mention_count, 0) AS mention_count, coalesce(job_count, 0) AS job_count FROM (SELECT tech, count(DISTINCT article) AS article_count, count(*) AS mention_count FROM mm GROUP BY 1) a FULL JOIN (SELECT tech, count(*) AS job_count FROM r GROUP BY 1) b ON a.tech = b.tech)"


@query("o075_tech_stats", f"WITH {STATS} SELECT * FROM st")
def stats(spark, d):
    return gold.tech_stats(S.mentions(spark, d), S.requires(spark, d))


@query("o076_trend_score", f"WITH {STATS} SELECT tech, round((2 * mention_count + job_count) / CAST(3 * (SELECT max(mention_count) FROM st WHERE mention_count > 0) + 1 AS DOUBLE) * 100) / 100 AS trend_score FROM st")
def trend_score(spark, d):
    return gold.trend_score(gold.tech_stats(S.mentions(spark, d), S.requires(spark, d)))


@query("o077_salary_insights", f"WITH {R}, {J}, p AS (SELECT tech, pay FROM r JOIN jb USING (job)), a AS (SELECT tech, count(*) AS jobs, round(quantile_cont(pay, 0.5), 1) AS median_pay, round(avg(pay), 1) AS mean_pay, round(min(pay), 1) AS min_pay, round(max(pay), 1) AS max_pay, round(quantile_cont(pay, 0.25), 1) AS p25_pay, round(quantile_cont(pay, 0.75), 1) AS p75_pay FROM p GROUP BY tech HAVING count(*) >= 5), w AS (SELECT * FROM a ORDER BY jobs DESC, tech LIMIT 30) SELECT * FROM w ORDER BY median_pay DESC, tech LIMIT 10")
def salary_insights(spark, d):
    return gold.pay_statistics(S.requires(spark, d).join(S.jobs(spark, d), "job").select("tech", "pay"), 5, 10)


@query("o078_co_required", f"WITH {R}, t AS (SELECT tech FROM r GROUP BY 1 ORDER BY count(*) DESC, tech LIMIT 1) SELECT a.tech, b.tech AS other, count(*) AS jobs FROM r a JOIN t USING (tech) JOIN r b ON a.job = b.job AND a.tech <> b.tech GROUP BY 1, 2 ORDER BY jobs DESC, other LIMIT 10")
def co_required(spark, d):
    requires = S.requires(spark, d)
    top = gold.demand(requires).orderBy(F.desc("job_count"), "tech").limit(1).select("tech")
    mine = requires.join(F.broadcast(top), "tech")
    return mine.join(requires.select("job", F.col("tech").alias("other")), "job").filter("tech <> other").groupBy("tech", "other").agg(F.count("*").alias("jobs")).orderBy(F.desc("jobs"), "other").limit(10)


@query("o079_company_profile", f"WITH {R}, {J} SELECT company, count(DISTINCT job) AS jobs, count(DISTINCT tech) AS techs, string_agg(DISTINCT tech, ',' ORDER BY tech) AS stack FROM jb JOIN r USING (job) GROUP BY 1 ORDER BY jobs DESC, company LIMIT 500")
def company_profile(spark, d):
    rows = S.jobs(spark, d).join(S.requires(spark, d), "job")
    g = rows.groupBy("company").agg(F.countDistinct("job").alias("jobs"), F.sort_array(F.collect_set("tech")).alias("s"))
    return g.orderBy(F.desc("jobs"), "company").limit(500).select("company", "jobs", F.size("s").cast("long").alias("techs"), F.array_join("s", ",").alias("stack"))


@query("o080_company_context", f"WITH {R}, {J} SELECT c_name AS name, count(DISTINCT job) AS jobs, count(DISTINCT tech) AS techs FROM customer LEFT JOIN jb ON c_custkey = company LEFT JOIN r USING (job) WHERE lower(c_name) = 'customer#000000001' GROUP BY 1")
def company_context(spark, d):
    c = S.table(spark, d, "customer").filter(F.lower("c_name") == "customer#000000001")
    rows = c.join(S.jobs(spark, d), c["c_custkey"] == F.col("company"), "left").join(S.requires(spark, d), "job", "left")
    return rows.groupBy(F.col("c_name").alias("name")).agg(F.countDistinct("job").alias("jobs"), F.countDistinct("tech").alias("techs"))


def first_techs(spark, d, n=5):
    return [r["tech"] for r in S.table(spark, d, "part").select(F.col("p_name").alias("tech")).distinct().orderBy("tech").limit(n).collect()]


@query("o112_job_match", f"WITH {R}, k AS (SELECT tech FROM (SELECT DISTINCT p_name AS tech FROM part) ORDER BY tech LIMIT 5), g AS (SELECT job, count(k.tech) AS matched, count(*) AS required FROM r LEFT JOIN k USING (tech) GROUP BY 1) SELECT job, matched, required, round(matched / CAST(required AS DOUBLE), 4) AS score FROM g WHERE matched > 0 ORDER BY score DESC, matched DESC, job LIMIT 300")
def job_match(spark, d):
    return serving.job_match(S.requires(spark, d), first_techs(spark, d))


@query("o027_job_match_filter", f"WITH {R}, {J}, k AS (SELECT tech FROM (SELECT DISTINCT p_name AS tech FROM part) ORDER BY tech LIMIT 5), g AS (SELECT job, count(k.tech) AS matched, count(*) AS required FROM r LEFT JOIN k USING (tech) GROUP BY 1) SELECT job, level, pay FROM g JOIN jb USING (job) WHERE matched > 0 AND pay >= 100000 AND lower(level) = '1-urgent'")
def job_match_filter(spark, d):
    rows = serving.job_match(S.requires(spark, d), first_techs(spark, d), 2**31 - 1).join(S.jobs(spark, d), "job")
    return rows.filter((F.col("pay") >= 100000) & (F.lower("level") == "1-urgent")).select("job", "level", "pay")


@query("o117_what_if", f"WITH {R}, {J}, k AS (SELECT tech, row_number() OVER (ORDER BY tech) AS i FROM (SELECT DISTINCT p_name AS tech FROM part)), s AS (SELECT 'now' AS scenario, tech FROM k WHERE i <= 5 UNION ALL SELECT 'plus_one', tech FROM k WHERE i <= 6), g AS (SELECT DISTINCT scenario, job FROM s JOIN r USING (tech)) SELECT scenario, count(*) AS matches, round(avg(pay), 2) AS mean_pay FROM g JOIN jb USING (job) GROUP BY 1")
def what_if(spark, d):
    six, jobs = first_techs(spark, d, 6), S.jobs(spark, d)
    one = lambda name, skills: serving.job_match(S.requires(spark, d), skills, 2**31 - 1).select(F.lit(name).alias("scenario"), "job")
    return one("now", six[:5]).unionByName(one("plus_one", six)).join(jobs, "job").groupBy("scenario").agg(F.count("*").alias("matches"), F.round(F.avg("pay"), 2).alias("mean_pay"))


@query("o113_similar_companies", f"WITH {R}, {J}, s AS (SELECT DISTINCT company, tech FROM r JOIN jb USING (job)), me AS (SELECT tech FROM s WHERE company = 1), z AS (SELECT company, count(*) AS size FROM s GROUP BY 1), x AS (SELECT company, count(*) AS shared FROM s JOIN me USING (tech) WHERE company <> 1 GROUP BY 1) SELECT company, shared, round(shared / CAST(size + (SELECT count(*) FROM me) - shared AS DOUBLE), 4) AS jaccard FROM x JOIN z USING (company) ORDER BY jaccard DESC, company LIMIT 20")
def similar_companies(spark, d):
    sets = S.requires(spark, d).join(S.jobs(spark, d), "job").select("company", "tech").distinct()
    return serving.similar_sets(sets, "company", 1, 20)


@query("o114_company_health", f"""WITH {MONTHS}, stack AS (SELECT DISTINCT company, tech FROM r JOIN jb USING (job)),
h AS (SELECT company, tech, least(greatest(50 + coalesce(growth_rate, 0.0) / 2, 0.0), 100.0) AS s FROM stack JOIN la USING (tech)),
k AS (SELECT *, row_number() OVER (PARTITION BY company, s >= 60 ORDER BY s DESC, tech) AS up, row_number() OVER (PARTITION BY company, s < 40 ORDER BY s, tech) AS down FROM h)
SELECT company, count(*) AS techs, CAST(round(avg(s)) AS INTEGER) AS score, coalesce(string_agg(CASE WHEN s >= 60 AND up <= 3 THEN tech END, ',' ORDER BY s DESC, tech), '') AS strengths, coalesce(string_agg(CASE WHEN s < 40 AND down <= 3 THEN tech END, ',' ORDER BY s, tech), '') AS watch,
CASE WHEN CAST(round(avg(s)) AS INTEGER) >= 70 THEN 'strong' WHEN CAST(round(avg(s)) AS INTEGER) >= 45 THEN 'stable' ELSE 'weak' END AS label FROM k GROUP BY company""")
def company_health(spark, d):
    stack = S.requires(spark, d).join(S.jobs(spark, d), "job").select("company", "tech").distinct()
    return serving.company_health(stack, gold.latest(analytics(spark, d)))


@query("o115_recommendation", f"""WITH {MONTHS}, k AS (SELECT tech FROM (SELECT DISTINCT p_name AS tech FROM part) ORDER BY tech LIMIT 3),
rel AS (SELECT DISTINCT a.tech AS a, b.tech AS b FROM r a JOIN r b ON a.job = b.job AND a.tech <> b.tech),
n AS (SELECT b AS tech, count(*) AS co FROM rel JOIN k ON a = k.tech WHERE b NOT IN (SELECT tech FROM k) GROUP BY 1 ORDER BY co DESC, tech LIMIT 30),
m AS (SELECT n.tech, co, coalesce(mom_growth, 0.0) AS mom FROM n LEFT JOIN la USING (tech)), x AS (SELECT max(co) AS mc, max(abs(mom)) AS mm FROM m)
SELECT tech, co, round(0.6 * co / (CASE WHEN mc = 0 THEN 1 ELSE mc END) + 0.4 * mom / (CASE WHEN mm = 0 THEN 1 ELSE mm END), 3) AS score FROM m, x""")
def recommendation(spark, d):
    return serving.recommend(gold.related(S.requires(spark, d), "job"), gold.latest(analytics(spark, d)), first_techs(spark, d, 3))


ROLE = f"{R}, {J}, rs AS (SELECT tech, count(*) AS jobs FROM r JOIN jb USING (job) WHERE pay > 200000 AND level = '2-HIGH' GROUP BY 1 ORDER BY jobs DESC, tech LIMIT 15), ra AS (SELECT tech, count(*) AS jobs FROM r JOIN jb USING (job) WHERE pay > 200000 GROUP BY 1 ORDER BY jobs DESC, tech LIMIT 15), rq AS (SELECT * FROM rs WHERE (SELECT count(*) FROM rs) >= 5 UNION ALL SELECT * FROM ra WHERE (SELECT count(*) FROM rs) < 5)"


def wanted(spark, d):
    return serving.role_skills(S.requires(spark, d), S.jobs(spark, d), F.col("pay") > 200000, "2-HIGH")


@query("o085_role_skills", f"WITH {ROLE} SELECT tech, jobs FROM rq")
def role_skills(spark, d):
    return wanted(spark, d)


@query("o116_skill_gap", f"WITH {ROLE}, k AS (SELECT tech FROM (SELECT DISTINCT p_name AS tech FROM part) ORDER BY tech LIMIT 5), g AS (SELECT tech, jobs FROM rq WHERE lower(tech) NOT IN (SELECT lower(tech) FROM k) ORDER BY jobs DESC, tech LIMIT 10), n AS (SELECT *, row_number() OVER (ORDER BY jobs DESC, tech) AS i FROM g) SELECT tech, jobs, CASE WHEN i <= 5 THEN i END AS step FROM n")
def skill_gap(spark, d):
    return serving.skill_gap(wanted(spark, d), first_techs(spark, d)).withColumn("step", F.col("step").cast("long"))


@query("o118_roadmap", f"WITH {R}, k AS (SELECT tech FROM (SELECT DISTINCT p_name AS tech FROM part) ORDER BY tech LIMIT 5), j AS (SELECT DISTINCT job FROM r JOIN k USING (tech)) SELECT tech, count(*) AS jobs_needing FROM r JOIN j USING (job) WHERE tech NOT IN (SELECT tech FROM k) GROUP BY 1")
def roadmap(spark, d):
    owned, requires = first_techs(spark, d), S.requires(spark, d)
    matches = serving.job_match(requires, owned, 2**31 - 1).select("job")
    return requires.join(matches, "job", "left_semi").filter(~F.col("tech").isin(owned)).groupBy("tech").agg(F.count("*").alias("jobs_needing"))


@query("o123_alert_fanout", f"WITH {MONTHS}, al AS (SELECT tech FROM ta, ao WHERE month = as_of AND job_count > 0 AND mom_growth >= 30), u AS (SELECT DISTINCT o_custkey AS user_id, p_name AS tech FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey) SELECT DISTINCT tech, user_id FROM al JOIN u USING (tech)")
def alert_fanout(spark, d):
    alerts = gold.trend_alerts(analytics(spark, d), S.as_of(S.jobs(spark, d))).select("tech")
    users = S.requires(spark, d).join(S.jobs(spark, d), "job").select(F.col("company").alias("user_id"), "tech").distinct()
    return users.join(alerts, "tech").select("tech", "user_id").distinct()


@query("o024_name_filter", f"WITH {MONTHS} SELECT tech, month, job_count FROM ta WHERE lower(tech) IN (SELECT lower(tech) FROM (SELECT DISTINCT p_name AS tech FROM part ORDER BY tech LIMIT 3))")
def name_filter(spark, d):
    return analytics(spark, d).filter(F.lower("tech").isin([t.lower() for t in first_techs(spark, d, 3)])).select("tech", "month", "job_count")


@query("o030_noise_filter", f"WITH {R} SELECT tech, count(*) AS jobs FROM r GROUP BY 1 HAVING count(*) >= 20 AND NOT regexp_matches(lower(tech), '^(?:blue|old)')")
def noise_filter(spark, d):
    return S.requires(spark, d).groupBy("tech").agg(F.count("*").alias("jobs")).filter((F.col("jobs") >= 20) & ~F.lower("tech").rlike("^(?:blue|old)"))


@query("o050_json_property", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_property(spark, d):
    return S.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("o051_llm_cost", "SELECT o_orderpriority AS model, round(sum(o_custkey / 1e6 * coalesce(p, 0.0) + o_orderkey / 1e6 * coalesce(q, 0.0)), 2) AS cost FROM orders LEFT JOIN (VALUES ('1-URGENT', 0.5, 1.5), ('2-HIGH', 3.0, 15.0)) v(m, p, q) ON m = o_orderpriority GROUP BY 1")
def cost(spark, d):
    prices = spark.createDataFrame([("1-URGENT", 0.5, 1.5), ("2-HIGH", 3.0, 15.0)], "model string, p double, q double")
    o = S.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "model").join(F.broadcast(prices), "model", "left")
    return o.groupBy("model").agg(F.round(F.sum(llm_cost(F.col("o_custkey"), F.col("o_orderkey"), F.col("p"), F.col("q"))).cast("double"), 2).alias("cost"))


@query("o116_level_distance", """WITH l AS (SELECT o_orderkey AS job, CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 5 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 1 END - 4 AS levels FROM orders)
SELECT job, CAST(levels AS INTEGER) AS levels, CAST(3 * levels AS INTEGER) AS months FROM l""")
def level_distance(spark, d):
    """Levels from Middle to the level of each job, and months."""
    names = {"1-URGENT": "Lead", "2-HIGH": "Senior", "3-MEDIUM": "Middle", "4-NOT SPECIFIED": "Junior"}
    level = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("level")], F.lit("Intern"))
    steps = (level_rank(level) - level_rank(F.lit("Middle"))).cast("int")
    return S.jobs(spark, d).select("job", steps.alias("levels"), (3 * steps).alias("months"))
