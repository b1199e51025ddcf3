"""Queries of joins, sets, windows, paging, activity, streams in batch form, and the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import graph, serving
from tidemark.plans.registry import query
from tidemark.sources import frames as S
from tidemark.streaming import streams


@query("o060_feed_semi", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def feed(spark, d):
    e = S.table(spark, d, "events")
    return e.join(e.filter("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_semi").select("event_id", "user_id")


@query("o061_suggest_anti", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 300)")
def suggest(spark, d):
    e = S.table(spark, d, "events")
    return e.select("user_id").distinct().join(e.filter("event_type = 'purchase' AND value > 300").select("user_id"), "user_id", "left_anti")


@query("o062_correlated_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer")
def counts(spark, d):
    g = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))
    return S.table(spark, d, "customer").select("c_custkey").join(g, "c_custkey", "left").fillna(0)


@query("o059_last_message", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def last_message(spark, d):
    return serving.newest(S.table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("o102_last_n", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def last_n(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return S.table(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("conv_id", "turn", "role")


@query("o063_conditional_key", "SELECT CASE WHEN o_custkey % 2 = 0 THEN c1.c_name ELSE c2.c_name END AS name, count(*) AS n FROM orders JOIN customer c1 ON o_custkey = c1.c_custkey JOIN customer c2 ON c2.c_custkey = CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END GROUP BY 1")
def conditional_key(spark, d):
    o = S.table(spark, d, "orders").withColumn("k", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1))
    c = S.table(spark, d, "customer").select("c_custkey", "c_name")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_custkey", "k", F.col("c_name").alias("n1")).join(c.withColumnRenamed("c_custkey", "k"), "k")
    return j.groupBy(F.when(F.col("o_custkey") % 2 == 0, F.col("n1")).otherwise(F.col("c_name")).alias("name")).agg(F.count("*").alias("n"))


@query("o064_polymorphic_join", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN s_name END, CASE WHEN l_linenumber % 2 = 1 THEN p_name END) AS target FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey")
def polymorphic(spark, d):
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    j = li.join(S.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    even = F.col("l_linenumber") % 2 == 0
    return j.select("l_orderkey", "l_linenumber", F.coalesce(F.when(even, F.col("s_name")), F.when(~even, F.col("p_name"))).alias("target"))


@query("o054_pattern_join", "SELECT r_name, n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def pattern(spark, d):
    s, n, r = (S.table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"))


@query("o055_optional_collect", "SELECT c_custkey, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderpriority IS NOT NULL))[1:3], ','), '') AS levels FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def optional(spark, d):
    c, o = S.table(spark, d, "customer"), S.table(spark, d, "orders")
    j = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.array_join(F.slice(F.sort_array(F.collect_set("o_orderpriority")), 1, 3), ",").alias("levels"))
    return j


@query("o056_relation_union", "SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderstatus IN ('O', 'F') UNION ALL SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def relation_union(spark, d):
    o = S.table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "F")).select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return o.union(S.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey", "l_orderkey")).distinct()


@query("o068_as_of_join", "SELECT event_id, user_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts <= e.ts) AS last_view FROM events e WHERE event_type = 'purchase'")
def as_of_join(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    e = S.table(spark, d, "events").withColumn("last_view", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w))
    return e.filter("event_type = 'purchase'").select("event_id", "user_id", "last_view")


@query("o067_cross_series", "SELECT r_name, i FROM region, range(1, 13) t(i)")
def cross_series(spark, d):
    return S.table(spark, d, "region").select("r_name").crossJoin(F.broadcast(S.series(spark, 1, 12, "i").withColumn("i", F.col("i").cast("long"))))


@query("o010_series", "SELECT i FROM range(0, 48) t(i)")
def series(spark, d):
    return S.series(spark, 0, 47, "i").withColumn("i", F.col("i").cast("long"))


@query("o105_paged_listing", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def paged(spark, d):
    return S.table(spark, d, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("o106_bounded_fetch", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 150")
def bounded(spark, d):
    return S.table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(150).select("l_orderkey", "l_linenumber")


@query("o177_point_lookup", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def lookup(spark, d):
    return S.table(spark, d, "orders").filter("o_custkey = 7").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_orderdate")


@query("o107_symmetrise", "SELECT DISTINCT a AS src, b AS dst FROM (SELECT l_orderkey AS a, l_suppkey AS b FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey FROM lineitem)")
def symmetrise(spark, d):
    return graph.symmetric(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("o109_priority_concat", "WITH u AS (SELECT o_orderkey AS k, o_custkey AS c, 1 AS prio FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, o_custkey, 2 FROM orders WHERE o_totalprice > 200000), n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY prio, k) AS rn FROM u) SELECT c, k, prio FROM n WHERE rn = 1")
def priority(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), "o_orderpriority", "o_totalprice")
    u = o.filter("o_orderpriority = '1-URGENT'").withColumn("prio", F.lit(1)).unionByName(o.filter("o_totalprice > 200000").withColumn("prio", F.lit(2)))
    return u.groupBy("c").agg(F.min(F.struct("prio", "k")).alias("x")).select("c", "x.k", "x.prio")


@query("o111_set_operations", "SELECT 'both' AS op, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT 'only', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def set_operations(spark, d):
    k = lambda f: S.table(spark, d, "lineitem").filter(F.col("l_returnflag") == f).select("l_orderkey")
    one = lambda name, f: f.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return one("both", k("R").intersect(k("A"))).unionByName(one("only", k("R").exceptAll(k("A"))))


@query("o096_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return S.table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("o012_insert_absent", "WITH n AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 2 = 1), o AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT k, v FROM o UNION ALL SELECT k, v FROM n WHERE rn = 1 AND k NOT IN (SELECT k FROM o)")
def insert_absent(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return serving.insert_absent(o.filter("v % 2 = 0").groupBy("k").agg(F.min("v").alias("v")), o.filter("v % 2 = 1"), "k", "v")


@query("o013_upsert", "WITH a AS (SELECT user_id, event_id AS version, value FROM events) SELECT user_id, max(version) AS version, max_by(value, version) AS value FROM a GROUP BY 1")
def upsert(spark, d):
    e = S.table(spark, d, "events").select("user_id", F.col("event_id").alias("version"), "value")
    return serving.upsert(e.filter("version % 2 = 0"), e.filter("version % 2 = 1"), ["user_id"], "version")


@query("o014_null_preserving_upsert", "WITH a AS (SELECT user_id, event_id AS version, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS kind FROM events) SELECT user_id, max_by(kind, version) FILTER (kind <> '') AS kind, max(version) AS version FROM a GROUP BY 1")
def null_preserving(spark, d):
    e = S.table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("kind"), F.col("event_id").alias("version"))
    return serving.upsert(e.limit(0), e, ["user_id"], "version", keep=("kind",))


@query("o015_merge_edges", "SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def merge_edges(spark, d):
    o, li = S.table(spark, d, "orders"), S.table(spark, d, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).dropDuplicates(["src", "dst"])


@query("o016_soft_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'invalid' ELSE 'processed' END AS status FROM orders")
def soft_delete(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "invalid").otherwise("processed").alias("status"))


@query("o019_outbox_selection", "SELECT event_id AS id FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'PENDING' WHEN event_id % 3 = 1 THEN 'FAILED' ELSE 'PUBLISHED' END AS status, event_id % 7 AS attempts FROM events) WHERE status = 'PENDING' OR (status = 'FAILED' AND attempts < 5) ORDER BY ts, event_id LIMIT 100")
def outbox(spark, d):
    from tidemark.sources.sinks import outbox_next

    i = F.col("event_id")
    e = S.table(spark, d, "events").select(i.alias("id"), F.col("ts").alias("created_at"), F.when(i % 3 == 0, "PENDING").when(i % 3 == 1, "FAILED").otherwise("PUBLISHED").alias("status"), (i % 7).alias("attempts"))
    return outbox_next(e, 5, 100).select("id")


@query("o020_run_log", "SELECT job, run_id, seconds FROM (SELECT event_type AS job, event_id AS run_id, CAST(event_id % 60 AS BIGINT) AS seconds, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def run_log(spark, d):
    from tidemark.sources.sinks import run_durations

    e = S.table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("run_id"), F.lit("ok").alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    return run_durations(e.withColumn("finished_at", F.expr("started_at + make_interval(0, 0, 0, 0, 0, 0, run_id % 60)"))).select("job", "run_id", "seconds")


@query("o086_trending_types", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def trending_types(spark, d):
    e = S.table(spark, d, "events")
    start = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("start"))
    return e.join(F.broadcast(start), e["ts"] >= start["start"]).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


@query("o087_activity_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS visits, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def activity(spark, d):
    return S.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("visits"), F.countDistinct("user_id").alias("users"))


@query("o088_top_posters", "SELECT user_id, count(*) AS posts FROM events GROUP BY 1 ORDER BY posts DESC, user_id LIMIT 10")
def posters(spark, d):
    return S.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "user_id").limit(10)


@query("o089_message_metrics", "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def messages(spark, d):
    return S.table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("conversations"))


@query("o187_dashboard", "SELECT (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM customer) AS companies, (SELECT count(DISTINCT p_name) FROM part) AS technologies, (SELECT count(*) FROM events) AS activities")
def dashboard(spark, d):
    one = lambda t, name, c="*": S.table(spark, d, t).agg((F.count(c) if c == "*" else F.countDistinct(c)).alias(name))
    return one("orders", "jobs").crossJoin(one("customer", "companies")).crossJoin(one("part", "technologies", "p_name")).crossJoin(one("events", "activities"))


@query("o173_tumbling", 'SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2')
def tumbling(spark, d):
    e = streams.event_time(S.table(spark, d, "events"))
    return streams.tumbling(e, "ts", "event_type", "value", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("o176_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS \"start\", count(*) AS n FROM k GROUP BY user_id, i")
def sessions(spark, d):
    e = streams.event_time(S.table(spark, d, "events"))
    return streams.sessions(e, "ts", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


EDGES = "e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'POSTED_BY' AS type FROM orders UNION ALL SELECT DISTINCT 's' || l_suppkey, 'o' || l_orderkey, 'USES' FROM lineitem)"


def edges(spark, d):
    o = S.table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("POSTED_BY").alias("type"))
    li = S.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("o"), "l_orderkey").alias("dst"), F.lit("USES").alias("type")).distinct()
    return o.unionByName(li)


@query("o090_edge_census", f"WITH {EDGES} SELECT type, count(*) AS edges FROM e GROUP BY 1")
def census(spark, d):
    return graph.census(edges(spark, d))


@query("o091_orphans", f"WITH {EDGES} SELECT 'c' || c_custkey AS id FROM customer WHERE 'c' || c_custkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e) UNION ALL SELECT 'o' || (o_orderkey + 1000000000) FROM orders WHERE o_orderkey < 10")
def orphans(spark, d):
    nodes = S.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    ghosts = S.table(spark, d, "orders").filter("o_orderkey < 10").select(F.concat(F.lit("o"), (F.col("o_orderkey") + 1000000000).cast("string")).alias("id"))
    return graph.orphans(nodes.unionByName(ghosts), edges(spark, d))


@query("o092_coverage", "SELECT round(count(quality) * 100.0 / count(*), 1) AS quality_pct, round(count(toxic) * 100.0 / count(*), 1) AS toxic_pct FROM documents LEFT JOIN labels USING (doc_id)")
def coverage(spark, d):
    t = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id", "left")
    return t.agg(*(F.round(F.count(c) * 100.0 / F.count("*"), 1).alias(f"{c}_pct") for c in ("quality", "toxic")))


@query("o094_case_duplicates", "SELECT lower(p_brand) AS key, count(*) AS n FROM (SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT upper(p_brand) FROM part) GROUP BY 1 HAVING count(*) > 1")
def case_duplicates(spark, d):
    b = S.table(spark, d, "part").select("p_brand")
    return b.union(b.select(F.upper("p_brand"))).distinct().groupBy(F.lower("p_brand").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


@query("o131_degree", f"WITH {EDGES}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS id, count(*) AS degree FROM s GROUP BY 1")
def degree(spark, d):
    return graph.degree(edges(spark, d))


@query("o127_two_hop", f"WITH {EDGES}, k AS (SELECT DISTINCT src, dst FROM e), one AS (SELECT src, dst FROM k WHERE src = 's1'), two AS (SELECT k.src, k.dst FROM one JOIN k ON k.dst = one.dst AND k.src <> one.src) SELECT DISTINCT src, dst, hop FROM (SELECT src, dst, 1 AS hop FROM one UNION ALL SELECT src, dst, 2 FROM two UNION ALL SELECT one.src, one.dst, 2 FROM one JOIN two ON one.dst = two.dst) ORDER BY hop, src, dst LIMIT 100")
def two_hop(spark, d):
    seeds = spark.createDataFrame([("s1",)], "id string")
    return graph.expand(edges(spark, d), seeds, 2, 100)


@query("o128_neighbours", f"WITH {EDGES}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), a AS (SELECT 'c1' AS id, 0 AS hop), b AS (SELECT DISTINCT dst AS id, 1 AS hop FROM s WHERE src = 'c1'), c AS (SELECT DISTINCT dst AS id, 2 AS hop FROM s JOIN b ON src = b.id WHERE dst NOT IN (SELECT id FROM a UNION SELECT id FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def near(spark, d):
    return graph.neighbours(edges(spark, d), spark.createDataFrame([("c1",)], "id string"), 2)


def small_edges(spark, d):
    """Technologies that share jobs."""
    from tidemark.operators import gold

    return gold.related(S.requires(spark, d), "job").select(F.col("tech_a").alias("src"), F.col("tech_b").alias("dst"), "shared")


SHARED = """r AS (SELECT DISTINCT l_orderkey AS job, p_name AS tech FROM lineitem JOIN part ON l_partkey = p_partkey),
    s AS (SELECT a.tech AS src, b.tech AS dst, count(*) AS w FROM r a JOIN r b ON a.job = b.job AND a.tech <> b.tech GROUP BY ALL)"""


@query(
    "o129_shortest_path",
    f"""WITH RECURSIVE {SHARED}, ends AS (SELECT min(src) AS a, max(dst) AS b FROM s WHERE src < dst),
    w(id, parent, hop) USING KEY (id) AS (SELECT a, CAST(NULL AS VARCHAR), 0 FROM ends
    UNION SELECT s.dst, min(s.src), min(w.hop) + 1 FROM w JOIN s ON s.src = w.id WHERE w.hop < 8 AND s.dst NOT IN (SELECT id FROM recurring.w) GROUP BY s.dst),
    path AS (SELECT w.* FROM w JOIN ends ON id = b UNION ALL SELECT w.* FROM path JOIN w ON w.id = path.parent)
    SELECT hop AS step, id FROM path""",
)
def path(spark, d):
    ends = small_edges(spark, d).agg(F.min("src").alias("a"), F.max("dst").alias("b")).first()
    found = graph.shortest_path(small_edges(spark, d), ends["a"], ends["b"]) or []
    return spark.createDataFrame([(i, x) for i, x in enumerate(found)], "step int, id string")


@query(
    "o130_pagerank",
    f"""WITH RECURSIVE {SHARED}, a AS (SELECT src, dst, w / CAST(sum(w) OVER (PARTITION BY src) AS DOUBLE) AS share FROM s),
    k AS (SELECT DISTINCT src AS id, CAST(1 AS DOUBLE) AS p, 0 AS i FROM s
    UNION ALL SELECT dst, 0.15 + 0.85 * sum(share * p), min(i) + 1 FROM k JOIN a ON src = id WHERE i < 20 GROUP BY dst)
    SELECT id, round(p, 6) AS pagerank FROM k WHERE i = 20""",
)
def pagerank(spark, d):
    return graph.pagerank(small_edges(spark, d), weight="shared").select("id", F.round("pagerank", 6).alias("pagerank"))


@query(
    "o132_communities",
    f"""WITH RECURSIVE {SHARED}, k AS (SELECT DISTINCT src AS id, src AS c, 0 AS i FROM s
    UNION ALL SELECT id, first(c ORDER BY v DESC, c), min(i) + 1 FROM (SELECT id, c, sum(v) AS v, min(i) AS i
    FROM (SELECT s.src AS id, k.c, CAST(s.w AS DOUBLE) AS v, k.i FROM k JOIN s ON s.dst = k.id WHERE k.i < 10 UNION ALL SELECT id, c, 0, i FROM k WHERE i < 10) GROUP BY 1, 2) GROUP BY id),
    l AS (SELECT id, c FROM k WHERE i = 10), n AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS g FROM l GROUP BY c)
    SELECT id, CAST(CASE WHEN g < 6 THEN g ELSE 99 END AS INTEGER) AS "group" FROM l JOIN n USING (c)""",
)
def communities(spark, d):
    return graph.largest_communities(graph.communities(small_edges(spark, d), "shared"))


@query("o132_louvain")
def louvain(spark, d):
    """Communities by modularity, the six largest ones named; tests compare their modularity with label propagation's."""
    return graph.largest_communities(graph.louvain(small_edges(spark, d), "shared"))


@query(
    "o133_components",
    f"""WITH RECURSIVE {EDGES}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    w(id, component) USING KEY (id) AS (SELECT src, least(src, min(dst)) FROM s GROUP BY src
    UNION SELECT s.src, min(w.component) FROM w JOIN s ON s.dst = w.id JOIN recurring.w r ON r.id = s.src WHERE w.component < r.component GROUP BY s.src)
    SELECT id, component FROM w""",
)
def components(spark, d):
    return graph.connected(edges(spark, d), most=None)


FASTRP = ", ".join(f"e{n} AS (SELECT a.src AS id, x.i, sum(share * v) AS v FROM a JOIN e{n - 1} x ON x.id = a.dst GROUP BY ALL)" for n in (1, 2, 3))
UNITS = " UNION ALL ".join(f"SELECT id, i, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM e{n}" for n in (1, 2, 3))


@query(
    "o134_fastrp",
    f"""WITH {SHARED}, a AS (SELECT src, dst, w / CAST(sum(w) OVER (PARTITION BY src) AS DOUBLE) AS share FROM s), d AS (SELECT DISTINCT src AS id FROM s),
    g AS (SELECT id, unnest(range(64)) AS i FROM d), hs AS (SELECT id, i, CAST('0x' || substr(md5(id || ':' || i || ':42'), 1, 8) AS BIGINT) % 6 AS h FROM g),
    e0 AS (SELECT id, i, CASE h WHEN 0 THEN sqrt(3.0) ELSE -sqrt(3.0) END AS v FROM hs WHERE h < 2), {FASTRP},
    u AS (SELECT id, i, sum(v) AS v FROM ({UNITS}) GROUP BY ALL)
    SELECT id, CAST(i AS INTEGER) AS i, round(coalesce(v, 0.0), 6) + 0.0 AS value FROM g LEFT JOIN u USING (id, i)""",
)
def fastrp(spark, d):
    out = graph.fastrp(small_edges(spark, d), "shared")
    return out.select("id", F.posexplode("vector").alias("i", "v")).select("id", "i", (F.round("v", 6) + F.lit(0.0)).alias("value"))


@query("o134_node2vec")
def node2vec(spark, d):
    return graph.node2vec(small_edges(spark, d))


@query("o135_merge_nodes", "WITH m AS (SELECT DISTINCT p_name AS dup, min(p_name) OVER (PARTITION BY lower(substr(p_name, 1, 3))) AS canonical FROM part), e AS (SELECT DISTINCT a.tech AS src, b.tech AS dst FROM r a JOIN r b ON a.job = b.job AND a.tech < b.tech) SELECT DISTINCT coalesce(x.canonical, src) AS src, coalesce(y.canonical, dst) AS dst FROM e LEFT JOIN m x ON src = x.dup LEFT JOIN m y ON dst = y.dup WHERE coalesce(x.canonical, src) <> coalesce(y.canonical, dst)".replace("WITH m", "WITH r AS (SELECT DISTINCT l_orderkey AS job, p_name AS tech FROM lineitem JOIN part ON l_partkey = p_partkey), m"))
def merge(spark, d):
    names = S.table(spark, d, "part").select(F.col("p_name").alias("dup")).distinct()
    first = names.groupBy(F.lower(F.substring("dup", 1, 3)).alias("k")).agg(F.min("dup").alias("canonical"))
    mapping = names.join(first, F.lower(F.substring("dup", 1, 3)) == first["k"]).select("dup", "canonical")
    return graph.merge_nodes(small_edges(spark, d).select("src", "dst"), mapping)


@query("o136_duplicate_names", "WITH f AS (SELECT lower(p_name) AS k, min(p_partkey) AS canonical FROM part GROUP BY 1 HAVING count(*) > 1) SELECT p_partkey AS dup, canonical FROM part JOIN f ON lower(p_name) = k WHERE p_partkey <> canonical")
def duplicate_names(spark, d):
    nodes = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Technology").alias("label"), F.col("p_name").alias("name"))
    return graph.duplicate_names(nodes)


@query("o066_contained_names", "WITH c AS (SELECT DISTINCT p_name AS core FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) SELECT a.core AS a, b.core AS b FROM c a JOIN c b ON a.core <> b.core AND contains(' ' || b.core || ' ', ' ' || a.core || ' ')")
def contained(spark, d):
    p = S.table(spark, d, "part")
    cores = p.select(F.col("p_name").alias("core")).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct().select(F.col("core").alias("id"), "core")
    return graph.contained_names(cores).select(F.col("core_a").alias("a"), F.col("core_b").alias("b"))


@query("o179_nodes_by_type", "SELECT 'Nation' AS label, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation UNION ALL SELECT 'Region', CAST(r_regionkey AS VARCHAR), r_name FROM region")
def nodes_by_type(spark, d):
    return graph.union_nodes({"Nation": (S.table(spark, d, "nation"), "n_nationkey", "n_name"), "Region": (S.table(spark, d, "region"), "r_regionkey", "r_name")})


@query("o139_triples_json")
def triples(spark, d):
    return graph.triples_json(two_hop(spark, d))


@query("o167_snapshot_checks", "SELECT * FROM (SELECT 'orders.rows' AS \"check\", 'info' AS severity, count(*) AS n FROM orders UNION ALL SELECT 'orders.repeated', 'error', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'orders.null_o_orderkey', 'error', count(*) - count(o_orderkey) FROM orders UNION ALL SELECT 'orders.null_o_custkey', 'error', count(*) - count(o_custkey) FROM orders UNION ALL SELECT 'lines.orphans', 'warn', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def snapshot_checks(spark, d):
    o = S.table(spark, d, "orders")
    return serving.checks({"orders": (o, "o_orderkey", ["o_custkey"])}, {"lines": (S.table(spark, d, "lineitem").select("l_orderkey"), o.select("o_orderkey"))})


@query("o182_census", "SELECT 'part' AS label, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'embedding_dimension', max(len(embedding)) FROM embeddings")
def table_census(spark, d):
    n = lambda t: S.table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("label"), "n")
    size = S.table(spark, d, "embeddings").agg(F.max(F.size("embedding")).cast("long").alias("n")).select(F.lit("embedding_dimension").alias("label"), "n")
    return n("part").unionByName(n("orders")).unionByName(size)


@query("o183_categories", "SELECT p_name AS tech, min(p_type) AS category FROM part WHERE p_type LIKE '%A%' GROUP BY 1")
def categories(spark, d):
    return S.table(spark, d, "part").filter(F.col("p_type").contains("A")).groupBy(F.col("p_name").alias("tech")).agg(F.min("p_type").alias("category"))


@query("o004_silver_scan", "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND n_chars >= 200")
def silver_scan(spark, d):
    return S.table(spark, d, "documents").filter("lang = 'en' AND n_chars >= 200").select("doc_id", "lang")


@query("o005_node_fetch", "WITH r AS (SELECT DISTINCT l_orderkey AS job, p_name AS tech FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT tech, count(*) AS degree FROM r GROUP BY 1 HAVING count(*) >= 100")
def node_fetch(spark, d):
    return S.requires(spark, d).groupBy("tech").agg(F.count("*").alias("degree")).filter("degree >= 100")


@query("o006_edge_fetch", "SELECT DISTINCT l_orderkey AS job, p_name AS tech FROM lineitem JOIN part ON l_partkey = p_partkey")
def edge_fetch(spark, d):
    return S.requires(spark, d)


@query("o178_company_mentions", "SELECT l_suppkey AS company, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 3 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 20")
def company_mentions(spark, d):
    return S.table(spark, d, "lineitem").filter("l_suppkey = 3").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(20).select(F.col("l_suppkey").alias("company"), "l_orderkey", "l_linenumber")


@query("o026_graph_filter", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_totalprice BETWEEN 50000 AND 150000 ORDER BY o_orderkey LIMIT 100")
def graph_filter(spark, d):
    o, c = S.table(spark, d, "orders"), S.table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("o_totalprice").between(50000, 150000)).orderBy("o_orderkey").limit(100).select("o_orderkey")
