"""Queries of cluster serving, categories and edges between two nodes.  A technology's cluster is the smallest size of its parts, in seven groups, -1 for noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clusters as K
from tidemark.operators import graph
from tidemark.plans.registry import query
from tidemark.sources import frames as S

MEMBERS = "members AS (SELECT p_name AS name, CAST(hash_of % 7 - 1 AS INTEGER) AS label FROM (SELECT p_name, min(p_size) + length(p_name) AS hash_of FROM part GROUP BY 1))"


def members(spark, d):
    t = S.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("s"))
    return t.select("name", ((F.col("s") + F.length("name")) % 7 - 1).cast("int").alias("label"))


@query(
    "o165_cluster_context",
    f"""WITH {MEMBERS}, e AS (SELECT DISTINCT 'company' AS kind, l_suppkey AS user, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT DISTINCT 'job', l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
    n AS (SELECT label, kind, user, count(*) AS n FROM e JOIN members USING (name) WHERE label >= 0 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY n DESC, user) AS rank FROM n) SELECT label, kind, user, n, rank FROM k WHERE rank <= 8""",
)
def cluster_context(spark, d):
    """The eight companies and jobs that use most of a cluster's technologies."""
    m, e = members(spark, d), S.part_techs(spark, d)
    of = lambda column, kind: K.context(m, e.select(F.col(column).alias("user"), F.col("tech").alias("name")), kind)
    return of("l_suppkey", "company").unionByName(of("l_orderkey", "job"))


ASKED = "asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 's' WHEN 2 THEN ' ' || p_name ELSE reverse(p_name) END AS name FROM part)"
LOOKED = f"""{MEMBERS}, {ASKED}, k AS (SELECT name, lower(trim(name)) AS key FROM asked), h AS (SELECT k.name, k.key, m.name AS hit, m.label FROM k LEFT JOIN members m ON m.name = k.key),
    c AS (SELECT h.key, m.name AS near, m.label, 1 - levenshtein(h.key, m.name) / CAST(greatest(length(h.key), length(m.name)) AS DOUBLE) AS s FROM (SELECT DISTINCT key FROM h WHERE hit IS NULL) h JOIN members m ON true),
    b AS (SELECT key, near, label FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, near) AS r FROM c WHERE s >= 0.8) WHERE r = 1 AND label >= 0),
    looked AS (SELECT h.name, coalesce(h.hit, b.near) AS matched, coalesce(h.label, b.label) AS label, CASE WHEN h.hit IS NOT NULL THEN 'found' WHEN b.near IS NOT NULL THEN 'provisional' ELSE 'missing' END AS status FROM h LEFT JOIN b USING (key))"""


def looked_up(spark, d):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    asked = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(name, F.lit("s"))).when(k == 2, F.concat(F.lit(" "), name)).otherwise(F.reverse(name))
    return K.lookup(S.table(spark, d, "part").select(asked.alias("name")), members(spark, d))


@query("o180_name_lookup", f"WITH {LOOKED} SELECT * FROM looked")
def name_lookup(spark, d):
    return looked_up(spark, d)


@query("o180_batch_counts", f"WITH {LOOKED} SELECT count(*) AS asked, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'provisional') AS provisional, count(*) FILTER (status = 'missing') AS missing FROM looked")
def batch_counts(spark, d):
    return K.batch_counts(looked_up(spark, d))


@query(
    "o152_temporal_defaults",
    """WITH m AS (SELECT p_name AS name, CASE WHEN p_name LIKE 'red %' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day, CASE WHEN l_linenumber < 5 AND p_name NOT LIKE '% ring' THEN l_discount - 0.05 END AS sentiment FROM lineitem JOIN part ON l_partkey = p_partkey),
    t AS (SELECT max(CAST(l_shipdate AS DATE)) AS today FROM lineitem), a AS (SELECT name, date_diff('day', day, today) AS ago, sentiment FROM m, t)
    SELECT name, coalesce(max(ago), -1) AS first_days, coalesce(min(ago), -1) AS last_days, CASE WHEN count(ago) = 0 THEN 0 ELSE round(skewness(ago), 4) END AS skew, CASE WHEN count(ago) = 0 THEN 0 ELSE round(coalesce(avg(sentiment), 0), 4) END AS sentiment FROM a GROUP BY 1""",
)
def temporal_defaults(spark, d):
    """Days and sentiment of mentions; names of one kind have no day, those of another no sentiment."""
    parts = S.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    lines = S.table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_discount", F.col("l_shipdate").cast("date").alias("shipped"))
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    day = F.when(~F.col("name").startswith("red "), F.col("shipped"))
    mood = F.when((F.col("l_linenumber") < 5) & ~F.col("name").endswith(" ring"), F.col("l_discount") - 0.05)
    today = lines.agg(F.max("shipped")).first()[0]
    out = K.temporal(rows.select("name", day.alias("day"), mood.alias("sentiment")), F.lit(today).cast("date"))
    return out.withColumns({c: F.round(c, 4) for c in ("skew", "sentiment")})


def with_categories(spark, d):
    p = S.table(spark, d, "part")
    nodes = p.select(F.col("p_name").alias("name")).distinct().withColumn("category", F.when(F.length("name") % 3 == 0, "old"))
    given = p.filter(F.col("p_size") > 48).select(F.col("p_name").alias("name"), F.when(F.col("p_size") == 49, " ").otherwise(F.col("p_type")).alias("category"))
    return K.categorised(nodes, given)


CATEGORISED = "g AS (SELECT p_name AS name, min(p_type) AS c FROM part WHERE p_size > 49 GROUP BY 1), n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT n.name, coalesce(c, CASE WHEN length(n.name) % 3 = 0 THEN 'old' END) AS category FROM n LEFT JOIN g USING (name))"


@query("o183_categories_set", f"WITH {CATEGORISED} SELECT name, category FROM k")
def categories_set(spark, d):
    return with_categories(spark, d)


@query("o183_pending_names", f"WITH {CATEGORISED} SELECT name, (row_number() OVER (ORDER BY name) - 1) // 5 AS chunk FROM k WHERE category IS NULL")
def pending_names(spark, d):
    return K.pending(with_categories(spark, d), 5)


@query(
    "o137_canonical_categories",
    """WITH n AS (SELECT p_name AS name, split_part(p_name, ' ', 2) AS canonical, min(p_type) FILTER (p_size > 45) AS category FROM part GROUP BY ALL), o AS (SELECT canonical, CASE WHEN length(canonical) = 6 THEN 'own' END AS own FROM (SELECT DISTINCT canonical FROM n))
    SELECT canonical, coalesce(own, arg_min(category, name) FILTER (category IS NOT NULL)) AS category FROM n JOIN o USING (canonical) GROUP BY canonical, own""",
)
def canonical_categories(spark, d):
    """The category of each name that others are merged into: its own, or the first one of theirs."""
    p = S.table(spark, d, "part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("canonical"), "p_type", "p_size")
    own = p.filter(F.length("canonical") == 6).select(F.col("canonical").alias("name"), F.lit("own").alias("category")).distinct()
    return K.first_categories(p.select("name", "canonical").distinct(), p.filter("p_size > 45").select("name", F.col("p_type").alias("category")).unionByName(own))


@query(
    "o179_edges_between",
    """WITH e AS (SELECT 'j' || l_orderkey AS src, 't' || l_partkey AS dst, 'REQUIRES' AS type, l_linenumber AS n FROM lineitem UNION ALL SELECT 'j' || l_orderkey, 't' || l_partkey, 'SUPPLIED', l_suppkey FROM lineitem),
    p AS (SELECT 'j' || l_orderkey AS src, 't' || min(l_partkey) AS dst FROM lineitem GROUP BY l_orderkey) SELECT src, dst, type, n FROM e JOIN p USING (src, dst)""",
)
def edges_between(spark, d):
    """All edges from each posting to its first technology, with type and property."""
    li = S.table(spark, d, "lineitem").select(F.concat(F.lit("j"), "l_orderkey").alias("src"), F.concat(F.lit("t"), "l_partkey").alias("dst"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").cast("long").alias("supplier"), "l_orderkey", "l_partkey")
    kinds = F.array(F.struct(F.lit("REQUIRES").alias("type"), F.col("line").alias("n")), F.struct(F.lit("SUPPLIED").alias("type"), F.col("supplier").alias("n")))
    first = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p")).select(F.concat(F.lit("j"), "l_orderkey").alias("src"), F.concat(F.lit("t"), "p").alias("dst"))
    return graph.edges_between(li.select("src", "dst", F.inline(kinds)), first)


@query("o088_social_totals", "WITH t AS (SELECT max(ts) - INTERVAL 7 DAY AS since FROM events) SELECT count(*) AS posts, count(*) FILTER (ts >= since) AS posts_since, count(DISTINCT user_id) AS posters, count(DISTINCT user_id) FILTER (ts >= since) AS posters_since FROM events, t")
def social_totals(spark, d):
    """Posts and posters, of all time and of the last seven days."""
    e = S.table(spark, d, "events").select("ts", "user_id")
    since = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    late = F.col("ts") >= F.col("since")
    user = F.when(late, F.col("user_id"))
    return e.crossJoin(F.broadcast(since)).agg(F.count("*").alias("posts"), F.count_if(late).alias("posts_since"), F.count_distinct("user_id").alias("posters"), F.count_distinct(user).alias("posters_since"))
