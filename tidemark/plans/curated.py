"""Queries of extraction by dictionaries, periods, alias groups, retrieval plans, signals and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.vocabulary import PLACE_ALIASES, PLACES
from tidemark.operators import curation, gold, learning
from tidemark.plans.registry import query
from tidemark.sources import frames as S


@query("o034_month_arithmetic", """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS before,
CAST(date_trunc('month', o_orderdate) - INTERVAL 1 YEAR AS DATE) AS year_before, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS i FROM orders""")
def month_arithmetic(spark, d):
    m = C.month_of(F.col("o_orderdate"))
    return S.table(spark, d, "orders").select(m.alias("month"), F.add_months(m, -1).alias("before"), F.add_months(m, -12).alias("year_before"), C.month_index(F.col("o_orderdate")).alias("i")).distinct()


NAMES = [*((p.lower(), p) for p in PLACES), *PLACE_ALIASES.items()]
PLACE_ROWS = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(NAMES))


def wrapped(text: str, word: str) -> str:
    """SQL: the text with its words in angle brackets, so that a term with no word beside it is contained in brackets."""
    return rf"regexp_replace({text}, '({word}+)', '<\1>', 'g')"


TERM = r"[\p{L}\p{N}_]"


@query("o039_locations", f"""WITH p(i, k, v) AS (VALUES {PLACE_ROWS}), w AS (SELECT v, {wrapped("k", TERM)} AS k FROM p),
t AS (SELECT doc_id, {wrapped("lower(coalesce(text, '') || ' (' || upper(k) || '), ' || k || 'x')", TERM)} AS t FROM documents JOIN p ON doc_id % {len(NAMES)} = i)
SELECT doc_id, string_agg(DISTINCT v, ',' ORDER BY v) AS places FROM t JOIN w ON contains(t, k) GROUP BY 1""")
def locations(spark, d):
    """Places in documents to whose texts one was added, once as a word and once with a letter after it."""
    known = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(NAMES)], "i int, k string")
    docs = S.table(spark, d, "documents").withColumn("i", (F.col("doc_id") % len(NAMES)).cast("int")).join(F.broadcast(known), "i")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" ("), F.upper("k"), F.lit("), "), "k", F.lit("x"))
    return docs.select("doc_id", F.array_join(C.locations(text), ",").alias("places"))


LETTER = r"[\p{L}\p{N}]"


@query("o040_known_companies", f"""WITH t AS (SELECT c_custkey AS id, 'from ' || upper(s_name) || ', not ' || s_name || '9 to ' || c_name AS text FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)),
n AS (SELECT s_name AS name, {wrapped("lower(s_name)", LETTER)} AS k FROM supplier) SELECT DISTINCT id, name FROM (SELECT id, {wrapped("lower(text)", LETTER)} AS t FROM t) JOIN n ON contains(t, k)""")
def known_companies(spark, d):
    names = S.table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    n = names.count()
    texts = S.table(spark, d, "customer").join(names, F.col("s_suppkey") == F.col("c_custkey") % n)
    texts = texts.select(F.col("c_custkey").alias("id"), F.concat(F.lit("from "), F.upper("name"), F.lit(", not "), "name", F.lit("9 to "), "c_name").alias("text"))
    return curation.known_names(texts, names.select("name"))


@query("o049_periods", """WITH o AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q FROM orders), a AS (SELECT CAST(max(o_orderdate) AS DATE) AS t FROM orders),
p AS (SELECT DISTINCT y || '-Q' || q AS period, make_date(y, q * 3 - 2, 1) AS f, 3 AS n FROM o UNION ALL SELECT y || '-' || lpad(CAST(m AS VARCHAR), 2, '0'), make_date(y, m, 1), 1 FROM o UNION ALL SELECT DISTINCT CAST(y AS VARCHAR), make_date(y, 1, 1), 12 FROM o)
SELECT period, f AS first, CAST(f + n * INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS last FROM p UNION ALL SELECT NULL, CAST(t - INTERVAL 90 DAY AS DATE), t FROM a""")
def periods(spark, d):
    day = S.table(spark, d, "orders").select(F.col("o_orderdate").alias("d"))
    names = day.select(F.explode(F.array(F.concat(F.year("d"), F.lit("-Q"), F.quarter("d")), F.date_format("d", "yyyy-MM"), F.date_format("d", "yyyy"))).alias("period")).distinct()
    last = day.agg(F.max("d").cast("date").alias("as_of")).first()["as_of"]
    named = names.unionByName(spark.createDataFrame([(None,)], "period string")).withColumn("p", C.period(F.col("period"), F.lit(last)))
    return named.select("period", "p.first", "p.last")


@query("o057_bridge", """WITH t AS (SELECT DISTINCT l_orderkey AS job, p_name AS a FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT DISTINCT l_orderkey AS job, s_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT a, b, count(*) AS shared FROM t JOIN s USING (job) GROUP BY ALL""")
def bridge(spark, d):
    skills = S.table(spark, d, "lineitem").join(S.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("job"), F.col("s_nationkey").alias("b"))
    return curation.bridge(S.requires(spark, d).withColumnRenamed("tech", "a"), skills, "job")


@query("o065_pair_enumeration", """WITH t AS (SELECT DISTINCT user_id, event_type AS tech FROM events) SELECT a.tech AS tech_a, b.tech AS tech_b, count(*) AS shared FROM t a JOIN t b ON a.user_id = b.user_id AND a.tech < b.tech GROUP BY ALL""")
def pair_enumeration(spark, d):
    return gold.related(S.table(spark, d, "events").select("user_id", F.col("event_type").alias("tech")).distinct(), "user_id")


STRATEGY = "CASE WHEN turn % 2 = 0 THEN length(text) % 3 END"


@query("o095_strategy_aggregates", f"""SELECT round(avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END), 6) AS pct_graph, round(avg(CASE WHEN coalesce({STRATEGY}, 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_expansion,
round(avg(CASE WHEN text LIKE '%e.%' THEN 1.0 ELSE 0.0 END), 6) AS pct_sql, round(avg(length(text)), 6) AS avg_triples FROM conversations""")
def strategy_aggregates(spark, d):
    rows = S.table(spark, d, "conversations").select((F.col("role") == "user").alias("use_graph"), F.when(F.col("turn") % 2 == 0, F.length("text") % 3).alias("depth"), F.col("text").contains("e.").alias("use_sql"), F.length("text").alias("triples"))
    return curation.strategy_shares(rows)


NODES = """n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS name, split_part(p_name, ' ', 2) AS canonical FROM part),
j AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS jobs FROM lineitem GROUP BY 1),
rp AS (SELECT id, first_value(id) OVER w AS representative, canonical FROM n LEFT JOIN j USING (id) WINDOW w AS (PARTITION BY canonical ORDER BY CASE WHEN name = canonical THEN 0 ELSE 1 END, coalesce(jobs, 0) DESC, length(name), name, id))"""


def mapping(spark, d):
    base = F.split_part("p_name", F.lit(" "), F.lit(2))
    nodes = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, base).otherwise(F.col("p_name")).alias("name"), base.alias("canonical"))
    jobs = S.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_orderkey").alias("jobs"))
    return curation.representatives(nodes, jobs)


@query("o100_representatives", f"WITH {NODES} SELECT * FROM rp")
def representatives(spark, d):
    return mapping(spark, d)


@query("o138_edge_canonicalisation", f"""WITH {NODES}, e AS (SELECT l_partkey AS tech_id_a, (l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM part) AS tech_id_b FROM lineitem)
SELECT DISTINCT a.representative AS tech_id_a, b.representative AS tech_id_b FROM e JOIN rp a ON a.id = tech_id_a JOIN rp b ON b.id = tech_id_b WHERE a.representative <> b.representative""")
def edge_canonicalisation(spark, d):
    n = S.table(spark, d, "part").count()
    edges = S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("tech_id_a"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % n).alias("tech_id_b"))
    return curation.rewritten(edges, ["tech_id_a", "tech_id_b"], mapping(spark, d))


@query("o121_sentiment_signal", """SELECT p_name AS tech, count(*) AS articles, round(coalesce(avg(CASE WHEN l_linenumber > 2 THEN l_tax END), 0.0), 6) AS sentiment, CAST(0.2 AS DOUBLE) AS weight
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(l_shipdate AS DATE) >= (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) - 90 GROUP BY 1""")
def sentiment_signal(spark, d):
    lines = S.table(spark, d, "lineitem").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    articles = lines.select(F.col("p_name").alias("tech"), F.col("l_shipdate").cast("date").alias("day"), F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("score"))
    return curation.sentiment_signal(articles, str(articles.agg(F.max("day")).first()[0]))


@query("o124_roadmap_alerts", """WITH r AS (SELECT o_custkey AS user, p_name AS tech, p_size - 20.0 AS growth, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, p_name, p_size) AS place
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) SELECT user, tech, CAST(growth AS DOUBLE) AS growth FROM r WHERE place = 1 AND growth >= 10""")
def roadmap_alerts(spark, d):
    lines = S.table(spark, d, "lineitem").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("o_custkey").alias("user"), F.struct("o_orderkey", "l_linenumber", "p_name", "p_size").alias("place"), F.col("p_name").alias("tech"), (F.col("p_size") - 20.0).alias("growth"))
    return curation.roadmap_alerts(rows, 10.0)


@query("o137_alias_sweep", """SELECT DISTINCT name, canonical FROM (SELECT p_name AS name, CASE split_part(p_name, ' ', 2) WHEN 'widget' THEN 'Widget' WHEN 'gadget' THEN 'Gadget' END AS canonical FROM part) WHERE canonical IS NOT NULL""")
def alias_sweep(spark, d):
    names = S.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    kind = F.split_part("name", F.lit(" "), F.lit(2))
    aliases = names.select(F.lower("name").alias("alias_normalized"), F.when(kind == "widget", "Widget").when(kind == "gadget", "Gadget").alias("canonical_name")).filter("canonical_name IS NOT NULL")
    return curation.known_merges(names, aliases)


GROUPS = """g AS (SELECT split_part(p_name, ' ', 2) AS canonical, p_name AS name, ascii(p_name) % 2 = 0 AS sure, ascii(p_name) % 5 = 0 AS decided FROM (SELECT DISTINCT p_name FROM part))"""


@query("o137_review_queue", f"WITH {GROUPS} SELECT name, canonical, CASE WHEN sure THEN 'merge' ELSE 'review' END AS outcome FROM g WHERE sure OR NOT decided")
def review_queue(spark, d):
    rows = S.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumns({"canonical": F.split_part("name", F.lit(" "), F.lit(2)), "code": F.ascii("name")})
    groups = rows.select(F.array("name", "canonical").alias("names"), "canonical", F.when(F.col("code") % 2 == 0, "high").alias("confidence"))
    decided = rows.filter("code % 5 = 0").select(F.upper("canonical").alias("name_a"), F.concat(F.lit(" "), "name").alias("name_b"))
    return curation.proposed(groups, decided)


@query("o142_pending_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id * 2 FROM embeddings WHERE label <> 3)")
def pending_embeddings(spark, d):
    vectors = S.table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("doc_id"), F.when(F.col("label") != 3, F.col("embedding")).alias("embedding"))
    return curation.pending(S.table(spark, d, "documents").select("doc_id"), vectors, "doc_id")


@query("o145_retrieval_plan", r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
q AS (SELECT item_id, list_contains(w, 'the') OR list_contains(w, 'of') AS tech, list_contains(w, 'une') OR list_contains(w, 'der') AS other, list_contains(w, 'that') AS analytics, list_contains(w, 'and') AS hop FROM w)
SELECT item_id AS id, 'vector' AS branch FROM q UNION ALL SELECT item_id, 'graph' FROM q WHERE tech OR other UNION ALL SELECT item_id, CASE WHEN hop THEN 'expansion2' ELSE 'expansion1' END FROM q WHERE tech OR other
UNION ALL SELECT item_id, 'sql' FROM q WHERE tech AND analytics""")
def retrieval_plan(spark, d):
    has = lambda w: F.regexp_like(F.lower("text"), F.lit(rf"(?U)(?<!\w){w}(?!\w)"))
    queries = S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), C.terms(F.col("text"), {"the": "The", "of": "Of"}).alias("techs"), C.terms(F.col("text"), {"une": "Une", "der": "Der"}).alias("others"), has("that").alias("analytics"), has("and").alias("multi_hop"))
    plan = curation.retrieval_plan(queries)
    hits = lambda n: queries.select("id", F.lit(n).alias("hit"), F.lit(1.0).alias("score"))  # noqa: E731  one hit for every query: what is left says which branches were asked
    return curation.retrieved(plan, {n: hits(n) for n in ("vector", "graph", "expansion1", "expansion2", "sql")}).select("id", "branch")


@query("o154_fallback_fill", """WITH v AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE) * 2) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v) SELECT id, round(v[1] / norm, 6) AS first, round(v[64] / norm, 6) AS last FROM n""")
def fallback_fill(spark, d):
    rows = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("n"), F.col("embedding").alias("content"), F.transform(F.reverse("embedding"), lambda x: x.cast("double") * 2).alias("name_vector"))
    return curation.filled_vectors(rows).select("id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(63)), 6).alias("last"))


@query("o163_trial_selection", """WITH t AS (SELECT p_partkey AS trial, p_retailprice AS metric, p_size AS clusters, (p_partkey % 10) / 20.0 AS noise, (p_partkey % 7) / 10.0 AS split, 1.0 AS seconds FROM part),
f AS (SELECT * FROM t WHERE clusters <= 30 AND noise <= 0.3 AND split <= 0.4) SELECT trial, metric, clusters FROM f WHERE clusters >= least(40, (SELECT max(clusters) FROM f)) ORDER BY metric DESC, split, noise, clusters DESC, seconds, trial LIMIT 1""")
def trial_selection(spark, d):
    trials = S.table(spark, d, "part").select(F.col("p_partkey").alias("trial"), F.col("p_retailprice").alias("metric"), F.col("p_size").alias("clusters"), ((F.col("p_partkey") % 10) / 20.0).alias("noise"), ((F.col("p_partkey") % 7) / 10.0).alias("split"), F.lit(1.0).alias("seconds"))
    return learning.select_trial(trials, 30, 0.3, 0.4, 40).select("trial", "metric", "clusters")


@query("o168_champion_gate", """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN true WHEN p_partkey % 2 = 0 THEN p_retailprice < p_size * 60 ELSE p_retailprice > p_size * 60 END AS promoted FROM part""")
def champion_gate(spark, d):
    k = F.col("p_partkey")
    champion = F.when(k % 13 != 0, F.col("p_size") * 60)
    return S.table(spark, d, "part").select("p_partkey", curation.promoted(F.col("p_retailprice"), champion, F.when(k % 2 == 0, "davies_bouldin").otherwise("silhouette"), k % 11 == 0).alias("promoted"))


@query("o186_feature_ablation", """WITH f AS (SELECT l_quantity / 50.0 AS a, l_discount AS b, l_tax AS c FROM lineitem) SELECT 'baseline_all' AS variant, round(var_pop(a) + var_pop(b) + var_pop(c), 6) AS spread, 3 AS features FROM f
UNION ALL SELECT 'no_size', round(var_pop(b) + var_pop(c), 6), 2 FROM f UNION ALL SELECT 'no_rates', round(var_pop(a), 6), 1 FROM f""")
def feature_ablation(spark, d):
    rows = S.table(spark, d, "lineitem").select((F.col("l_quantity") / 50.0).alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"))
    spread = lambda r, columns: r.agg(F.round(sum((F.var_pop(c) for c in columns[1:]), F.var_pop(columns[0])), 6).alias("spread"), F.lit(len(columns)).alias("features"))
    return curation.ablation(rows, {"size": ["a"], "rates": ["b", "c"]}, spread)


@query("o188_name_pca")
def name_pca(spark, d):
    """Components of hashed name vectors, as many as the vectors have and 64 at most."""
    names = S.table(spark, d, "part").select(F.col("p_name").alias("id")).distinct()
    vectors = names.withColumn("embedding", C.hashed_words(F.concat_ws(" ", "id", F.regexp_replace("id", "(.)", "$1 ")), 16))
    return learning.principal(vectors, min(64, 16, names.count()))
