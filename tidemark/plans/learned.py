"""Queries over vectors, features and clusters."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import assembly as assemble
from tidemark.operators import density, grid
from tidemark.operators import learning as L
from tidemark.operators import vector_index
from tidemark.plans.lineage import cut, scratch
from tidemark.plans.registry import query
from tidemark.sources import frames as S

VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


def vectors(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def first_vector(spark, d):
    return S.table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


@query("o140_vector_topk", f"WITH {VEC}, q AS (SELECT e AS q FROM v ORDER BY id LIMIT 1), s AS (SELECT id, list_cosine_similarity(e, q) AS c FROM v, q) SELECT id, round(c, 4) AS cosine, round((1 + c) / 2, 4) AS score FROM s ORDER BY c DESC, id LIMIT 10")
def top(spark, d):
    return L.vector_top(vectors(spark, d), first_vector(spark, d), 10)


@query("o143_threshold_rerank", f"WITH {VEC}, q AS (SELECT e AS q FROM v ORDER BY id LIMIT 1), s AS (SELECT id, list_cosine_similarity(e, q) AS c FROM v, q) SELECT id, round(c, 4) AS cosine, round((1 + c) / 2, 4) AS score FROM s WHERE c >= 0.4 ORDER BY c DESC, id LIMIT 5")
def rerank(spark, d):
    return L.vector_top(vectors(spark, d), first_vector(spark, d), 5, 0.4)


def indexed(spark, d, lists=None):
    """The folder of an index of all embeddings, and the queries: every row whose id is divisible by 50; a search of all lists needs few of them."""
    folder, v = scratch(spark, "vectors"), vectors(spark, d)
    vector_index.build(v.select("id", "embedding"), folder, lists)
    return folder, v.filter("id % 50 = 0").select(F.col("id").alias("query"), "embedding")


@query("o140_index_search")
def index_search(spark, d):
    """Ten nearest by the lists in which 95 % of a sample's exact hits lie; tests/test_vector_index.py measures recall."""
    folder, q = indexed(spark, d)
    return vector_index.search(spark, folder, q, 10, vector_index.probes_needed(spark, folder, q, 10)).select("query", "id", "cosine", "rank")


def four_places(c):
    """Rounded by the scaled number, as the SQL's engine does: 0.38835 * 10000 lies below a half."""
    return F.signum(c) * F.floor(F.abs(c) * 10000 + 0.5) / 10000


NEAREST = "s AS (SELECT q.id AS query, v.id, round(list_cosine_similarity(v.e, q.e), 6) AS cosine FROM v, q), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s)"


@query("o140_exact_search", f"WITH {VEC}, q AS (SELECT * FROM v WHERE id % 50 = 0), {NEAREST} SELECT query, id, round(cosine, 4) AS cosine FROM k WHERE rank <= 10")
def exact_search(spark, d):
    folder, q = indexed(spark, d, 2)
    return vector_index.search(spark, folder, q, 10).select("query", "id", four_places(F.col("cosine")).alias("cosine"))


@query(
    "o143_low_confidence",
    f"""WITH {VEC}, q AS (SELECT id, CASE WHEN id % 100 = 0 THEN list_transform(e, lambda x, i: CASE WHEN i % 2 = 1 THEN -x ELSE x END) ELSE e END AS e FROM v WHERE id % 50 = 0), {NEAREST},
    b AS (SELECT *, max(cosine) OVER (PARTITION BY query) < 0.4 AS low FROM k) SELECT query, id, round(cosine, 4) AS cosine, low AS low_confidence FROM b WHERE CASE WHEN low THEN rank <= 3 ELSE rank <= 5 AND cosine >= 0.4 END""",
)
def low_confidence(spark, d):
    """Five hits of 0.4 or more; a query without any (those bent away from all rows) keeps its three best, marked."""
    folder, q = indexed(spark, d, 2)
    bent = F.transform("embedding", lambda x, i: F.when((F.col("query") % 100 == 0) & (i % 2 == 0), -x).otherwise(x))
    hits = vector_index.search(spark, folder, q.withColumn("embedding", bent), 5)
    return vector_index.confident(hits, 0.4, 5, 3).select("query", "id", four_places(F.col("cosine")).alias("cosine"), "low_confidence")


@query("o144_rerank_by_source", f"WITH {VEC}, q AS (SELECT e AS q FROM v ORDER BY id LIMIT 1), s AS (SELECT id, label, list_cosine_similarity(e, q) AS c FROM v, q), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(c, 6) DESC, id) AS rn FROM s) SELECT label, id, rn AS rank FROM k WHERE rn <= 3")
def by_source(spark, d):
    from pyspark.sql import Window

    from tidemark.functions.columns import cosine

    q = F.array(*(F.lit(float(x)) for x in first_vector(spark, d)))
    s = vectors(spark, d).withColumn("c", F.round(cosine(F.col("embedding"), q), 6))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("c"), "id")).cast("long")).filter("rank <= 3").select("label", "id", "rank")


@query("o148_tfidf", "WITH r AS (SELECT DISTINCT p_name AS doc, l_suppkey AS token FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT doc, token, 1 AS tf FROM r), n AS (SELECT count(DISTINCT doc) AS n FROM c), f AS (SELECT token, count(*) AS df, sum(tf) AS a FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY a DESC, token LIMIT 50), w AS (SELECT doc, token, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM c JOIN f USING (token), n) SELECT doc, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w")
def tfidf(spark, d):
    c = S.part_techs(spark, d).select(F.col("tech").alias("doc"), F.col("l_suppkey").alias("token")).distinct().withColumn("tf", F.lit(1))
    return L.tfidf(c, 2, 50)


@query("o149_tfidf_jobs", "WITH c AS (SELECT p_name AS doc, lower(o_orderpriority) || '_' || o_orderstatus AS token, count(DISTINCT o_orderkey) AS tf FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc) AS n FROM c), f AS (SELECT token, count(*) AS df, sum(tf) AS a FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY a DESC, token LIMIT 500), w AS (SELECT doc, token, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM c JOIN f USING (token), n) SELECT doc, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w")
def tfidf_jobs(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.concat_ws("_", F.lower("o_orderpriority"), "o_orderstatus").alias("token"))
    c = S.requires(spark, d).join(o, "job").groupBy(F.col("tech").alias("doc"), "token").agg(F.count("*").alias("tf"))
    return L.tfidf(c)


@query("o150_bridge_stats", "WITH r AS (SELECT DISTINCT l_orderkey AS job, p_name AS tech FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT a.tech, count(DISTINCT a.job) AS jobs, count(DISTINCT b.tech) AS co FROM r a LEFT JOIN r b ON a.job = b.job AND a.tech <> b.tech GROUP BY 1) SELECT tech, jobs, co FROM s")
def bridge(spark, d):
    r = S.requires(spark, d)
    other = r.select("job", F.col("tech").alias("other"))
    co = r.join(other, "job").filter("tech <> other").select("tech", "other").distinct().groupBy("tech").agg(F.count("*").alias("co"))
    return r.groupBy("tech").agg(F.count("*").alias("jobs")).join(co, "tech", "left").select("tech", "jobs", F.coalesce("co", F.lit(0)).cast("long").alias("co"))


@query("o151_neighbourhood_stats", "SELECT p_name AS tech, round(ln(1 + count(DISTINCT l_orderkey)), 6) AS log_jobs, round(ln(1 + count(DISTINCT l_suppkey)), 6) AS log_companies, round(count(DISTINCT l_orderkey) / CAST(greatest(count(DISTINCT l_suppkey), 1) AS DOUBLE), 4) AS jobs_per_company FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def neighbourhood(spark, d):
    g = S.part_techs(spark, d).groupBy("tech").agg(F.countDistinct("l_orderkey").alias("j"), F.countDistinct("l_suppkey").alias("c"))
    return g.select("tech", F.round(F.log1p("j"), 6).alias("log_jobs"), F.round(F.log1p("c"), 6).alias("log_companies"), F.round(F.col("j") / F.greatest("c", F.lit(1)), 4).alias("jobs_per_company"))


@query("o152_temporal_stats", "WITH m AS (SELECT p_name AS tech, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT max(day) AS last FROM m), a AS (SELECT tech, CAST(date_diff('day', day, last) AS DOUBLE) AS ago FROM m, x) SELECT tech, CAST(max(ago) AS INTEGER) AS oldest, CAST(min(ago) AS INTEGER) AS newest, round(skewness(ago), 4) AS skew FROM a GROUP BY 1")
def temporal(spark, d):
    m = S.mentions(spark, d)
    a = m.crossJoin(F.broadcast(m.agg(F.max("day").alias("last")))).select("tech", F.date_diff("last", "day").cast("double").alias("ago"))
    return a.groupBy("tech").agg(F.max("ago").cast("int").alias("oldest"), F.min("ago").cast("int").alias("newest"), F.round(L.adjusted_skew("ago"), 4).alias("skew"))


@query("o153_mean_embedding", "WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM x GROUP BY 1) SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE) / n), 5) AS v FROM x JOIN n USING (vec_id) GROUP BY 1, 2")
def mean_embedding(spark, d):
    m = L.mean_vectors(vectors(spark, d), "label")
    return m.select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round("v", 5))


@query("o155_feature_assembly", "WITH g AS (SELECT p_name AS tech, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT tech, round((lines - avg(lines) OVER ()) / stddev_pop(lines) OVER () * 0.5, 6) AS lines, round((qty - avg(qty) OVER ()) / stddev_pop(qty) OVER () * 0.5, 6) AS qty FROM g")
def assembly(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("tech"))
    li = S.table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    g = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("tech").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
    z = L.scale(g, ["lines", "qty"], 0.5)
    return z.select("tech", F.round("lines", 6).alias("lines"), F.round("qty", 6).alias("qty"))


@query(
    "o155_feature_pipeline",
    """WITH g AS (SELECT p_name AS tech, CAST(count(*) AS DOUBLE) AS lines, CASE WHEN count(*) % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(sum(l_quantity) AS DOUBLE) END AS qty, min(p_size) AS community FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    k AS (SELECT community, row_number() OVER (ORDER BY count(*) DESC, community) AS place FROM g GROUP BY 1), r AS (SELECT tech, lines, qty, coalesce(place, 0) AS place FROM g LEFT JOIN k USING (community)),
    m AS (SELECT avg(lines) AS ml, stddev_pop(lines) AS sl, avg(qty) FILTER (NOT isnan(qty)) AS mq, stddev_pop(qty) FILTER (NOT isnan(qty)) AS sq, avg(CAST(place = 1 AS INT)) AS m1, stddev_pop(CAST(place = 1 AS INT)) AS s1, avg(CAST(place = 2 AS INT)) AS m2, stddev_pop(CAST(place = 2 AS INT)) AS s2 FROM r)
    SELECT tech, round(CASE WHEN sl > 0 THEN (lines - ml) / sl * 0.5 ELSE 0 END, 6) AS lines, round(CASE WHEN isnan(qty) OR NOT sq > 0 THEN 0 ELSE (qty - mq) / sq * 0.5 END, 6) AS qty,
    round(CASE WHEN s1 > 0 THEN (CAST(place = 1 AS INT) - m1) / s1 ELSE 0 END, 6) AS first, round(CASE WHEN s2 > 0 THEN (CAST(place = 2 AS INT) - m2) / s2 ELSE 0 END, 6) AS second FROM r, m""",
)
def feature_pipeline(spark, d):
    """Groups of counts and of the two largest communities, fitted, saved, loaded and applied."""
    p = S.table(spark, d, "part").select("p_partkey", "p_size", F.col("p_name").alias("tech"))
    li = S.table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    n = F.count("*")
    qty = F.when(n % 7 == 0, F.lit(float("nan"))).otherwise(F.sum("l_quantity").cast("double"))
    g = cut(li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("tech").agg(n.alias("lines"), qty.alias("qty"), F.min("p_size").alias("community")))
    folder = scratch(spark, "features")
    assemble.fit(g, {"stats": ["lines", "qty"], "hot": assemble.one_hot(g, "community", 2)}, weights={"stats": 0.5}).save(folder)
    return assemble.Assembly.load(folder).apply(g).select("tech", *(F.round(F.get(vector_to_array("features"), F.lit(i)), 6).alias(c) for i, c in enumerate(("lines", "qty", "first", "second"))))


@query("o163_grid_search")
def grid_search(spark, d):
    """Trials of two algorithms over all embeddings, neighbours in number taken as related; time is left out."""
    v = vectors(spark, d).select("id", "embedding")
    trials = [("kmeans", p) for p in grid.parameter_grid({"k": [5, 10]})] + [("dbscan", p) for p in grid.parameter_grid({"eps": [0.9, 1.1], "least": [5]})]
    related = v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return grid.judged(grid.search(v, trials, related), 40, 0.5, 10).select("trial", "algorithm", "params", "clusters", "noise", "split", "failure", "passed")


@query("o157_kmeans")
def kmeans(spark, d):
    return L.kmeans(vectors(spark, d), 10, (42, 43))


@query("o156_pca")
def pca(spark, d):
    return L.principal(vectors(spark, d), 8)


DISTANCES = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT x.id AS a, y.id AS b, x.label AS la, y.label AS lb, list_distance(x.e, y.e) AS d FROM v x JOIN v y ON x.id <> y.id)"


@query(
    "o158_dbscan",
    f"""WITH RECURSIVE {DISTANCES}, near AS (SELECT a, b, d FROM p WHERE d <= 0.9), core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) + 1 >= 5),
    w(id, cluster) USING KEY (id) AS (SELECT id, id FROM core
    UNION SELECT a, min(w.cluster) FROM w JOIN near ON b = w.id JOIN core ON core.id = a JOIN recurring.w r ON r.id = a WHERE w.cluster < r.cluster GROUP BY a),
    border AS (SELECT a AS id, first(cluster ORDER BY d, cluster) AS cluster FROM near JOIN w ON b = w.id WHERE a NOT IN (SELECT id FROM core) GROUP BY 1)
    SELECT v.id, coalesce(w.cluster, border.cluster, -1) AS cluster FROM v LEFT JOIN w ON w.id = v.id LEFT JOIN border ON border.id = v.id""",
)
def dbscan(spark, d):
    return L.dbscan(vectors(spark, d).select("id", "embedding"), 0.9, 5)


@query("o159_hdbscan")
def hdbscan(spark, d):
    """Clusters of ten or more; the hierarchy has no SQL, plain loops of tests/test_density.py stand for it."""
    out = density.hdbscan(vectors(spark, d).select("id", "embedding"), 10, 5)
    return out.select("id", "label", F.round("probability", 6).alias("probability"), F.round("outlier", 6).alias("outlier"))


@query("o161_density_validity")
def density_validity(spark, d):
    """DBCV, noise and sizes of the given labels by the spanning tree of all rows; the other metrics of them beside."""
    v = vectors(spark, d)
    row = density.validity(density.spanning_tree(v.select("id", "embedding"), 5), v.select("id", "label"))
    return row.crossJoin(F.broadcast(L.cluster_spread(v).drop("clusters", "n")))


@query("o160_k_distance", f"""WITH {DISTANCES}, k AS (SELECT a AS id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) WHERE r = 5)
SELECT id, d, row_number() OVER (ORDER BY d, id) AS rank, round(d - lag(d) OVER (ORDER BY d, id), 6) AS step FROM k""")
def k_distance(spark, d):
    return L.nearest_distance(vectors(spark, d).select("id", "embedding"), 5).withColumn("rank", F.col("rank").cast("long"))


CENTRES = "l AS (SELECT vec_id AS id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label >= 0), c AS (SELECT label AS other, i, avg(x) AS c FROM l GROUP BY ALL)"


@query(
    "o161_cluster_spread",
    f"""WITH {CENTRES}, f AS (SELECT id, label, sum((x - c) * (x - c)) AS d2 FROM l JOIN c ON l.i = c.i AND label = other GROUP BY ALL),
    s AS (SELECT label, count(*) AS size, sum(d2) AS within, avg(sqrt(d2)) AS s FROM f GROUP BY 1), g AS (SELECT i, avg(x) AS g FROM l GROUP BY 1),
    b AS (SELECT other AS label, sum((c - g) * (c - g)) AS b2 FROM c JOIN g USING (i) GROUP BY 1),
    ch AS (SELECT count(*) AS k, CAST(sum(size) AS BIGINT) AS n, sum(size * b2) AS b, sum(within) AS w FROM s JOIN b USING (label)),
    m AS (SELECT x.other AS p, y.other AS q, sqrt(sum((x.c - y.c) * (x.c - y.c))) AS m FROM c x JOIN c y ON x.i = y.i AND x.other <> y.other GROUP BY ALL),
    r AS (SELECT p, max((sp.s + sq.s) / m) AS r FROM m JOIN s sp ON sp.label = p JOIN s sq ON sq.label = q GROUP BY 1)
    SELECT k AS clusters, n, round(b / (k - 1) / (w / (n - k)), 4) AS calinski_harabasz, (SELECT round(avg(r), 4) FROM r) AS davies_bouldin FROM ch""",
)
def spread(spark, d):
    return L.cluster_spread(vectors(spark, d))


@query("o161_silhouette", f"""WITH {DISTANCES}, m AS (SELECT a, la, lb, avg(d) AS d FROM p WHERE la >= 0 AND lb >= 0 GROUP BY ALL), s AS (SELECT a, max(CASE WHEN la = lb THEN d END) AS i, min(CASE WHEN la <> lb THEN d END) AS o FROM m GROUP BY 1)
SELECT round(avg(CASE WHEN i IS NULL OR o IS NULL THEN 0.0 ELSE (o - i) / greatest(o, i) END), 4) AS silhouette FROM s""")
def silhouette(spark, d):
    return L.silhouette(vectors(spark, d))


@query("o162_split_ratio", "WITH p AS (SELECT DISTINCT least(a.vec_id, a.vec_id + 1) AS a, a.vec_id + 1 AS b FROM embeddings a) SELECT count(*) AS pairs, round(avg(CASE WHEN x.label <> y.label THEN 1.0 ELSE 0.0 END), 4) AS split_ratio FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE x.label >= 0 AND y.label >= 0")
def split(spark, d):
    v = vectors(spark, d)
    return L.split_ratio(v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), v.select("id", "label"))


@query("o164_near_clusters", f"""WITH {CENTRES}, f AS (SELECT id, label, other, sqrt(sum((x - c) * (x - c))) AS d FROM l JOIN c USING (i) WHERE label <> other GROUP BY ALL),
k AS (SELECT id, label, other, round(1 - d / max(d) OVER (PARTITION BY id), 4) AS closeness FROM f) SELECT * FROM k WHERE closeness >= 0.04""")
def near_clusters(spark, d):
    return L.near_clusters(vectors(spark, d), 0.04)


@query("o165_top_members", f"""WITH {CENTRES}, f AS (SELECT label, id, round(sum(x * c) / sqrt(sum(x * x)) / sqrt(sum(c * c)), 4) AS cosine FROM l JOIN c ON l.i = c.i AND label = other GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, id) AS rank FROM f) WHERE rank <= 25""")
def members(spark, d):
    return L.top_members(vectors(spark, d), 25).withColumn("rank", F.col("rank").cast("long"))


@query("o181_cluster_sizes", "SELECT label, count(*) AS n FROM embeddings WHERE label >= 0 GROUP BY 1")
def sizes(spark, d):
    return vectors(spark, d).filter("label >= 0").groupBy("label").agg(F.count("*").alias("n"))


@query("o180_cluster_detail", "SELECT label, count(*) OVER (PARTITION BY label) AS n, vec_id AS id FROM embeddings WHERE label >= 0")
def detail(spark, d):
    """A cluster's size beside each of its members, one row each."""
    v = vectors(spark, d).filter("label >= 0")
    return v.select("label", "id").join(v.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "n", "id")


@query("o166_corpus", "SELECT lang, source, doc_id, text, count(*) OVER (PARTITION BY lang, source) AS docs FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def corpus(spark, d):
    """The texts of each (lang, source), one row each, with their number."""
    t = S.table(spark, d, "documents").filter("text IS NOT NULL AND trim(text) <> ''").select("lang", "source", "doc_id", "text")
    n = t.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.count("*").alias("docs"))
    return t.join(n, t["lang"].eqNullSafe(n["l"]) & t["source"].eqNullSafe(n["s"])).drop("l", "s")
