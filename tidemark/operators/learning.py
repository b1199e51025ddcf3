"""Vector retrieval, features and clustering over frames."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cosine
from tidemark.operators import tiles
from tidemark.operators.graph import connected
from tidemark.plans.lineage import cut


#: The driver's singular value decomposition keeps state between calls: two at once fail to converge, so one is fitted at a time.
DECOMPOSITION = threading.Lock()


def vector_top(vectors: DataFrame, query: list[float], n: int, least: float | None = None) -> DataFrame:
    """id, cosine, score ((1 + cosine) / 2), the n nearest of vectors (id, embedding), with cosine of ``least`` or more; the order is that of the cosines before they are rounded."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = vectors.select("id", cosine(F.col("embedding"), q).alias("c"))
    out = out if least is None else out.filter(F.col("c") >= least)
    return out.orderBy(F.desc("c"), "id").limit(n).select("id", F.round("c", 4).alias("cosine"), F.round((1 + F.col("c")) / 2, 4).alias("score"))


def tfidf(counts: DataFrame, min_df: int = 2, most: int = 500) -> DataFrame:
    """doc, token, weight: L2-normal tf * (ln((1 + N) / (1 + df)) + 1) of counts (doc, token, tf), tokens of min_df documents, the most frequent ``most``."""
    n = counts.agg(F.countDistinct("doc").alias("n"))
    df = counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).filter(F.col("df") >= min_df).orderBy(F.desc("all"), "token").limit(most)
    raw = counts.join(F.broadcast(df), "token").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))).select("doc", "token", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def long_form(vectors: DataFrame, *keep: str) -> DataFrame:
    """One row for each dimension (i, v) of an embedding."""
    return vectors.select(*keep, F.posexplode("embedding").alias("i", "x")).withColumn("v", F.col("x").cast("double")).drop("x")


def centroids(vectors: DataFrame) -> DataFrame:
    """label, i, c of vectors (label, embedding)."""
    return long_form(vectors, "label").groupBy("label", "i").agg(F.avg("v").alias("c"))


def mean_vectors(vectors: DataFrame, group: str, weight: Column | None = None, least: int = 1) -> DataFrame:
    """group, embedding: (weighted) means of L2-normal vectors; zeros below ``least`` vectors."""
    w = F.lit(1.0) if weight is None else weight
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = vectors.withColumns({"_w": w, "_norm": norm}).select(group, "_w", "_norm", F.posexplode("embedding").alias("i", "x"))
    m = rows.groupBy(group, "i").agg((F.sum(F.col("_w") * F.col("x") / F.nullif(F.col("_norm"), F.lit(0.0))) / F.sum("_w")).alias("m"), F.count("*").alias("n"))
    value = F.when(F.col("n") >= least, F.coalesce("m", F.lit(0.0))).otherwise(0.0)
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("embedding"))


def cluster_spread(vectors: DataFrame) -> DataFrame:
    """One row: clusters, n, Calinski-Harabasz and Davies-Bouldin of vectors (id, label, embedding); rows labelled -1 are noise."""
    v = vectors.filter("label >= 0")
    c = centroids(v)
    far = long_form(v, "id", "label").join(F.broadcast(c), ["label", "i"]).groupBy("id", "label").agg(F.sum((F.col("v") - F.col("c")) * (F.col("v") - F.col("c"))).alias("d2"))
    s = far.groupBy("label").agg(F.count("*").alias("size"), F.sum("d2").alias("within"), F.avg(F.sqrt("d2")).alias("s"))
    whole = long_form(v, "id").groupBy("i").agg(F.avg("v").alias("g"))
    between = c.join(whole, "i").groupBy("label").agg(F.sum((F.col("c") - F.col("g")) * (F.col("c") - F.col("g"))).alias("b2")).join(s, "label")
    ch = between.agg(F.count("*").alias("k"), F.sum("size").alias("n"), F.sum(F.col("size") * F.col("b2")).alias("b"), F.sum("within").alias("w"))
    a, b = (c.select(F.col("label").alias(x), "i", F.col("c").alias(f"c{x}")) for x in ("p", "q"))
    pair = a.join(b, "i").filter("p <> q").groupBy("p", "q").agg(F.sqrt(F.sum((F.col("cp") - F.col("cq")) * (F.col("cp") - F.col("cq")))).alias("m"))
    sp, sq = s.select(F.col("label").alias("p"), F.col("s").alias("sp")), s.select(F.col("label").alias("q"), F.col("s").alias("sq"))
    db = pair.join(sp, "p").join(sq, "q").groupBy("p").agg(F.max((F.col("sp") + F.col("sq")) / F.col("m")).alias("r")).agg(F.avg("r").alias("db"))
    return ch.crossJoin(db).select(F.col("k").alias("clusters"), "n", F.round(F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k"))), 4).alias("calinski_harabasz"), F.round("db", 4).alias("davies_bouldin"))


def squares(x: str, y: str) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


#: Directions of the grid in which close vectors are looked for, and the rows of a cell that meet in one block.
AXES, BLOCK_ROWS = 3, 4096


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """id (the smallest one), embedding, n of each different vector; vectors that are null or hold nulls or NaN are left out."""
    whole = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    whole = whole.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    return cut(whole.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("n")))


def grid_axes(vectors: DataFrame) -> list[list[float]]:
    """Up to AXES orthonormal directions, those of the greatest variance; the first coordinates if there are fewer than two vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    head = vectors.select(F.size("embedding").alias("n")).limit(2).collect()
    size = head[0]["n"] if head else 1
    count = min(AXES, size)
    if len(head) < 2:
        return [[float(i == j) for i in range(size)] for j in range(count)]
    with DECOMPOSITION:
        return PCA(k=count, inputCol="x", outputCol="y").fit(vectors.select(array_to_vector("embedding").alias("x"))).pc.toArray().T.tolist()


def close_pairs(points: DataFrame, others: DataFrame, radius: float, axes: list[list[float]]) -> DataFrame:
    """a, b, d: every vector of ``others`` within ``radius`` of one of ``points``, both (id, embedding) of doubles, ids apart.

    A projection on orthonormal axes makes no distance longer, so partners lie in the same or a
    neighbouring cell of a grid that is ``radius`` wide; only these cells meet, and all their
    pairs are measured.  A cell of more than BLOCK_ROWS rows is dealt into blocks on both sides."""
    width = radius * (1 + 1e-9) + 1e-12
    names = [f"c{i}" for i in range(len(axes))]

    def cells(frame: DataFrame, name: str, vector: str) -> DataFrame:
        dot = lambda axis: F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, axis)), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        return frame.select(F.col("id").alias(name), F.col("embedding").alias(vector), *(F.floor(dot(axis) / width).alias(c) for c, axis in zip(names, axes, strict=True)))

    a, b = cells(points, "a", "ea"), cells(others, "b", "eb")
    for c in names:
        a = a.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    parts = b.groupBy(*names).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    slot = lambda name: F.pmod(F.xxhash64(name), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = a.join(parts, names).select("a", "ea", *names, slot("a").alias("pa"), every.alias("pb"))
    right = b.join(parts, names).select("b", "eb", *names, slot("b").alias("pb"), every.alias("pa"))
    near = left.join(right, [*names, "pa", "pb"]).filter("a <> b").select("a", "b", squares("ea", "eb").alias("d"))
    return near.filter(F.col("d") <= radius)


def silhouette(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """One row: mean silhouette by Euclidean distance of rows (id, label, embedding) without noise; of those with the ``most`` smallest hashes if there are more.

    Ids are unique.  Tiles give a row's sums of distances by label, not its pairs."""
    v = vectors.filter("label >= 0").select("id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    v = cut(v if most is None else v.orderBy(F.xxhash64("id"), "id").limit(most))
    m = tiles.label_sums(v).groupBy("a", "la", "lb").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    per = m.groupBy("a").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("s") / F.col("n"))).alias("inner"), F.min(F.when(F.col("la") != F.col("lb"), F.col("s") / F.col("n"))).alias("outer"))
    value = F.when(F.col("inner").isNull() | F.col("outer").isNull(), 0.0).otherwise((F.col("outer") - F.col("inner")) / F.greatest("inner", "outer"))
    return per.agg(F.round(F.avg(value), 4).alias("silhouette"))


def ordered(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with rank (from 1) and before (the first ``by`` column of the row before), in the order of the columns.

    Rows are sorted in ranges; only a range's number of rows and last value meet in one task."""
    ranges = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))
    inside, across = Window.partitionBy("_range").orderBy(*by), Window.orderBy("_range")
    ends = ranges.groupBy("_range").agg(F.count("*").alias("_n"), F.max(by[0]).alias("_last"))
    ends = ends.select("_range", (F.sum("_n").over(across) - F.col("_n")).alias("_start"), F.lag("_last").over(across).alias("_last"))
    out = ranges.withColumns({"rank": F.row_number().over(inside), "before": F.lag(by[0]).over(inside)}).join(ends, "_range")
    return out.select(*rows.columns, (F.col("rank") + F.col("_start")).alias("rank"), F.coalesce("before", "_last").alias("before"))


def running(rows: DataFrame, weight: str, *by: str) -> DataFrame:
    """Rows with total: the sum of ``weight`` down to the row, in the order of the columns, sorted in ranges as in ``ordered``."""
    ranges = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))
    ends = ranges.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    ends = ends.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return ranges.withColumn("total", F.sum(weight).over(inside)).join(ends, "_range").select(*rows.columns, (F.col("total") + F.col("_start")).alias("total"))


def kth_nearest(same: DataFrame, k: int) -> DataFrame:
    """id, d: the distance to the k-th nearest other row of ``distinct_vectors``, each counted as often as it occurs.

    Every vector meets all others in tiles, each of which keeps its ``k`` nearest.  Without ``k`` others no rows."""
    total = same.agg(F.sum("n")).first()[0] or 0
    if total <= k:
        return same.sparkSession.createDataFrame([], f"id {dict(same.dtypes)['id']}, d double")
    near = tiles.neighbours(same, same, k).union(same.select("id", F.lit(0.0), F.col("n") - 1))
    reached = near.withColumn("all", F.sum("n").over(Window.partitionBy("a").orderBy("d"))).filter(F.col("all") >= k)
    return cut(reached.groupBy(F.col("a").alias("id")).agg(F.min("d").alias("d")))


def nearest_distance(vectors: DataFrame, k: int) -> DataFrame:
    """id, d, rank, step: distances to the k-th nearest, in order, with the rise from the one before (a hint for eps).

    Ids are unique; equal vectors are 0 apart; vectors that hold nulls or NaN, and tables of
    ``k`` rows or fewer, give no rows."""
    same = distinct_vectors(vectors)
    named = same.join(kth_nearest(same, k), "id").select("embedding", F.round("d", 6).alias("d"))
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).join(named, "embedding").select("id", "d")
    return ordered(rows, "d", "id").select("id", "d", "rank", F.round(F.col("d") - F.col("before"), 6).alias("step"))


def neighbour_counts(vectors: DataFrame, radii: list[float]) -> tuple[DataFrame, DataFrame]:
    """``distinct_vectors``, and id, radius, near: how many other vectors lie within each of the radii, all counted in one pass; none of those without any."""
    same = distinct_vectors(vectors)
    return same, tiles.counted(same, *radii).groupBy("radius", "id").agg(F.sum("near").alias("near"))


def dbscan(vectors: DataFrame, eps: float, least: int, around: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, cluster (smallest id of its core points), -1 for noise; border points go to the nearest core point's cluster, ties to the smaller.

    Ids are unique; equal vectors are compared once and counted as often as they occur; vectors that hold nulls or NaN are noise.
    Tiles count neighbours first; then they give links that connect their core points, and the
    core points near others, of which none has ``least``: rows grow with the vectors, not with the pairs within ``eps``.
    ``around``, the ``neighbour_counts`` of the vectors for radii with ``eps`` among them, saves the counting."""
    same, counts = around or neighbour_counts(vectors, [eps])
    around = counts.filter(F.col("radius") == F.lit(float(eps))).select("id", "near")
    marked = same.join(around, "id", "left").select("id", "embedding", (F.col("n") + F.coalesce("near", F.lit(0)) >= least).alias("core"), "near")
    marked = cut(marked.filter("core OR near > 0").drop("near"))
    core = marked.filter("core").select("id")
    rows = marked.agg(F.count("*").alias("all"), F.count_if("core").alias("cores")).first()
    once = 2 * rows["cores"] > rows["all"]  # fewer pairs than all rows with the cores
    near = cut(tiles.linked_once(marked, eps) if once else tiles.linked(marked, marked.filter("core").select("id", "embedding"), eps))
    grouped = connected(near.filter("d IS NULL").select(F.col("a").alias("src"), F.col("b").alias("dst")), most=None)
    named = core.join(grouped, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = near.filter("d IS NOT NULL").join(named.toDF("b", "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min_by("cluster", F.struct("d", "cluster")).alias("cluster"))
    labels = named.unionByName(border)
    if same.filter("n > 1").isEmpty():  # each vector has an id of its own
        return vectors.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    labelled = same.select("id", "embedding").join(labels, "id").select("embedding", "cluster")
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.join(labelled, "embedding", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def near_clusters(vectors: DataFrame, least: float = 0.7) -> DataFrame:
    """id, label, other, closeness: 1 - distance / largest distance to other clusters' centroids, where it reaches ``least``."""
    c = centroids(vectors.filter("label >= 0")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("centre"))
    d = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    far = vectors.filter("label >= 0").crossJoin(F.broadcast(c.withColumnRenamed("label", "other"))).filter("label <> other").select("id", "label", "other", d.alias("d"))
    close = 1 - F.col("d") / F.max("d").over(Window.partitionBy("id"))
    return far.withColumn("closeness", F.round(close, 4)).filter(F.col("closeness") >= least).select("id", "label", "other", "closeness")


def top_members(vectors: DataFrame, n: int = 25) -> DataFrame:
    """label, id, cosine, rank: the members of a cluster nearest to its centroid by cosine."""
    c = centroids(vectors.filter("label >= 0")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("centre"))
    rows = vectors.join(F.broadcast(c), "label").select("label", "id", F.round(cosine(F.col("embedding"), F.col("centre")), 4).alias("cosine"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= n)


def split_ratio(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: related pairs (a, b), unordered, of labelled ids (id, label), and the share in different clusters."""
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = labels.filter("label >= 0")
    j = p.join(known.toDF("a", "la"), "a").join(known.toDF("b", "lb"), "b")
    return j.agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(F.col("la") != F.col("lb"), 1.0).otherwise(0.0)), 4).alias("split_ratio"))


def kmeans(vectors: DataFrame, k: int, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """id, cluster of the run with the smallest cost among the seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    models = [KMeans(k=k, seed=s, featuresCol="features", predictionCol="cluster").fit(data) for s in seeds]
    return min(models, key=lambda m: m.summary.trainingCost).transform(data).select("id", "cluster")


def principal(vectors: DataFrame, size: int) -> DataFrame:
    """id, reduced: principal components of L2-normal vectors, ``size`` at most the dimension."""
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = Normalizer(inputCol="raw", outputCol="x").transform(vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw")))
    with DECOMPOSITION:
        model = PCA(k=size, inputCol="x", outputCol="y").fit(data)
    return model.transform(data).select("id", vector_to_array("y").alias("reduced"))


def scale(features: DataFrame, columns: list[str], weight: float = 1.0) -> DataFrame:
    """Standard scores by the population deviation (0 for constant columns), times a group's weight."""
    stats = features.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    z = {c: F.when(F.col(f"s_{c}") > 0, (F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"m_{c}")) / F.col(f"s_{c}") * weight).otherwise(0.0) for c in columns}
    return features.crossJoin(F.broadcast(stats)).withColumns(z).drop(*(f"{p}_{c}" for c in columns for p in "ms"))


def adjusted_skew(value: str) -> Column:
    """Sample skewness; null below three values."""
    n = F.count(value)
    return F.when(n >= 3, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def select_trial(trials: DataFrame, most_clusters: int, most_noise: float, most_split: float, least_clusters: int) -> DataFrame:
    """The best of trials (trial, metric, clusters, noise, split, seconds) within the limits; if none has least_clusters, the most reached is asked for."""
    fine = trials.filter((F.col("clusters") <= most_clusters) & (F.col("noise") <= most_noise) & (F.col("split") <= most_split))
    floor = fine.agg(F.least(F.lit(least_clusters), F.max("clusters")).alias("floor"))
    return fine.join(F.broadcast(floor), fine["clusters"] >= floor["floor"]).drop("floor").orderBy(F.desc("metric"), "split", "noise", F.desc("clusters"), "seconds", "trial").limit(1)
