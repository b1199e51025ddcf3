"""Inverted lists of vectors: each vector is filed under a centroid, and a search reads the lists whose centroids are nearest to its query.

Vectors are divided by their lengths, so that distance and cosine order agree.  Centroids are
fitted on a bounded sample; the index covers every row.  Lists are partitions of a Parquet
table: a search reads the folders of its queries' lists only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import tiles
from tidemark.plans.lineage import cut

#: Rows on which centroids are fitted; the most lists; the rows by which a list's files are counted.
FIT_ROWS, MOST_LISTS, BLOCK_ROWS = 100_000, 4096, 8192
NO_LIST = -1


def unit(vector: Column) -> Column:
    """The vector divided by its length; null if it is null, zero, or holds a null, NaN or infinity."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(wide, lambda x: x / norm))


def build(vectors: DataFrame, folder: str, lists: int | None = None, seed: int = 7) -> None:
    """Writes the index of vectors (id, embedding): centroids, and every row under its list.

    There are as many ``lists`` as the square root of the rows by default, MOST_LISTS at most, and
    fewer where the sample holds fewer different vectors.  The sample is the FIT_ROWS rows with the
    smallest hashes of their ids.  Vectors without a direction (null, zero, not finite) are filed
    under list -1, which no search reads.  Repeated ids are filed each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    rows = vectors.select("id", unit(F.col("embedding")).alias("u"))
    n = rows.count()
    sample = cut(rows.filter("u IS NOT NULL").orderBy(F.xxhash64("id"), "u").limit(FIT_ROWS).select(array_to_vector("u").alias("x")))
    filed = rows.withColumn("list", F.lit(NO_LIST))
    centres: list = []
    if not sample.isEmpty():
        k = min(lists or max(2, math.isqrt(n)), MOST_LISTS)
        model = KMeans(k=max(k, 2), seed=seed, featuresCol="x", predictionCol="list", maxIter=10).fit(sample)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        some = model.transform(rows.filter("u IS NOT NULL").withColumn("x", array_to_vector("u"))).drop("x")
        filed = some.unionByName(filed.filter("u IS NULL"))
    spark.createDataFrame(centres, "list int, centre array<double>").write.parquet(f"{folder}/centroids")
    filed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(n // (BLOCK_ROWS * MOST_LISTS) + 1))).write.partitionBy("list").parquet(f"{folder}/lists")


def nearest_arrays(spark: SparkSession, folder: str, queries: DataFrame, probes: int) -> DataFrame:
    """query, u, lists: the ``probes`` lists whose centroids have the largest product with a query's unit vector, the nearest one first."""
    table = spark.read.parquet(f"{folder}/centroids").orderBy("list").limit(MOST_LISTS).collect()
    if not table:
        return queries.select("query", "u", F.array().cast("array<int>").alias("lists")).limit(0)
    names, centres = np.array([r["list"] for r in table], dtype="int32"), np.array([r["centre"] for r in table])

    @F.pandas_udf("array<int>")
    def near(u: pd.Series) -> pd.Series:
        order = np.argsort(-(np.stack(u.to_list()) @ centres.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(names[order]))

    return queries.select("query", "u", near("u").alias("lists"))


def nearest_lists(spark: SparkSession, folder: str, queries: DataFrame, probes: int) -> DataFrame:
    """query, u, list, place of ``nearest_arrays``, one row for each list, place 0 first."""
    return nearest_arrays(spark, folder, queries, probes).select("query", "u", F.posexplode("lists").alias("place", "list"))


def best_of(queries: pa.Table, rows: pa.Table, k: int, spec: pa.Schema, most: int = 1_000_000) -> pa.Table:
    """The ``k`` best rows (id, embedding, list) of each query (id, embedding, and lists if it doesn't ask for all) by products of matrices; products within an error of the k-th are taken again one by one."""
    if not len(queries) or not len(rows):
        return spec.empty_table()
    q, r = tiles.matrix(queries), tiles.matrix(rows)
    qt, rt = np.ascontiguousarray(q.T), np.ascontiguousarray(r.T)
    names, ids, filed = tiles.column(queries, "id"), tiles.column(rows, "id"), tiles.column(rows, "list")
    rank = np.unique(ids, return_inverse=True)[1]
    if "lists" in queries.column_names:
        asked = pa.concat_arrays(queries["lists"].chunks)
        who, what = np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy()), np.asarray(asked.flatten())
        who, what, order = who[np.argsort(what, kind="stable")], np.sort(what), np.argsort(filed, kind="stable")
        meet = [(who[slice(*np.searchsorted(what, [x, x + 1]))], order[slice(*np.searchsorted(filed[order], [x, x + 1]))]) for x in np.unique(filed).tolist()]
    else:
        meet = [(np.arange(len(q)), np.arange(len(r)))]
    least, held = np.full(len(q), -np.inf), [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]

    def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, c = (np.concatenate(part) for part in zip(*held, strict=True))
        order = np.lexsort((rank[j], -np.round(c, 6), i))
        i, j, c = i[order], j[order], c[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        least[i[place == k - 1]] = c[place == k - 1]
        return i[place < k], j[place < k], c[place < k]

    for mine, theirs in meet:
        for s in range(0, len(mine), tiles.STRIP):
            for t in range(0, len(theirs), tiles.WIDE):
                x, y = mine[s : s + tiles.STRIP], theirs[t : t + tiles.WIDE]
                c = q[x] @ r[y].T
                bound = least[x] if c.shape[1] <= k else np.maximum(least[x], np.partition(c, -k, axis=1)[:, -k])
                i, j = np.nonzero(c >= (bound - 2e-6)[:, None])
                i, j, total = x[i], y[j], np.zeros(len(i))
                for one, two in zip(qt, rt, strict=True):
                    total += one[i] * two[j]
                held.append((i, j, total))
                if sum(len(part[0]) for part in held) > most:
                    held = [kept()]
    i, j, c = kept()
    return tiles.typed(spec, {"query": names[i], "id": ids[j], "list": filed[j], "c": c})


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query, id, list, cosine, rank: the ``k`` nearest of queries (query, embedding) among the rows of its ``probes`` nearest lists; of all lists if None, which is exact.

    Queries and rows meet in tiles, each of which keeps ``k`` rows of a query, so neither a large
    list nor many queries end in one task.  Equal cosines (to 6 places) are ranked by id.  Queries
    without a direction have no rows."""
    asked = queries.select("query", unit(F.col("embedding")).alias("u")).filter("u IS NOT NULL")
    filed = spark.read.schema(f"id {dict(queries.dtypes)['query']}, u array<double>, list int").parquet(f"{folder}/lists").filter(F.col("list") != NO_LIST)
    if probes is not None:
        asked = cut(nearest_arrays(spark, folder, asked, probes))
        read = [r["list"] for r in asked.select(F.explode("lists").alias("list")).distinct().collect()]
        filed = filed.filter(F.col("list").isin(read)) if read else filed.limit(0)
    asked, rows = asked.withColumnsRenamed({"query": "id", "u": "embedding"}), filed.select("id", F.col("u").alias("embedding"), "list")
    name, arrow = tiles.kind(asked)
    spec = pa.schema([("query", arrow), ("id", arrow), ("list", pa.int32()), ("c", pa.float64())])
    met = tiles.met(asked, rows, lambda a, b: best_of(a, b, k, spec), f"query {name}, id {name}, list int, c double")
    by = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    met = met.select("query", "id", "list", F.round("c", 6).alias("cosine"))
    return met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def probes_needed(spark: SparkSession, folder: str, queries: DataFrame, k: int, share: float = 0.95, sample: int = 256) -> int:
    """The number of lists in which ``share`` of the exact ``k`` nearest lie, measured on the ``sample`` queries with the smallest hashes; 1 without any."""
    some = cut(queries.orderBy(F.xxhash64("query"), "query").limit(sample))
    places = nearest_lists(spark, folder, some.select("query", unit(F.col("embedding")).alias("u")).filter("u IS NOT NULL"), MOST_LISTS)
    hits = search(spark, folder, some, k).select("query", "list")
    worst = hits.join(places.select("query", "list", "place"), ["query", "list"]).agg(F.percentile("place", share, 1)).first()[0]
    return math.ceil(worst or 0) + 1


def confident(hits: DataFrame, least: float = 0.4, k: int = 5, few: int = 3) -> DataFrame:
    """hits (query, id, cosine, rank) of at least ``least``, ``k`` a query; a query that has none keeps its ``few`` best, marked low_confidence."""
    best = F.max("cosine").over(Window.partitionBy("query"))
    low = F.col("_best") < least
    kept = hits.withColumn("_best", best).filter((low & (F.col("rank") <= few)) | ((F.col("cosine") >= least) & (F.col("rank") <= k)))
    return kept.withColumn("low_confidence", low).drop("_best")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, wanted, recall: the share of the exact hits that were found, by (query, id)."""
    hit = exact.select("query", "id").join(found.select("query", "id").withColumn("_hit", F.lit(1)), ["query", "id"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("wanted"), F.round(F.coalesce(F.sum("_hit") / F.count("*"), F.lit(1.0)), 4).alias("recall"))
