"""Grid search over clusterings: trials run side by side as Spark jobs, each in a scheduler pool of its own; their results are a table."""

from __future__ import annotations

import itertools
import json
import math
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import density
from tidemark.operators import learning as L
from tidemark.plans.lineage import cut

#: Each takes vectors (id, embedding) and parameters and returns id and label, -1 for noise.
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "kmeans": lambda v, k, seed=42: L.kmeans(v, k, (seed,)).withColumnRenamed("cluster", "label"),
    "dbscan": lambda v, eps, least, around=None: L.dbscan(v, eps, least, around).withColumnRenamed("cluster", "label"),
    "hdbscan": lambda v, least_size, least: density.hdbscan(v, least_size, least).select("id", "label"),
}
SAMPLE = 5000  # rows on which a trial's silhouette is taken
TRIAL = "trial int, algorithm string, params string, clusters long, noise double, silhouette double, davies_bouldin double, calinski_harabasz double, split double, seconds double, failure string"


def parameter_grid(options: dict[str, list]) -> list[dict]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]


def measured(vectors: DataFrame, labels: DataFrame, related: DataFrame | None) -> dict:
    """Clusters, share of noise, and the metrics; those of fewer than two clusters, and a split ratio without pairs, are null."""
    rows = vectors.join(labels, "id")
    count = rows.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k"), F.avg((F.col("label") < 0).cast("double")).alias("noise")).first()
    out = {"clusters": count["k"], "noise": round(count["noise"] if count["noise"] is not None else 1.0, 6)}
    if count["k"] >= 2:
        spread = L.cluster_spread(rows).first()
        out |= {n: spread[n] for n in ("davies_bouldin", "calinski_harabasz")} | {"silhouette": L.silhouette(rows, SAMPLE).first()[0]}
    if related is not None:
        out["split"] = L.split_ratio(related, labels).first()["split_ratio"]
    return {n: None if isinstance(v, float) and not math.isfinite(v) else v for n, v in out.items()}


def search(vectors: DataFrame, trials: list[tuple[str, dict]], related: DataFrame | None = None, at_once: int = 4) -> DataFrame:
    """One row for each of the trials (algorithm, parameters) on vectors (id, embedding), numbered from 1.

    ``at_once`` trials run at a time.  One that fails is a row with its failure, no clusters and
    all noise, and the others go on.  A k of k-means above the number of rows fails.  Trials of
    DBSCAN share the neighbours of all their radii, counted by the first one that comes to it."""
    spark = vectors.sparkSession
    data = cut(vectors.select("id", "embedding"))
    n = data.count()
    radii = sorted({float(p["eps"]) for a, p in trials if a == "dbscan" and isinstance(p.get("eps"), (int, float)) and p["eps"] == p["eps"]})
    first, shared = threading.Lock(), []

    def around() -> tuple[DataFrame, DataFrame]:
        with first:
            if not shared:
                same, counts = L.neighbour_counts(data, radii)
                shared.append((same, cut(counts)))
            return shared[0]

    def run(number: int, algorithm: str, params: dict) -> dict:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{number}")
        row, began = {"trial": number, "algorithm": algorithm, "params": json.dumps(params, sort_keys=True)}, time.perf_counter()
        try:
            if params.get("k", 0) > n:
                raise ValueError(f"k = {params['k']} for {n} rows")
            known = {"around": around()} if algorithm == "dbscan" and float(params["eps"]) in radii else {}
            row |= measured(data, cut(ALGORITHMS[algorithm](data, **params, **known)), related)
        except Exception as e:  # a trial that fails is a result
            row |= {"clusters": 0, "noise": 1.0, "failure": " ".join((str(e) or type(e).__name__).split())[:500]}
        return row | {"seconds": round(time.perf_counter() - began, 3)}

    names = [c.split()[0] for c in TRIAL.split(", ")]
    with ThreadPoolExecutor(at_once) as pool:
        work = [pool.submit(_with_own_properties(run), i, a, p) for i, (a, p) in enumerate(trials, 1)]
        rows = [tuple(w.result().get(c) for c in names) for w in work]
    return spark.createDataFrame(rows, TRIAL)


def _with_own_properties(run: Callable) -> Callable:
    """Runs in a thread whose local properties, the pool's name among them, are copies of the caller's."""

    def inside(*args):
        box: list = []
        thread = InheritableThread(target=lambda: box.append(run(*args)))
        thread.start()
        thread.join()
        return box[0]

    return inside


def judged(trials: DataFrame, most_clusters: int, most_noise: float, least_clusters: int, most_split: float | None = None) -> DataFrame:
    """Trials with passed: no failure, at most so many clusters, so much noise and (if both are known) such a split ratio, and at least the
    smaller of ``least_clusters`` and the most that a trial within the other limits reached."""
    fine = F.col("failure").isNull() & (F.col("clusters") <= most_clusters) & (F.col("noise") <= most_noise)
    if most_split is not None:
        fine = fine & (F.col("split").isNull() | (F.col("split") <= most_split))
    reached = trials.filter(fine).agg(F.coalesce(F.least(F.lit(least_clusters), F.max("clusters")), F.lit(least_clusters)).alias("_floor"))
    return trials.crossJoin(F.broadcast(reached)).withColumn("passed", fine & (F.col("clusters") >= F.col("_floor"))).drop("_floor")


def best(trials: DataFrame, metric: str = "silhouette", larger: bool = True) -> DataFrame:
    """The best of the passed ones: by metric, then smaller split ratio, less noise, more clusters, less time, smaller number; at most one row."""
    by = F.col(metric).desc_nulls_last() if larger else F.col(metric).asc_nulls_last()
    return trials.filter("passed").orderBy(by, F.col("split").asc_nulls_last(), "noise", F.desc("clusters"), "seconds", "trial").limit(1)
