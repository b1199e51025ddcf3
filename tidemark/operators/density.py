"""Hierarchical density clustering: spanning trees of mutual reachability, condensed trees, stabilities, validity.

1. ``core_distances``: the distance to the k-th nearest other vector.
2. ``reach_tree``: the minimum spanning tree of max(core a, core b, distance).  Edges up to a
   radius, that nine tenths of the core distances reach, come from tiles, each of which keeps
   only its own minimum spanning forest; Boruvka rounds join components by their lightest edges.
   Then each component but the largest looks for its lightest edge to another one among all
   vectors, and the same rounds join along these, until one component is left.
3. ``condensed``: the tree's edges, in order, in buckets of BUCKET.  The subtrees of a bucket
   are groups of their own; a component below the least size carries its few members, a larger
   one only sums, so a task holds at most a bucket.
4. Stabilities, probabilities and outlier scores are aggregates over what left each cluster;
   the nearest selected cluster above each is found by pointer jumping.

Equal vectors are measured once and hang on one of them at their core distance.  Edges of
equal weight are ordered by their ids, so results are the same in every run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import tiles
from tidemark.operators.graph import connected
from tidemark.operators.learning import distinct_vectors, kth_nearest, ordered
from tidemark.plans.lineage import cut

BUCKET = 1_000_000  # edges of the spanning tree that one pass works on
FEW_LINKS = 1_000_000  # between components, that one task joins


def least_links(links: DataFrame) -> DataFrame:
    """The lightest link (w, a, b) of each pair of components (ca, cb), once, without inner ones."""
    pair = [F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")]
    return links.filter("ca <> cb").groupBy(*pair).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("ca", "cb", "e.*")


FOREST = pa.schema([(c, pa.float64() if c == "w" else pa.int64()) for c in ("a", "b", "w", "comp", "into")])


def lightest_forest(links: pa.Table) -> pa.Table:
    """Few links: the edges (a, b, w) of their minimum spanning forest, and where the components go (comp, into)."""
    over: dict[int, int] = {}
    rows = []

    def find(x: int) -> int:
        over.setdefault(x, x)
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    for e in links.sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")]).to_pylist():
        one, two = sorted((find(e["ca"]), find(e["cb"])))
        if one != two:
            over[two] = one
            rows.append({c: e[c] for c in "abw"})
    rows += [{"comp": c, "into": find(c)} for c in list(over)]
    return pa.Table.from_pylist(rows, FOREST)


def boruvka(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lightest edges (a, b, w) that join components (ca, cb), and where these go: (comp, into).

    Each round takes the lightest link of every component and joins along them, so the number
    of components at least halves; what is left when there are FEW_LINKS fits one task."""
    spark = links.sparkSession
    links = cut(least_links(links))
    chosen, moved = spark.createDataFrame([], "a long, b long, w double"), None

    def follow(step: DataFrame) -> DataFrame:
        if moved is None:
            return step
        later = moved.join(step.toDF("into", "next"), "into", "left").select("comp", F.coalesce("next", "into").alias("into"))
        return cut(later.unionByName(step.join(moved, "comp", "left_anti")))

    while links.count() > FEW_LINKS:
        sides = links.select(F.col("ca").alias("c"), "*").union(links.select(F.col("cb").alias("c"), "*"))
        best = cut(sides.groupBy("c").agg(F.min(F.struct("w", "a", "b", "ca", "cb")).alias("e")).select("e.*").distinct())
        chosen = chosen.unionByName(best.select("a", "b", "w"))
        step = connected(best.select(F.col("ca").alias("src"), F.col("cb").alias("dst")), most=None).toDF("comp", "into")
        moved = follow(step)
        named = links.join(step.toDF("ca", "na"), "ca", "left").join(step.toDF("cb", "nb"), "cb", "left")
        links = cut(least_links(named.select(F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb"), "w", "a", "b")))
    last = cut(links.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lightest_forest, "a long, b long, w double, comp long, into long"))
    moved = follow(last.filter("comp IS NOT NULL").select("comp", "into"))
    return chosen.unionByName(last.filter("a IS NOT NULL").select("a", "b", "w")), moved


def reach_tree(points: DataFrame) -> DataFrame:
    """a, b, w: the minimum spanning tree of points (id, embedding, core), embeddings apart, by mutual reachability."""
    radius = points.agg(F.percentile_approx("core", 0.9)).first()[0]
    if radius is None:
        return points.sparkSession.createDataFrame([], "a long, b long, w double")
    links = tiles.reach_links(points, radius)
    label = points.select("id", F.col("id").alias("comp"))
    tree, moved = boruvka(links.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"))
    while True:
        tree = cut(tree)
        label = cut(label.join(moved, "comp", "left").select("id", F.coalesce("into", "comp").alias("comp")))
        sizes = label.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").limit(2).collect()
        if len(sizes) <= 1:
            return tree
        named = cut(points.join(label, "id"))
        ways = tiles.reach_ways(named.filter(F.col("comp") != F.lit(sizes[0]["comp"])), named)
        lightest = ways.groupBy("ca").agg(F.min(F.struct("w", "a", "b", "cb")).alias("e")).select("ca", "e.*")
        edges, moved = boruvka(lightest)
        tree = tree.unionByName(edges)


def core_distances(vectors: DataFrame, k: int) -> DataFrame:
    """id, embedding, core of distinct vectors, and n, how often they occur; k is lowered to the number of others there are."""
    same = distinct_vectors(vectors)
    total = same.agg(F.sum("n")).first()[0] or 0
    k = min(k, total - 1)
    if k < 1:
        return same.withColumn("core", F.lit(0.0))
    return cut(same.join(kth_nearest(same, k).toDF("id", "core"), "id"))


def spanning_tree(vectors: DataFrame, k: int) -> DataFrame:
    """a, b, w over all rows of vectors (id, embedding) without nulls or NaN; rows that equal another hang on it."""
    points = core_distances(vectors, k)
    tree = reach_tree(points.select("id", "embedding", "core"))
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    copies = rows.join(points.select("embedding", F.col("id").alias("a"), "core"), "embedding").filter("id <> a")
    return cut(tree.unionByName(copies.select("a", F.col("id").alias("b"), F.col("core").alias("w"))))


# A component: rep (what edges call it), size, cluster (null below the least size), points (of a small one), and of its cluster:
# lambdas (sum of the lambdas at which points left), here (greatest of them), below (greatest of the clusters in it), value (of what is selected below), births (of its children).
STATE = "rep long, size long, cluster long, points array<long>, lambdas double, here double, below double, value double, children int"
OUT = f"kind string, item long, parent long, lambda double, stability double, wins boolean, {STATE}"
KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}


def merge_subtree(states: list[dict], edges: list[dict], least: int) -> list[dict]:
    """One subtree's edges in order: rows of points that leave a cluster (exit), clusters that end in a larger one (cluster), components that are left (state) and where the others went (map)."""
    parts = {s["rep"]: s for s in states}
    over = {rep: rep for rep in parts}
    rows = []

    def find(x: int) -> int:
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    def big(part: dict) -> bool:
        return part["size"] >= least

    def leave(part: dict, cluster: int, at: float) -> None:
        rows.extend({"kind": "exit", "item": p, "parent": cluster, "lambda": at} for p in part["points"])

    for edge in sorted(edges, key=lambda e: e["rank"]):
        one, two = parts.pop(find(edge["a"])), parts.pop(find(edge["b"]))
        at, number = (1.0 / edge["w"] if edge["w"] > 0 else float("inf")), edge["rank"]
        one, two = (one, two) if (one["size"], -one["rep"]) >= (two["size"], -two["rep"]) else (two, one)
        over[two["rep"]] = one["rep"]
        new = dict(one, size=one["size"] + two["size"])
        if big(two):  # two clusters end here
            new |= {"cluster": number, "lambdas": at * new["size"], "here": at, "below": at, "value": 0.0, "children": 2}
            for part in (one, two):
                stability = part["lambdas"] - part["size"] * at
                wins = stability >= part["value"] or part["children"] == 0
                new["value"] += stability if wins else part["value"]
                new["below"] = max(new["below"], part["below"])
                rows.append({"kind": "cluster", "item": part["cluster"], "parent": number, "lambda": at, "size": part["size"], "stability": stability, "wins": wins, "here": part["here"], "below": part["below"], "children": part["children"]})
        elif big(one):  # points leave the cluster that goes on
            leave(two, one["cluster"], at)
            new |= {"lambdas": one["lambdas"] + at * two["size"], "here": max(one["here"], at), "below": max(one["below"], at)}
        elif big(new):  # a cluster is found: all its points leave it here
            leave(one, number, at)
            leave(two, number, at)
            new |= {"cluster": number, "points": [], "lambdas": at * new["size"], "here": at, "below": at, "value": 0.0, "children": 0}
        else:
            new["points"] = one["points"] + two["points"]
        parts[one["rep"]] = new
    rows += [{"kind": "state"} | part for part in parts.values()]
    rows += [{"kind": "map", "item": rep, "parent": find(rep)} for rep in over]
    return rows


def condensed(tree: DataFrame, ids: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """exits (id, cluster, lambda) and clusters (cluster, parent, birth, size, stability, wins, here, below, children) of a spanning tree (a, b, w) over ids (id).

    A cluster of ``least`` points or more is numbered by the edge at which it was found."""
    spark = tree.sparkSession
    ranked = cut(ordered(tree.select("w", "a", "b"), "w", "a", "b").select("a", "b", "w", F.col("rank").cast("long").alias("rank")))
    states = ids.select(
        F.col("id").alias("rep"), F.lit(1).cast("long").alias("size"), F.when(F.lit(least <= 1), F.col("id")).cast("long").alias("cluster"), F.array("id").alias("points"),
        *(F.lit(0.0).alias(c) for c in ("lambdas", "here", "below", "value")), F.lit(0).alias("children"),
    )
    states = cut(states)
    made, rest = [], ranked
    names = [c.split()[0] for c in STATE.split(", ")]
    schema = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in OUT.split(", ")])

    def merge(states: pa.Table, edges: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(merge_subtree(states.select(names).to_pylist(), edges.to_pylist(), least), schema)

    buckets = -(-ranked.count() // BUCKET)
    for bucket in range(buckets):
        own = rest.filter(F.col("rank") <= (bucket + 1) * BUCKET)
        if buckets == 1:  # a whole tree is one subtree
            groups = states.select("rep", F.lit(0).cast("long").alias("g"))
        else:
            groups = connected(own.select(F.col("a").alias("src"), F.col("b").alias("dst")), most=None).toDF("rep", "g")
        left = states.join(groups, "rep")
        right = own.join(groups.toDF("a", "g"), "a")
        out = cut(left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(merge, OUT))
        made.append(out)
        states = cut(states.join(groups, "rep", "left_anti").unionByName(out.filter("kind = 'state'").select(*names)))
        moved = out.filter("kind = 'map'").select(F.col("item").alias("x"), F.col("parent").alias("y"))
        later = rest.filter(F.col("rank") > (bucket + 1) * BUCKET)
        for side in "ab":
            later = later.join(moved.toDF(side, "y"), side, "left").withColumn(side, F.coalesce("y", side)).drop("y")
        rest = cut(later)
    exits = spark.createDataFrame([], "id long, cluster long, lambda double")
    kinds = "cluster long, parent long, birth double, size long, stability double, wins boolean, here double, below double, children int"
    clusters = spark.createDataFrame([], kinds)
    for out in made:
        exits = exits.unionByName(out.filter("kind = 'exit'").select(F.col("item").alias("id"), F.col("parent").alias("cluster"), "lambda"))
        clusters = clusters.unionByName(out.filter("kind = 'cluster'").select(F.col("item").alias("cluster"), "parent", F.col("lambda").alias("birth"), "size", "stability", "wins", "here", "below", "children"))
    return exits, clusters


def hdbscan(vectors: DataFrame, least: int, samples: int | None = None, method: str = "eom", tree: DataFrame | None = None) -> DataFrame:
    """id, label (-1 for noise), probability, outlier of vectors (id, embedding), ids whole numbers, each once.

    ``least`` is the smallest size of a cluster, ``samples`` (the same if None) the neighbours
    that make a core distance; ``method`` eom selects the most stable clusters, leaf those
    without others in them; the cluster of all rows is never selected.  Labels count from 0 by
    the cluster's smallest id.  probability is the lambda at which a point leaves its cluster
    over the greatest there; outlier is 1 less the lambda over the greatest below.  Vectors
    that are null or hold nulls or NaN are noise, with probability 0 and no outlier score."""
    if method not in ("eom", "leaf"):
        raise ValueError(f"no selection method {method}")
    rows = vectors.select(F.col("id").cast("long").alias("id"), "embedding")
    tree = spanning_tree(rows, samples or least) if tree is None else tree
    ids = tree.select(F.col("a").alias("id")).union(tree.select("b")).distinct()
    exits, clusters = condensed(tree, ids, least)
    clusters = cut(clusters)
    picked = clusters.filter("wins" if method == "eom" else "children = 0").select(F.col("cluster").alias("c"), F.lit(True).alias("picked"))
    # For each cluster: the highest picked one from it upwards, by pointers that double their reach.
    jump = cut(clusters.join(picked, clusters["cluster"] == picked["c"], "left").select("cluster", F.col("parent").alias("up"), F.when(F.col("picked"), F.col("cluster")).alias("top")))
    while not jump.filter("up IS NOT NULL").isEmpty():
        above = jump.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"))
        jump = cut(jump.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top")))
    all_clusters = exits.groupBy("cluster").agg(F.max("lambda").alias("own")).join(clusters.select("cluster", "here", "below"), "cluster", "left")
    # The root is no row of clusters: its greatest lambdas come from its exits and from the clusters in it.
    whole = clusters.agg(F.max("below").alias("whole"))
    reach = all_clusters.crossJoin(F.broadcast(whole)).select("cluster", F.coalesce("below", F.greatest("own", "whole")).alias("below"))
    placed = exits.join(jump.select("cluster", "top"), "cluster", "left").join(reach, "cluster")
    greatest = clusters.select(F.col("cluster").alias("top"), F.col("here").alias("greatest"))
    endless = F.col("lambda") == F.lit(float("inf"))
    share = F.when(endless | (F.col("greatest") == 0), 1.0).otherwise(F.least("lambda", "greatest") / F.col("greatest"))
    score = F.when(endless | (F.col("below") == 0), 0.0).otherwise((F.col("below") - F.col("lambda")) / F.col("below"))
    score = F.when(F.col("below") == F.lit(float("inf")), F.when(endless, 0.0).otherwise(1.0)).otherwise(score)
    out = cut(placed.join(greatest, "top", "left").select("id", "top", F.when(F.col("top").isNotNull(), share).otherwise(0.0).alias("probability"), score.alias("outlier")))
    names = ordered(out.filter("top IS NOT NULL").groupBy("top").agg(F.min("id").alias("first")), "first", "top").select("top", (F.col("rank") - 1).cast("int").alias("label"))
    found = out.join(names, "top", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), "probability", "outlier")
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"), "outlier")


def validity(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: clusters, noise_ratio, least_size, most_size, median_size, dbcv of a spanning tree (a, b, w) and labels (id, label), -1 for noise.

    dbcv compares, by the tree's edges, the heaviest one inside a cluster (sparseness) with the
    lightest one to another cluster (separation; twice the heaviest edge of all if there is
    none); clusters weigh by their share of all rows, noise included.  It and the sizes are
    null without a cluster."""
    known = labels.select("id", "label")
    ends = tree.join(known.toDF("a", "la"), "a").join(known.toDF("b", "lb"), "b")
    bounds = tree.agg(F.max("w").alias("heaviest"))
    inner = ends.filter("la = lb AND la >= 0").groupBy(F.col("la").alias("label")).agg(F.max("w").alias("sparse"))
    between = ends.filter("la <> lb AND la >= 0 AND lb >= 0")
    apart = between.select(F.col("la").alias("label"), "w").union(between.select("lb", "w")).groupBy("label").agg(F.min("w").alias("apart"))
    sizes = known.groupBy("label").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") < 0, F.col("n")).otherwise(0)).alias("noise"))
    each = sizes.filter("label >= 0").join(inner, "label", "left").join(apart, "label", "left").crossJoin(F.broadcast(bounds))
    sparse, far = F.coalesce("sparse", F.lit(0.0)), F.coalesce("apart", 2 * F.col("heaviest"))
    index = F.when(F.greatest(sparse, far) > 0, (far - sparse) / F.greatest(sparse, far)).otherwise(0.0)
    found = each.agg(F.count("*").alias("clusters"), F.sum(F.col("n") * index).alias("v"), F.min("n").alias("least_size"), F.max("n").alias("most_size"), F.percentile("n", F.lit(0.5)).alias("median_size"))
    return found.crossJoin(F.broadcast(total)).select(
        "clusters", F.round(F.col("noise") / F.nullif(F.col("total"), F.lit(0)), 6).alias("noise_ratio"), "least_size", "most_size", F.col("median_size").cast("double").alias("median_size"), F.round(F.col("v") / F.nullif(F.col("total"), F.lit(0)), 6).alias("dbcv")
    )
