"""Property graph as node and edge frames: edges are (src, dst, type, ...), nodes (id, label, name, ...)."""

from __future__ import annotations

import functools
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut


def union_nodes(frames: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(id, label, name) of frames by label, each with the names of its id and name columns."""
    parts = [f.select(F.col(i).cast("string").alias("id"), F.lit(label).alias("label"), F.col(n).cast("string").alias("name")) for label, (f, i, n) in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of the edges, each once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def census(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("edges"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges (src, dst, and what they hold) from the first to the second node of pairs (src, dst), all of each pair; repeated pairs count once."""
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def _few(frame: DataFrame, key: str, name: str, n: int = 3) -> DataFrame:
    """key and up to ``n`` different edges (e) of it, as ``name``: enough to find one that isn't among ``n`` - 1 others."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("e"))
    return frame.select(key, "e").distinct().withColumn("_place", place).filter(F.col("_place") <= n).select(key, F.col("e").alias(name))


def _avoidable(pairs: DataFrame) -> DataFrame:
    """Up to three of the pairs (v, x, y) of each v, one of which is without any given edge if any pair is: one pair, and one without either of its edges."""
    first = pairs.groupBy("v").agg(F.min(F.struct("x", "y")).alias("p"))
    without = lambda edge: F.min(F.when((F.col("x") != edge) & (F.col("y") != edge), F.struct("x", "y")))
    three = pairs.join(first, "v").groupBy("v").agg(F.min("p").alias("p"), without(F.col("p.x")).alias("q"), without(F.col("p.y")).alias("r"))
    return three.select("v", F.explode(F.array("p", "q", "r")).alias("pair")).filter("pair IS NOT NULL").select("v", "pair.x", "pair.y")


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = 100) -> DataFrame:
    """Edges of undirected paths of 1 to ``depth`` (at most 3) hops from seeds (id); (src, dst, hop) once each, no edge twice in a path.

    Paths aren't built: an edge has its place in one if edges before and after it are left that
    differ, and a few of a node's edges tell that, so rows grow with the edges around, not with
    the paths through a hub."""
    depth = max(1, min(depth, 3))
    known = edges.select(F.struct("src", "dst").alias("e"), "src", "dst")
    arcs = known.select("e", F.col("src").alias("a"), F.col("dst").alias("v")).union(known.select("e", F.col("dst").alias("a"), F.col("src").alias("v")))
    leaving = lambda nodes: cut(arcs.join(nodes.select(F.col("v").alias("a")).distinct(), "a").distinct())
    first = leaving(seeds.select(F.col("id").alias("v")))
    found = {1: [first.select("e")]}
    if depth > 1:
        second = leaving(first)
        ends = second.select(F.col("a").alias("v"), "e")
        two = second.join(_few(first, "v", "x").withColumnRenamed("v", "a"), "a").filter("e <> x").select("v", "x", F.col("e").alias("y"))
        found[2] = [two.select("y"), first.join(_few(ends, "v", "y"), "v").filter("e <> y").select("e")]
    if depth > 2:
        third = leaving(two).select(F.col("a").alias("v"), "e")
        last = _few(third, "v", "z")
        after = second.join(last, "v").filter("e <> z").select(F.col("a").alias("v"), F.col("e").alias("x"), F.col("z").alias("y"))
        apart = (F.col("e") != F.col("x")) & (F.col("e") != F.col("y"))
        found[3] = [
            third.join(_avoidable(two), "v").filter(apart).select("e"),
            two.join(last, "v").filter("z <> x AND z <> y").select("y"),
            first.join(_avoidable(after), "v").filter(apart).select("e"),
        ]
    rows = [part.toDF("e").select(F.col("e.src").cast("string").alias("src"), F.col("e.dst").cast("string").alias("dst"), F.lit(hop).alias("hop")) for hop, parts in found.items() for part in parts]
    out = functools.reduce(DataFrame.union, rows).distinct()
    return out if limit is None else out.orderBy("hop", "src", "dst").limit(limit)


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """id, hop: nodes within some hops of the seeds, each at its nearest."""
    both = symmetric(edges)
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        front = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        front = cut(front)
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start, goal, most: int = 8) -> list | None:
    """Nodes of a shortest undirected path of at most ``most`` edges, ties by the smaller parent; None without one.

    A level of the search is a frame; only the nodes of the path reach the driver."""
    spark = edges.sparkSession
    both = cut(symmetric(edges))
    kind = both.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(start, None)], f"id {kind}, parent {kind}")
    front, levels = seen, [seen]
    for _ in range(most):
        front = cut(front.join(both, front["id"] == both["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")).join(seen, "id", "left_anti"))
        if front.isEmpty():
            return None
        levels.append(front)
        if not front.filter(F.col("id") == F.lit(goal)).isEmpty():
            path = [goal]
            for level in reversed(levels[1:]):
                path.append(level.filter(F.col("id") == F.lit(path[-1])).first()["parent"])
            return path[::-1]
        seen = seen.unionByName(front)
    return None


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, weight: str | None = None) -> DataFrame:
    """id, pagerank (not normalised: 1 - d for a node without edges in); lineage is cut every five rounds."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    arcs = edges.select("src", "dst", w.alias("w"))
    arcs = arcs.union(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = arcs.groupBy("src").agg(F.sum("w").alias("total"))
    arcs = cut(arcs.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    rank = out.select(F.col("src").alias("id"), F.lit(1.0).alias("pagerank"))
    for i in range(rounds):
        flow = arcs.join(rank, arcs["src"] == rank["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("pagerank")).alias("in"))
        rank = flow.select("id", (F.lit(1 - damping) + damping * F.col("in")).alias("pagerank"))
        if i % 5 == 4:
            rank = cut(rank)
    return rank


def connected(edges: DataFrame, most: int | None = 50) -> DataFrame:
    """id, component (the smallest id reachable); ``most`` None goes on until no edge is left.

    Each round a node points at the smallest of itself and its neighbours, pointers are followed
    to their ends, and each tree of them becomes one node, named by its smallest id, with the
    edges that lead out of it, once each.  At least half of the nodes that have edges go in a
    round, and later rounds read what is left."""
    loose = (F.col("src").isNull() | F.col("dst").isNull()).alias("loose")
    once = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), loose).filter("a IS NOT NULL").distinct())
    nodes = once.select(F.col("a").alias("id")).union(once.select("b")).distinct()
    missing = once.filter("loose").agg(F.min("a").alias("component")).filter("component IS NOT NULL")  # edges to null link nothing; null is named by the smallest node at them
    missing = missing.select(F.lit(None).cast(once.schema["a"].dataType).alias("id"), "component")
    rest, maps = once.filter("a <> b").select("a", "b"), []
    for _ in itertools.count() if most is None else range(most):
        # A node without smaller neighbours is the end of its tree; the others point at a smaller one.
        point = cut(rest.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")))
        if point.isEmpty():
            break
        while True:  # pointers double their reach
            higher = point.toDF("to", "next")
            step = cut(point.join(higher, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            point = step.select("id", "to")
            if step.filter("moved").isEmpty():
                break
        maps.append(point)
        named = rest.join(point.toDF("a", "ta"), "a", "left").join(point.toDF("b", "tb"), "b").select(F.coalesce("ta", "a").alias("x"), F.col("tb").alias("y"))
        rest = cut(named.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"edges are left after {most} rounds")
    # From the last round back: where a tree's name went is where its nodes go.
    found = None
    for point in reversed(maps):
        if found is not None:
            point = point.join(found.toDF("to", "end"), "to", "left").select("id", F.coalesce("end", "to").alias("to")).union(found)
        found = point
    if found is None:
        return nodes.select("id", F.col("id").alias("component")).union(missing)
    return cut(nodes.join(found, "id", "left").select("id", F.coalesce("to", "id").alias("component")).union(missing))


def communities(edges: DataFrame, weight: str, rounds: int = 10) -> DataFrame:
    """id, community, by weighted label propagation, not by modularity: each round a node takes the heaviest label around, ties to the smaller one."""
    arcs = edges.select("src", "dst", F.col(weight).alias("w"))
    arcs = cut(arcs.union(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    label = arcs.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = arcs.join(label, arcs["dst"] == label["id"]).groupBy("src", "community").agg(F.sum("w").alias("v"))
        own = label.select(F.col("id").alias("src"), "community", F.lit(0).cast("double").alias("v"))
        best = votes.withColumn("v", F.col("v").cast("double")).unionByName(own).groupBy("src", "community").agg(F.sum("v").alias("v"))
        label = cut(best.groupBy("src").agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("community")).withColumnRenamed("src", "id"))
    return label


def largest_communities(label: DataFrame, most: int = 6, rest: int = 99) -> DataFrame:
    """id, group: the largest communities are 0, 1, ...; others ``rest``."""
    sizes = label.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(most)
    order = sizes.withColumn("group", F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1).select("community", "group")
    return label.join(F.broadcast(order), "community", "left").select("id", F.coalesce("group", F.lit(rest)).alias("group"))


def merge_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with duplicates (dup) redirected to their canonical node, once each, without loops."""
    a, b = mapping.select(F.col("dup").alias("src"), F.col("canonical").alias("src2")), mapping.select(F.col("dup").alias("dst"), F.col("canonical").alias("dst2"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").withColumns({"src": F.coalesce("src2", "src"), "dst": F.coalesce("dst2", "dst")}).drop("src2", "dst2")
    return moved.filter("src <> dst").select(*edges.columns).distinct()


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """dup, canonical: nodes of one label whose lower-cased name another one with a smaller id has."""
    first = nodes.groupBy("label", F.lower("name").alias("key")).agg(F.min("id").alias("canonical"), F.count("*").alias("n")).filter("n > 1")
    return nodes.join(first, (nodes["label"] == first["label"]) & (F.lower(nodes["name"]) == first["key"])).filter("id <> canonical").select(F.col("id").alias("dup"), "canonical")


def contained_names(cores: DataFrame) -> DataFrame:
    """a, b, core_a, core_b of cores (id, core) that are equal, or of which a's is a run of whole words in b's.

    Runs of words of the longer name are exploded and joined by equality, so no pair of unrelated names is compared."""
    words = cores.withColumn("w", F.split("core", " "))
    n = F.size("w")
    runs = words.select(F.col("id").alias("b"), F.col("core").alias("core_b"), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda s: F.array_join(F.slice("w", s, i), " "))))).alias("core_a")).distinct()
    return cores.select(F.col("id").alias("a"), F.col("core").alias("core_a")).join(runs, "core_a").filter((F.col("a") != F.col("b")) & ((F.col("core_a") != F.col("core_b")) | (F.col("a") < F.col("b")))).select("a", "b", "core_a", "core_b")


def triples_json(triples: DataFrame) -> DataFrame:
    """hop, triples: JSON of the triples of each hop, in order."""
    return triples.groupBy("hop").agg(F.to_json(F.sort_array(F.collect_list(F.struct("src", "dst")))).alias("triples"))


def random_walks(edges: DataFrame, length: int = 10, walks: int = 10, seed: int = 42) -> DataFrame:
    """start, walk, path: walks along undirected edges; each step takes the neighbour whose hash with walk, step and seed is smallest."""
    both = cut(symmetric(edges))
    at = both.select(F.col("src").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).withColumns({"here": F.col("start"), "path": F.array(F.col("start").cast("string"))})
    for i in range(1, length):
        step = at.join(both, at["here"] == both["src"]).groupBy("start", "walk").agg(F.min_by(F.struct("dst", "path"), F.xxhash64("start", "walk", F.lit(i), "dst", F.lit(seed))).alias("x"))
        at = step.select("start", "walk", F.col("x.dst").alias("here"), F.concat("x.path", F.array(F.col("x.dst").cast("string"))).alias("path"))
        if i % 4 == 3:
            at = cut(at)
    return at.select("start", "walk", "path")


def fastrp(edges: DataFrame, weight: str | None = None, nodes: DataFrame | None = None, size: int = 64, weights: tuple[float, ...] = (0.0, 1.0, 1.0, 1.0), strength: float = 0.0, seed: int = 42) -> DataFrame:
    """id, vector: fast random projection of undirected edges (src, dst).

    Each node starts with hashed signs, two thirds of them zeros, times its degree to the power
    of ``strength``; a round gives it the (weighted) mean of its neighbours' vectors.  The
    vector is the sum of the rounds' unit vectors by ``weights``, the start's first.  Nodes
    (id) without edges get zeros.  Vectors are kept as one row for each value that isn't zero."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    arcs = edges.select("src", "dst", w.alias("w"))
    arcs = arcs.union(arcs.select(F.col("dst"), F.col("src"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = arcs.groupBy("src").agg(F.sum("w").alias("total"), F.count("*").alias("degree"))
    arcs = cut(arcs.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    name = F.concat_ws(":", F.col("src").cast("string"), F.col("i").cast("string"), F.lit(str(seed)))
    draw = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % 6
    value = F.when(draw == 0, 1.0).when(draw == 1, -1.0) * F.sqrt(F.lit(3.0)) * F.pow("degree", F.lit(strength))
    now = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select(F.col("src").alias("id"), "i", value.alias("v")).filter("v IS NOT NULL")
    parts = []
    for n, part in enumerate(weights):
        if n:
            now = cut(arcs.join(now, arcs["dst"] == now["id"]).groupBy(F.col("src").alias("id"), "i").agg(F.sum(F.col("share") * F.col("v")).alias("v")))
        if part:
            norms = now.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).filter("norm > 0")
            parts.append(now.join(norms, "id").select("id", "i", (F.lit(part) * F.col("v") / F.col("norm")).alias("v")))
    every = total.select(F.col("src").alias("id")) if nodes is None else nodes.select("id").distinct()
    if not parts:
        return every.withColumn("vector", F.array_repeat(F.lit(0.0), size))
    summed = functools.reduce(DataFrame.union, parts).groupBy("id", "i").agg(F.sum("v").alias("v"))
    packed = summed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return every.join(packed, "id", "left").select("id", F.coalesce(dense, F.array_repeat(F.lit(0.0), size)).alias("vector"))


def node2vec(edges: DataFrame, size: int = 64, window: int = 5, seed: int = 42) -> DataFrame:
    """id, vector of each node, by Word2Vec over random walks."""
    from pyspark.ml.feature import Word2Vec

    walks = random_walks(edges, seed=seed)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, seed=seed, inputCol="path", outputCol="v").fit(walks)
    return model.getVectors().select(F.col("word").alias("id"), "vector")


def modularity(edges: DataFrame, community: DataFrame, weight: str) -> DataFrame:
    """One row: modularity of communities (id, community) over undirected edges (src, dst, weight), each once."""
    of = lambda side: community.select(F.col("id").alias(side), F.col("community").alias(f"c_{side}"))
    w = F.col(weight).cast("double")
    ends = edges.join(of("src"), "src").join(of("dst"), "dst")
    total = edges.agg(F.sum(w).alias("m"))
    inner = ends.filter("c_src = c_dst").agg(F.coalesce(F.sum(w), F.lit(0.0)).alias("inner"))
    sides = ends.select(F.col("c_src").alias("c"), w.alias("w")).union(ends.select("c_dst", w))
    degrees = sides.groupBy("c").agg(F.sum("w").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("squares"))
    return inner.crossJoin(degrees).crossJoin(total).select((F.col("inner") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


#: Edges of a level of ``louvain`` that one task may hold.
FEW_EDGES = 1_000_000


def _local_moves(arcs: DataFrame, nodes: DataFrame, m: float, rounds: int) -> DataFrame:
    """id, c: communities after moves by modularity gain, from nodes (id, k: weighted degree) that start alone; arcs (src, dst, w) both ways, without loops.

    All nodes choose at once from the same state, so two of them could swap places for ever, or
    leave a community together.  A round lets nodes go to communities with a smaller number only,
    the next one to greater ones, and a round that lowers modularity is taken back and ends the moves."""
    state = cut(nodes.select("id", "k", F.col("id").alias("c")))
    best = None
    for i in range(rounds):
        sums = state.groupBy("c").agg(F.sum("k").alias("held"))
        around = arcs.join(state.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("shared"))
        own = state.select("id", "c", F.lit(0.0).alias("shared"))  # a node's own community counts also if no neighbour is in it
        options = around.unionByName(own).groupBy("id", "c").agg(F.sum("shared").alias("shared"))
        options = options.join(state.select("id", "k", F.col("c").alias("now")), "id").join(sums, "c")
        held = F.col("held") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("shared") / m - F.col("k") * held / (2 * m * m), 12)
        allowed = (F.col("c") < F.col("now")) if i % 2 == 0 else (F.col("c") > F.col("now"))
        scored = options.withColumn("gain", gain).filter(allowed | (F.col("c") == F.col("now")))
        # ties stay, or go to the smaller number
        choice = scored.groupBy("id", "k", "now").agg(F.min_by("c", F.struct(-F.col("gain"), F.col("c") != F.col("now"), F.col("c"))).alias("c"))
        step = cut(choice)
        of = lambda side, c: step.select(F.col("id").alias(side), F.col("c").alias(c))
        inner = arcs.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inner"))
        held = step.groupBy("c").agg(F.sum("k").alias("d"), F.sum((F.col("c") != F.col("now")).cast("long")).alias("moved"))
        found = held.agg(F.sum(F.col("d") * F.col("d")).alias("squares"), F.sum("moved").alias("moved")).crossJoin(F.broadcast(inner)).first()
        quality = found["inner"] / (2 * m) - found["squares"] / (4 * m * m)
        if best is not None and quality < best[0] - 1e-12:
            return best[1]
        idle = found["moved"] == 0 and best is not None and best[2] == 0
        best = (quality, step.select("id", "c"), found["moved"])
        if idle:
            break
        state = step.select("id", "k", "c")
    return best[1]


def _moves_of_few(pairs: pa.Table) -> pa.Table:
    """The same for few edges (a, b, w), in one task: nodes move one after another until none gains."""
    around: dict = {}
    degree: dict = {}
    for a, b, w in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "w")), strict=True):
        for x, y in ((a, b), (b, a)):
            degree[x] = degree.get(x, 0.0) + w
            own = around.setdefault(x, {})
            if a != b:
                own[y] = own.get(y, 0.0) + w
    m = sum(degree.values()) / 2
    label, held = {x: x for x in degree}, dict(degree)
    moved = True
    while moved:
        moved = False
        for x in sorted(degree):
            now, shared = label[x], {label[x]: 0.0}
            for y, w in around[x].items():
                shared[label[y]] = shared.get(label[y], 0.0) + w
            held[now] -= degree[x]
            gain = {c: w / m - degree[x] * held[c] / (2 * m * m) for c, w in shared.items()}
            best = min((c for c in gain), key=lambda c: (-round(gain[c], 12), c != now, c))
            if gain[best] <= gain[now] + 1e-12:
                best = now
            held[best] += degree[x]
            label[x], moved = best, moved or best != now
    kind = pairs.column("a").type
    return pa.table([pa.array(list(label), kind), pa.array(list(label.values()), kind)], ["id", "c"])


def louvain(edges: DataFrame, weight: str, levels: int = 10, rounds: int = 12) -> DataFrame:
    """id, community (its smallest id), by modularity: local moves of nodes, then communities become nodes, up to ``levels`` times.

    edges (src, dst, weight) are undirected; several between two nodes add up; loops count for
    their node.  Levels of up to FEW_EDGES edges, as later ones are, are worked on in one task;
    larger ones in rounds of joins.  Only sums reach the driver."""
    w = F.col(weight).cast("double")
    pairs = cut(edges.filter(w > 0).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w).alias("w")))
    m = pairs.agg(F.sum("w")).first()[0]
    names = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    label = cut(names.select("id", F.col("id").alias("community")))
    if not m:
        return label
    for _ in range(levels):
        apart = pairs.filter("a <> b")
        arcs = apart.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(apart.select("b", "a", "w"))
        sides = pairs.select(F.col("a").alias("id"), "w").union(pairs.select("b", "w"))
        nodes = cut(sides.groupBy("id").agg(F.sum("w").alias("k")))
        if pairs.count() <= FEW_EDGES:
            kind = dict(pairs.dtypes)["a"]
            moved = pairs.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _moves_of_few(t.select(["a", "b", "w"])), f"id {kind}, c {kind}")
        else:
            moved = _local_moves(arcs, nodes, m, rounds)
        first = moved.groupBy("c").agg(F.min("id").alias("name"), F.count("*").alias("n"))
        into = cut(moved.join(first, "c").select(F.col("id").alias("community"), "name"))
        if into.filter("community <> name").isEmpty():
            break
        label = cut(label.join(into, "community").select("id", F.col("name").alias("community")))
        ends = pairs.join(into.toDF("a", "na"), "a").join(into.toDF("b", "nb"), "b")
        pairs = cut(ends.groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.sum("w").alias("w")))
    return label
