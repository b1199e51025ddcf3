"""A Merkle manifest of a table: a tree for each source, and one over the sources' roots.

1. Each row becomes a leaf, the digest of its columns; after that only short rows move.
2. Leaves are numbered in the order of their source by ranges: rows are dealt out by
   ranges of (source, doc_id, leaf), and a range adds the sizes of the ranges before it, so
   no task orders a source.
3. Numbered nodes lie in aligned blocks of BLOCK, a power of FAN.  ``traverse`` walks a
   block's subtree in postorder: it returns the subtree's digest and, while unwinding,
   appends the siblings to all leaves contained below.
4. The roots of the blocks are the nodes of the next distributed traversal, and so on until
   a tree has one node.  Coming back, a block's nodes get the siblings of their block's root
   after their own; the siblings of upper levels move once for each block, not for each leaf.
5. The roots of the sources, numbered alike, go through the same traversals.

A task holds single blocks, whatever the size of a source, so a source with a third of all
rows is many blocks like any other.

Digests are hexadecimal text where they are hashed, as the manifest's format asks.

Defined cases: a null column counts as ``-``; an empty text as ``0:``; a very long text is
hashed whole, in its own row; rows that repeat a doc_id, or have none (they come first), are
leaves of their own, ordered by their digests; wholly equal rows have equal leaves at
different places; a null source comes first, before an empty one; a tree of one leaf is that
leaf; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

FAN = 16  # fixed value: nodes of a run
BLOCK = FAN**2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed value: what a leaf is made of, in order
TAMPER_EACH = 5


def spelled(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(spelled(columns[c]) for c in COLUMNS)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chosen(doc_id: Column) -> Column:
    """Rows whose text ``leaves`` changes; those without an id aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_EACH == 0, F.lit(False))


def leaves(documents: DataFrame, change: Callable[[Column], Column] = lowered, changed: Callable[[Column], Column] = chosen) -> DataFrame:
    """doc_id, source, leaf, other: the digest after a change of the text, where there is one, else the leaf."""
    own = {c: F.col(c) for c in COLUMNS} | {"doc_id": F.col("doc_id").cast("long")}
    leaf = leaf_digest(own)
    other = F.when(changed(own["doc_id"]), leaf_digest(own | {"text": change(F.col("text"))})).otherwise(F.lit(None))
    rows = documents.select(own["doc_id"].alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"), other.alias("other"))
    return rows.withColumn("other", F.coalesce("other", "leaf"))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with ``place`` (from 0, within their tree) and ``size`` (of their tree), by ``order``; cut from their lineage.

    Equal rows are dealt out too, by where they were read: their order makes no difference."""
    keys = [F.col(c).asc_nulls_first() for c in [tree, *order]]
    marked = rows.withColumn("_seen", F.monotonically_increasing_id())
    ranges = marked.repartitionByRange(*keys, "_seen").sortWithinPartitions(*keys, "_seen")
    dealt = cut(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    parts = dealt.groupBy(tree, "_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    # A range holds few trees or a tree few ranges: these rows are as many as trees and ranges together.
    before = Window.partitionBy(tree).orderBy("_part")
    whole = Window.partitionBy(tree)
    earlier = (F.sum("n").over(before) - F.col("n")).alias("_before")
    parts = parts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_p"), "_first", earlier, F.sum("n").over(whole).alias("size"))
    joined = dealt.join(parts, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("place"), "size")


def digest_of(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


def traverse(nodes: list[bytes], levels: int) -> tuple[bytes, list[list[tuple[bytes, bytes]]]]:
    """Digest of the subtree ``levels`` high over the nodes of a block; and for each node its siblings, as (before it, after it) from the lowest level up."""
    siblings: list[list[tuple[bytes, bytes]]] = [[] for _ in nodes]

    def visit(level: int, at: int) -> bytes:
        if level == 0:
            return nodes[at]
        below = FAN ** (level - 1)  # nodes below a child
        first, last = at * FAN, min((at + 1) * FAN, -(-len(nodes) // below))
        run = [visit(level - 1, child) for child in range(first, last)]
        for i, child in enumerate(range(first, last)):
            beside = (b"".join(run[:i]), b"".join(run[i + 1 :]))
            for node in siblings[child * below : (child + 1) * below]:
                node.append(beside)
        return digest_of(run)

    return visit(levels, 0), siblings


def levels_of(size: int, block: int) -> int:
    """Levels that a block of a tree with ``size`` nodes spans: all of a small tree."""
    levels = 0
    while size > 1 and FAN**levels < block:
        size, levels = -(-size // FAN), levels + 1
    return levels


BLOCK_ROWS = "tree string, block long, size long, root string, keys array<long>, nodes array<string>, others array<string>"
SIDES = "array<struct<before: binary, after: binary>>"


def blocks(nodes: DataFrame, block: int) -> DataFrame:
    """BLOCK_ROWS of nodes (tree, place, size, key, node, other): a row for each aligned block, with its root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        nodes, size = table.column("node").to_pylist(), table.column("size")[0].as_py()
        root, _ = traverse([x.encode() for x in nodes], levels_of(size, block))
        first = [table.column(c).slice(0, 1).combine_chunks() for c in ("tree", "block", "size")]
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("key", pa.int64()), ("node", pa.string()), ("other", pa.string()))]
        return pa.table([*first, pa.array([root.decode()]), *lists], ["tree", "block", "size", "root", "keys", "nodes", "others"])

    dealt = nodes.withColumn("block", F.expr(f"place div {block}")).select("tree", "block", "place", "size", "key", "node", "other")
    return cut(dealt.groupBy("tree", "block").applyInArrow(run, BLOCK_ROWS))


def upper_sides(packed: DataFrame, block: int) -> DataFrame:
    """_tree, _block, upper (siblings of the block's root and of what is above it in its tree), subroot of all blocks."""
    most = packed.agg(F.max("size")).first()[0] or 0
    if most <= block:
        none = F.array().cast(SIDES).alias("upper")
        return packed.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), none, F.col("root").alias("subroot"))
    roots = packed.select("tree", F.col("block").alias("place"), F.expr(f"(size + {block - 1}) div {block}").alias("size"), F.col("block").alias("key"), F.col("root").alias("node"), F.col("root").alias("other"))
    return proofs(roots, block).select(F.col("tree").alias("_tree"), F.col("key").alias("_block"), F.col("sides").alias("upper"), "subroot")


def with_upper(packed: DataFrame, block: int) -> DataFrame:
    upper = upper_sides(packed, block)
    return packed.join(upper, packed["tree"].eqNullSafe(upper["_tree"]) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")


def proofs(nodes: DataFrame, block: int) -> DataFrame:
    """tree, key, sides, subroot of nodes (tree, place, size, key, node, other): each node's siblings up to the root of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, siblings = traverse([x.encode() for x in row["nodes"]], levels_of(row["size"], block))
                n, above = len(row["nodes"]), [(x["before"], x["after"]) for x in row["upper"]]
                sides = [[{"before": a, "after": b} for a, b in [*own, *above]] for own in siblings]
                side = pa.struct([("before", pa.binary()), ("after", pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * n, pa.string()), pa.array(row["keys"], pa.int64()), pa.array(sides, pa.list_(side)), pa.array([row["subroot"]] * n, pa.string())], ["tree", "key", "sides", "subroot"]
                )

    return with_upper(blocks(nodes, block), block).select("tree", "keys", "nodes", "size", "upper", "subroot").mapInArrow(run, f"tree string, key long, sides {SIDES}, subroot string")


def folded(node: bytes, sides: list[tuple[bytes, bytes]]) -> bytes:
    """The root that follows from a node and its siblings."""
    for before, after in sides:
        node = digest_of([before, node, after])
    return node


def manifest(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (doc_id, source, leaf, other): other is the leaf whose proof is tried.

    ``block``, the leaves of a traversal, is a power of FAN."""
    # Sampling for the ranges would read and hash all texts once more.
    placed = numbered(cut(rows), "source", ["doc_id", "leaf", "other"])
    packed = with_upper(blocks(placed.select(F.col("source").alias("tree"), "place", "size", F.col("doc_id").alias("key"), F.col("leaf").alias("node"), "other"), block), block)
    packed = cut(packed)
    # The tree over the sources: a node for each, whatever their number.
    tops = packed.filter("block = 0").select(F.lit("sources").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node"))
    tops = cut(numbered(tops, "tree", ["name"]))
    over = proofs(tops.select("tree", "place", "size", F.col("place").alias("key"), "node", F.col("node").alias("other")), block)
    over = over.join(tops.select(F.col("name").alias("_tree"), F.col("place").alias("key")), "key").select("_tree", F.col("sides").alias("top"), F.col("subroot").alias("root"))
    joined = packed.drop("root").join(over, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, siblings = traverse([x.encode() for x in row["nodes"]], levels_of(row["size"], block))
                above = [(x["before"], x["after"]) for x in [*row["upper"], *row["top"]]]
                tail = b"".join(a + b for a, b in above)
                sums = [hashlib.sha256(b"".join(a + b for a, b in own) + tail).hexdigest() for own in siblings]
                found = [folded(x.encode(), [*own, *above]).decode() for x, own in zip(row["others"], siblings, strict=True)]
                n = len(sums)
                columns = [row["nodes"], [row["subroot"]] * n, [row["root"]] * n, sums, found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), *(pa.array(c, pa.string()) for c in columns), pa.array([x == row["root"] for x in found])],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return joined.select("keys", "nodes", "others", "size", "upper", "top", "subroot", "root").mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return manifest(leaves(table(spark, sf_dir, "documents")))


#: Levels that the SQL below goes up: enough for FAN to this power leaves of a source, and as many sources.
SQL_LEVELS = 5


def _climb(name: str, tree: str) -> list[str]:
    """SQL that reduces nodes {name}0 (tree, place, d) level by level; {name}N holds the roots and {name}_at K the runs above level K."""
    steps = []
    for k in range(SQL_LEVELS):
        steps.append(f"{name}_at{k} AS (SELECT {tree}, place // {FAN} AS run, list(d ORDER BY place) AS ds, max(size) AS size FROM {name}{k} GROUP BY ALL)")
        steps.append(f"{name}{k + 1} AS (SELECT {tree}, run AS place, CASE WHEN size > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d, CAST(ceil(size / {FAN}) AS BIGINT) AS size FROM {name}_at{k})")
    return steps


def _path(rows: str, name: str, tree: str, node: str) -> list[str]:
    """SQL that appends siblings to ``proof`` and folds ``{node}``, for rows (place, proof, {node}) of a tree."""
    steps = []
    for k in range(SQL_LEVELS):
        at = f"(r.place // {FAN**k}) % {FAN}"
        before, after = f"array_to_string(a.ds[1:CAST({at} AS INT)], '')", f"array_to_string(a.ds[CAST({at} AS INT) + 2:], '')"
        steps.append(
            f"{rows}{k + 1} AS (SELECT r.* REPLACE (CASE WHEN a.size > 1 THEN r.proof || {before} || {after} ELSE r.proof END AS proof, CASE WHEN a.size > 1 THEN sha256({before} || r.{node} || {after}) ELSE r.{node} END AS {node}) "
            f"FROM {rows}{k} r JOIN {name}_at{k} a ON r.{tree} IS NOT DISTINCT FROM a.{tree} AND a.run = r.place // {FAN ** (k + 1)})"
        )
    return steps


def _oracle() -> str:
    part = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joined = lambda text: " || ".join(part(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
    # DuckDB has no crc32: a table of the 256 bytes, and a fold over the id's digits.
    xor = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    rounds = "SELECT i, CAST(i AS BIGINT) AS c FROM range(256) t(i)"
    for _ in range(8):
        rounds = f"SELECT i, {xor} AS c FROM ({rounds})"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(c // 256, table_of[xor(c % 256, b) + 1])), 4294967295)"
    steps = [
        f"crc_of AS MATERIALIZED (SELECT list(c ORDER BY i) AS table_of FROM ({rounds}))",
        f"leaves AS (SELECT doc_id, source, sha256({joined('text')}) AS leaf, CASE WHEN {crc} % {TAMPER_EACH} = 0 THEN sha256({joined(low)}) ELSE sha256({joined('text')}) END AS other FROM documents CROSS JOIN crc_of)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM leaves)",
        "n0 AS (SELECT source, place, leaf AS d, size FROM placed)", *_climb("n", "source"),
        f"s0 AS MATERIALIZED (SELECT 1 AS t, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, d, count(*) OVER () AS size FROM n{SQL_LEVELS})", *_climb("s", "t"),
        "p0 AS (SELECT doc_id, source, leaf, place, '' AS proof, other FROM placed)", *_path("p", "n", "source", "other"),
        f"q0 AS (SELECT 1 AS t, p.doc_id, p.source, p.leaf, s0.d AS subroot, s0.place, p.proof, p.other FROM p{SQL_LEVELS} p JOIN s0 ON p.source IS NOT DISTINCT FROM s0.source)", *_path("q", "s", "t", "other"),
    ]
    return f"""WITH {', '.join(steps)}
SELECT q.doc_id, q.leaf, q.subroot, r.d AS root, sha256(q.proof) AS proof_sha256, q.other AS folded_root, q.other = r.d AS verified FROM q{SQL_LEVELS} q CROSS JOIN s{SQL_LEVELS} r"""


ORACLE = _oracle()
