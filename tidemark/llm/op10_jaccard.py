"""N-gram Jaccard join by vertical partitioning.

The sets are the distinct word shingles of documents.  The global order of shingles is
their hash order for counting, and (document frequency, hash) for prefixes.

1. Documents are packed into blocks.  A block sends its distinct shingles, in order and
   cut into fragments, to the fragments' tasks, which count how many sets hold each one
   and send the counts back.  Fragments are as many as the input's size asks for.
2. Two sets that link share one of their rarest shingles: of a set of n, one of the first
   n - ceil(t n) + 1 in frequency order.  Only shingles with two holders matter, so most
   sets send nothing; nor do sets so small that only an equal one can link.  Sizes and
   positions rule out more.
3. Candidate pairs are verified exactly: sets are cut into vertical fragments of the hash
   order, overlaps are counted in each fragment separately and summed per pair.
4. To avoid all pairs of a large group, each shingle's sets are first compared with one
   of them.  What that links is joined into components, and then only pairs that still
   lie in different components, and in the same or neighbouring bands of size, are
   compared.  Components lose nothing by it: a pair left out lies in one component
   already, or can't link.  Sets that many others are compared with are dealt to several
   tasks, in proportion to those others.

Equal sets are one node throughout, known by a 64-bit sum over their shingles' hashes; a
second sum verifies it, and sets that share the first sum only get numbers of their own.

Defined cases: null and empty texts have no set, n_shingles 0, and are their own
component (their doc_id); with fewer words than a shingle has, the whole sequence is one;
a very long text is one set like any other; rows that repeat a doc_id are documents of
their own with that id; a null doc_id counts as a document, but never as the smallest id
unless a component has no other; an empty table gives no rows; other columns don't matter,
whatever their names.  ``keep_one`` keeps them, and one row of each component: of the row
with the smallest id, ties by its text's digest, and of rows alike in both any; rows
without a set all stay.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import (
    BLOCK_SCHEMA,
    follow,
    fragment_bounds,
    lower_ascii,
    mix,
    open_block,
    pack_blocks,
    pack_numbers,
    pack_sorted,
    span_hashes,
    unpack_numbers,
    unpack_sorted,
    word_spans,
)
from .shared import components, cut, fragment_count, join_back, keep_chosen, settled, text_digest

WORDS, SHARE = 3, (90, 100)  # Jaccard of 90 / 100 at least
VERTICAL = 4
PAIRS_PER_TASK = 4096  # others that a set is compared with in one task, about


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each document; where each document's begin (n + 1); an id of ``bits`` bits of each set, and a check of it."""
    data = lower_ascii(data)
    starts, lengths, first = word_spans(data, offsets)
    h = span_hashes(data, starts, lengths) if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    value = h[: max(0, len(h) - words + 1)]
    for k in range(1, words):
        value = follow(value, h[k : len(value) + k])
    whole = np.arange(len(value)) + words <= first[1:][doc[: len(value)]]
    value, doc = value[whole], doc[: len(value)][whole]
    for n in range(1, words):  # short documents: the whole sequence
        short = np.flatnonzero(counts == n)
        at = first[:-1][short]
        v = h[at]
        for k in range(1, n):
            v = follow(v, h[at + k])
        value, doc = np.concatenate([value, mix(v + np.uint64(n))]), np.concatenate([doc, short])
    order = np.lexsort((value, doc)) if len(counts) > 1 << 16 else np.argsort(doc.astype(np.uint64) << np.uint64(48) | value >> np.uint64(16))
    value, doc = value[order], doc[order]
    if ((value[1:] < value[:-1]) & (doc[1:] == doc[:-1])).any():  # alike in the upper 48 bits
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    begin = np.searchsorted(doc, np.arange(len(counts) + 1))
    ids, checks = (_set_sums(mix(value * np.uint64(a) + np.uint64(b)), begin) for a, b in ((0x9E3779B97F4A7C15, 1), (0xC2B2AE3D27D4EB4F, 7)))
    return value, begin, ids >> np.uint64(64 - bits), checks


def _set_sums(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    return mix(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64))


def _distinct(ids: np.ndarray, checks: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The first document of each different set of a block, without empty ones."""
    order = np.lexsort((checks, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(checks[order]) != 0)
    at = np.sort(order[new])  # lexsort is stable: the first of its kind
    return at[np.diff(begin)[at] > 0]


def _pick(value: np.ndarray, begin: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places of the shingles of some documents."""
    keep = np.zeros(len(begin) - 1, bool)
    keep[docs] = True
    return np.flatnonzero(np.repeat(keep, np.diff(begin)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def fragments(blocks: DataFrame, words: int, n: int) -> DataFrame:
    """block, frag, keys, holders: the distinct shingles of a block in each fragment, and the number of its different sets that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            value, begin, ids, checks = shingle_sets(*open_block(b["sizes"], b["body"]), words)
            keys, holders = np.unique(value[_pick(value, begin, _distinct(ids, checks, begin))], return_counts=True)
            edges = fragment_bounds(keys, n)
            live = [i for i in range(n) if edges[i + 1] > edges[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b["block"]] * len(live), pa.int64()), pa.array(live, pa.int32()), pa.array([pack_sorted(keys[edges[i] : edges[i + 1]]) for i in live], pa.binary()), pa.array([pack_numbers(holders[edges[i] : edges[i + 1]], 4) for i in live], pa.binary())],
                ["block", "frag", "keys", "holders"],
            )

    return blocks.mapInArrow(run, "block long, frag int, keys binary, holders binary")


def count_holders(parts: DataFrame) -> DataFrame:
    """block, frag, holders: for each key of a part, in order, the number of all sets that hold it."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        holders = [unpack_numbers(x, 4) for x in table.column("holders").to_pylist()]
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(holders)).astype(np.int64)[where]
        edges = np.cumsum([0] + [len(k) for k in keys])
        packed = [pack_numbers(np.minimum(total[a:b], 0xFFFFFFFF), 4) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([table.column("block"), table.column("frag"), pa.array(packed, pa.binary())], ["block", "frag", "holders"])

    return parts.groupBy("frag").applyInArrow(run, "block long, frag int, holders binary")


def candidates(blocks: DataFrame, counts: DataFrame, words: int, share: tuple[int, int], bits: int = 64) -> DataFrame:
    """Rows of two kinds.  Without ``part``: a document (doc_id, set_id, check, n, digest of its text).  With it: a vertical fragment of a set that may link to another (set_id, check, n, shared), the first one with the set's prefix."""
    names = ["doc_id", "set_id", "check", "n", "part", "prefix", "shared", "digest"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        right = right.sort_by("frag")
        holders = np.concatenate([unpack_numbers(x, 4) for x in right.column("holders").to_pylist()] or [np.zeros(0, np.int64)]).astype(np.int64)
        for b in left.to_pylist():
            data, offsets = open_block(b["sizes"], b["body"])
            value, begin, ids, checks = shingle_sets(data, offsets, words, bits)
            size, signed, check = np.diff(begin), ids.view(np.int64), checks.view(np.int64)
            for i, doc in enumerate(b["doc_ids"]):
                own = (int(signed[i]), int(check[i])) if size[i] else (None, None)
                for column, x in zip(out, (doc, *own, int(size[i]), None, None, None, hashlib.md5(data[offsets[i] : offsets[i + 1]]).digest()), strict=True):
                    column.append(x)
            docs = _distinct(ids, checks, begin)
            if not len(docs):
                continue
            keys = np.unique(value[_pick(value, begin, docs)])
            df = holders[np.searchsorted(keys, value)]
            alone = np.concatenate([[0], np.cumsum(df == 1)])
            single = alone[begin[1:]] - alone[begin[:-1]]
            long = size - -(-share[0] * size // share[1]) + 1
            # A different set adds a shingle at least: n of n + 1 must be enough.
            for i in docs[(single[docs] < long[docs]) & (size[docs] * (share[1] - share[0]) >= share[0])].tolist():
                v, d = value[begin[i] : begin[i + 1]], df[begin[i] : begin[i + 1]]
                own = v[d > 1]
                order = np.lexsort((v, d))[single[i] : long[i]]
                prefix = [{"key": int(k), "at": int(a)} for k, a in zip(v[order].view(np.int64), range(single[i], long[i]), strict=True)]
                edges = fragment_bounds(own, VERTICAL)
                for p in range(VERTICAL):
                    for column, x in zip(out, (None, int(signed[i]), int(check[i]), int(size[i]), p, None if p else prefix, pack_sorted(own[edges[p] : edges[p + 1]]), None), strict=True):
                        column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())])), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = "doc_id long, set_id long, check long, n long, part int, prefix array<struct<key: long, at: int>>, shared binary, digest binary"
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, schema)


def verified_sets(found: DataFrame) -> DataFrame:
    """``found`` with a set_id of its own for each different set: where sets with different checks share one, theirs are made from both."""
    clashes = cut(found.filter("part IS NULL AND set_id IS NOT NULL").groupBy("set_id").agg(F.min("check").alias("low"), F.max("check").alias("high"), F.count("*").alias("rows")).filter("low <> high").select("set_id", "rows"))
    if clashes.isEmpty():
        return found
    named = join_back(found, clashes, "set_id", "rows")
    return named.withColumn("set_id", F.when(F.col("rows").isNull(), F.col("set_id")).otherwise(F.xxhash64("set_id", "check"))).select(*found.columns)


def overlaps(pairs: DataFrame, parts: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b of those pairs (a, b, salts) whose sets link: overlaps in each vertical fragment, summed.

    The others of b are dealt to ``salts`` tasks, a number that is the same in all rows of a b."""
    pairs = cut(pairs)
    side = lambda name: parts.select(F.col("set_id").alias(name), "part", F.col("n").alias(f"n_{name}"), F.col("shared").alias(f"s_{name}"))
    copies = side("b").join(pairs.select("b", "salts").distinct(), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    rows = dealt.join(side("a"), "a").join(copies, ["b", "part", "salt"]).select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, other, common = None, None, []
            for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
                if y != last:
                    last, other = y, unpack_sorted(y)
                common.append(len(np.intersect1d(unpack_sorted(x), other, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("a", "b", "n_a", "n_b")), pa.array(common, pa.int64())], ["a", "b", "n_a", "n_b", "common"])

    partial = rows.mapInArrow(run, "a long, b long, n_a long, n_b long, common long")
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return summed.filter(F.col("common") * share[1] >= (F.col("n_a") + F.col("n_b") - F.col("common")) * share[0]).select("a", "b")


def _possible(x: str, y: str, share: tuple[int, int]):
    """Whether sizes and positions of a shared shingle, the first one shared, leave enough to overlap."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
    return (rest * (share[0] + share[1]) >= (n + m) * share[0]) & (F.least(n, m) * share[1] >= F.greatest(n, m) * share[0])


def _tasks(others):
    return F.ceil(others / PAIRS_PER_TASK).cast("int")


def lead_pairs(prefix: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b, salts: one set of each shingle (b) against the others: the one with the fewest rare shingles of its own before it, the likeliest centre of a group.

    (Written out, so that both sides of the join are shuffled for it and a hot shingle's side can be split.)"""
    lead = prefix.groupBy("key").agg(F.min(F.struct("at", "set_id", "n")).alias("l"), F.count("*").alias("sets")).filter("sets > 1").select("key", "l.*", "sets")
    lead = cut(lead.withColumn("salts", _tasks(F.sum("sets").over(Window.partitionBy("set_id")))))  # a set leads as many shingles as its prefix has, at most
    stars = prefix.alias("x").join(lead.alias("l"), "key").filter((F.col("x.set_id") != F.col("l.set_id")) & _possible("x", "l", share))
    return stars.select(F.col("x.set_id").alias("a"), F.col("l.set_id").alias("b"), "salts").distinct()


def other_pairs(prefix: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b, salts: pairs that share a shingle and lie in different components, but for those with the shingle's lead."""
    named = prefix.join(nodes, prefix["set_id"] == nodes["node"], "left").select("key", "set_id", "n", "at", F.coalesce("component", "set_id").alias("c"))
    apart = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct("at", "set_id", "n")).alias("l"), F.count("*").alias("sets")).filter("c0 < c1").select("key", F.col("l.set_id").alias("lead"), _tasks(F.col("sets")).alias("tasks"))
    band = F.floor(F.log("n") / (1.0001 * math.log(share[1] / share[0]))).cast("int")  # of sets that link, one apart at most
    split = named.join(cut(apart), "key").filter("set_id <> lead").withColumn("band", band)
    left = split.withColumn("task", F.pmod(F.xxhash64("set_id"), F.col("tasks")).cast("int"))
    right = split.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    met = left.alias("x").join(right.alias("y"), ["key", "band", "task"]).filter((F.col("x.c") != F.col("y.c")) & _possible("x", "y", share))
    pairs = met.select(F.greatest("x.set_id", "y.set_id").alias("a"), F.least("x.set_id", "y.set_id").alias("b")).distinct()
    pairs = cut(pairs)
    met_by = pairs.groupBy("b").agg(_tasks(F.count("*")).alias("salts"))
    return pairs.join(met_by, "b").select("a", "b", "salts")


def placed_documents(documents: DataFrame, words: int, share: tuple[int, int], bits: int = 64) -> DataFrame:
    """doc_id, digest of the text, n_shingles, c of every document: its component, null without a set."""
    n = fragment_count(documents)
    blocks = settled(documents).mapInArrow(pack_blocks, BLOCK_SCHEMA).repartition(n, "block")
    found = verified_sets(cut(candidates(blocks, count_holders(fragments(blocks, words, n)), words, share, bits)))
    docs = found.filter("part IS NULL").select("doc_id", "set_id", F.col("n").alias("n_shingles"), "digest")
    parts = found.filter("part IS NOT NULL").select("set_id", "n", "part", "shared").dropDuplicates(["set_id", "part"])
    prefix = found.filter("part = 0").select("set_id", "n", F.explode("prefix").alias("x")).select("set_id", "n", "x.key", "x.at").distinct()
    if share[0] == share[1]:  # only equal sets link
        return docs.select("doc_id", "digest", "n_shingles", F.col("set_id").alias("c"))
    links = cut(overlaps(lead_pairs(prefix, share), parts, share))
    more = overlaps(other_pairs(prefix, cut(components(links)), share), parts, share)
    nodes = cut(components(links.union(more)))
    sizes = nodes.join(docs.groupBy("set_id").agg(F.count("*").alias("rows")), F.col("node") == F.col("set_id")).select("set_id", "component", "rows")
    return join_back(docs, cut(sizes), "set_id", "rows").select("doc_id", "digest", "n_shingles", F.coalesce("component", "set_id").alias("c"))


def jaccard_groups(documents: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    placed = placed_documents(documents, words, share, bits)
    groups = placed.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    return join_back(placed, cut(groups), "c", "rows").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The document with the smallest id of each component, with all its columns."""
    texts = placed_documents(documents, words, share).filter("c IS NOT NULL").groupBy("c", "digest", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")).alias("first")
    groups = texts.groupBy("c").agg(first, F.sum("n").alias("size"), F.count("*").alias("members")).filter("size > 1")
    members = texts.groupBy("c", "digest").agg(F.sum("n").alias("rows"))
    placed = join_back(members, cut(groups), "c", "members", spread="digest").filter("first IS NOT NULL")
    choice = placed.select("digest", (F.col("digest") == F.col("first.digest")).alias("stays"), F.col("first.doc_id").alias("keep_id"), "rows", F.col("first.n").alias("ties"))
    return keep_chosen(documents, text_digest(F.col("text")), choice)


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return jaccard_groups(table(spark, sf_dir, "documents"))
