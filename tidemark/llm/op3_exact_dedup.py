"""Exact duplicates by content-defined chunk recipes.

Texts are cut where a hash of the last eight bytes has a given form.  All chunks meet once,
grouped by identifier *and* content: that deduplicates them, and verifies that each
identifier stands for one content in the whole corpus (an identifier with two contents
gets the content's rank appended).  After that only the ordered lists of verified
identifiers (recipes) are compared, so the bytes of a document move once.  Equal texts have
equal cuts and so equal recipes; equal recipes of verified identifiers spell the same
bytes.

Defined cases: a null text is an empty one, with an empty recipe; equal texts differ at
most in the case of A-Z; a very long text is many chunks like any other; rows that repeat a
doc_id with an equal text are one document (each such row has the same flags;
``deduplicate`` keeps one of them, any), and with another text documents of their own; a
null doc_id never wins over another and a group of nulls only keeps one row; so
``deduplicate`` keeps one row of each different text; other columns and their names don't
matter, and ``deduplicate`` keeps them; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import _M1, binary_column, chunk_ends, lower_ascii, text_slices
from .shared import cut, join_back, keep_chosen

CHUNK_BITS = 10  # 1 KiB on average
WINDOW, MIN_GAP, MAX_CHUNK = 8, 64, 16384  # bytes


def chunk_cuts(data: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Ascending ends of chunks (with all ends of non-empty rows); where a row is cut follows from its own bytes only.

    A position is a cut if the hash of the eight bytes before it ends in zeros and none
    of the MIN_GAP positions before is; chunks are cut after MAX_CHUNK bytes at last."""
    inner = np.zeros(0, np.int64)
    if len(data) > WINDOW:
        window = np.ndarray((len(data) - WINDOW + 1,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
        inner = np.flatnonzero((window * _M1) >> np.uint64(64 - bits) == 0) + WINDOW
    return chunk_ends(inner, offsets, WINDOW, MIN_GAP, MAX_CHUNK)


def xxh128(chunk: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def chunks(documents: DataFrame, digest: Callable[[memoryview], bytes] = xxh128, mark: bool = False) -> DataFrame:
    """doc_id, at (position in the recipe), chunk_id, body of every chunk of every normalised text; with ``mark`` text_sha256 too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            data = lower_ascii(data)
            ends = chunk_cuts(data, offsets)
            edges = np.concatenate([[0], ends]).astype(np.int64)
            row = np.searchsorted(offsets, ends, side="left") - 1
            at = np.arange(len(ends)) - np.searchsorted(row, row, side="left")
            view = memoryview(data)
            ids = [digest(view[a:b]) for a, b in zip(edges[:-1].tolist(), ends.tolist(), strict=True)]
            columns = [rows.column("doc_id").take(pa.array(row)), pa.array(at, pa.int64()), pa.array(ids, pa.binary()), binary_column(data, edges)]
            if mark:
                sums = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns.append(pa.array(sums, pa.string()).take(pa.array(row)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "chunk_id", "body", "text_sha256"][: len(columns)])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, at long, chunk_id binary, body binary" + ", text_sha256 string" * mark)


def recipes(documents: DataFrame, digest: Callable[[memoryview], bytes] = xxh128) -> DataFrame:
    """doc_id, recipe (identifiers in order, joined), text_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches):
            data = lower_ascii(data)
            ends = chunk_cuts(data, offsets)
            edges = [0, *ends.tolist()]
            view = memoryview(data)
            ids = [digest(view[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            upto = np.searchsorted(ends, offsets, side="right").tolist()
            where = offsets.tolist()
            n = range(rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([b"".join(ids[upto[i] : upto[i + 1]]) for i in n], pa.binary()), pa.array([hashlib.sha256(view[where[i] : where[i + 1]]).hexdigest() for i in n], pa.string())],
                ["doc_id", "recipe", "text_sha256"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, recipe binary, text_sha256 string")


def verified_recipes(documents: DataFrame, digest: Callable[[memoryview], bytes] = xxh128) -> DataFrame:
    """``recipes`` whose identifiers stand for one content each.

    The chunks are grouped by identifier and content; identifiers with two contents get
    the rank of the content appended, in a recipe built from the grouped chunks."""
    pieces = chunks(documents, digest)
    distinct = pieces.groupBy("chunk_id", "body").agg(F.lit(1).alias("one"))
    clashes = distinct.groupBy("chunk_id").agg(F.count("*").alias("bodies")).filter("bodies > 1")
    listed = recipes(documents, digest)
    if clashes.isEmpty():
        return listed
    ranked = distinct.join(clashes, "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy("body"))).select("chunk_id", "body", "rank")
    placed = chunks(documents, digest, mark=True).join(ranked, ["chunk_id", "body"], "left").select("doc_id", "text_sha256", F.struct("at", F.hex("chunk_id").alias("name"), F.coalesce("rank", F.lit(1)).alias("rank")).alias("item"))
    spelled = placed.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spelled = spelled.select(F.col("doc_id").alias("_doc_id"), F.col("text_sha256").alias("_sum"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["name"], x["rank"])), ",").alias("spelled"))
    same = listed["doc_id"].eqNullSafe(spelled["_doc_id"]) & (listed["text_sha256"] == spelled["_sum"])
    return listed.join(spelled, same, "left").select("doc_id", F.encode(F.coalesce("spelled", F.lit("")), "UTF-8").alias("recipe"), "text_sha256")


def keyed_recipes(documents: DataFrame, digest: Callable[[memoryview], bytes] = xxh128) -> DataFrame:
    """doc_id, recipe (32 bytes, whatever the text's length), text_sha256 of every document, cut from the texts: later steps read these short rows."""
    return cut(verified_recipes(documents, digest).select("doc_id", F.unhex(F.sha2("recipe", 256)).alias("recipe"), "text_sha256"))


def exact_groups(documents: DataFrame, digest: Callable[[memoryview], bytes] = xxh128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    listed = keyed_recipes(documents, digest)
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    flagged = join_back(listed, cut(groups), "recipe", "group_size")
    keep = F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id")
    flagged = flagged.select("doc_id", keep, F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return flagged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Recipes make the groups; the text's digest only finds the group's documents again."""
    listed = keyed_recipes(documents).groupBy("recipe", "doc_id").agg(F.count("*").alias("n"), F.min("text_sha256").alias("text_sha256"))
    groups = listed.groupBy("recipe").agg(F.max(F.struct("doc_id", "n")).alias("last"), F.sum("n").alias("rows"), F.min("text_sha256").alias("digest")).filter("rows > 1")
    choice = groups.select("digest", F.lit(True).alias("stays"), F.col("last.doc_id").alias("keep_id"), "rows", F.col("last.n").alias("ties"))
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return keep_chosen(documents, F.sha2(lower.cast("binary"), 256), choice)


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""
