"""Content-addressed store of token ids.

Files, all Parquet, written by Spark into one folder:

``items``      kind, doc_id, digest, n, body, copies.  Chunks: each distinct run of ids once;
               the digest is the SHA-256 of the ids as little-endian unsigned 32-bit
               integers, the body those ids as compressed byte planes (two bytes an id if
               all fit, else four).  Recipes: a document's chunk digests in order, and the
               Merkle root over them.
``recipes``    part, doc_id, n_tokens, digests, root: the recipes in ascending doc_id order;
               parts are ranges of doc_id.
``manifests``  part, documents, tokens, root: the Merkle root of a part's documents.

A stream of ids is cut where a rolling polynomial hash of the last WINDOW ids has leading
zeros, so equal passages give equal chunks wherever they stand.  ``verify`` reads the files
back: every chunk is hashed again where it lies, a document's root is built again from what
was read, and the checksum of its ids is combined from those of its chunks, so that no
chunk moves.  Then the Merkle root and the numbers of each part are built again from its
documents' roots and compared with the manifest, so a lost, added or changed recipe is
noticed too: all documents of its part are not ``verified``.  ``verify_parts`` says which
parts differ, also those that are lost wholly.  ``read_ids`` puts the ids themselves
together.

Defined cases: a null or empty text has the end id only; a very long one is cut into chunks
like any other; equal doc_ids are ordered by their roots; null doc_ids come first; repeated
rows are documents of their own, stored once; an empty table gives empty files; other
columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import binary_column, chunk_ends, lower_ascii, pack_numbers, ranges, squeeze_all, text_bytes, text_slices, unpack_numbers
from .segments import cuts
from .shared import cut, shared_folder, width

END_ID = 2
WINDOW, CHUNK_BITS, MIN_GAP, MAX_CHUNK = 16, 9, 64, 8192
PART_DOCUMENTS = 250_000  # of a manifest, about
BASE = 0x9E3779B97F4A7C15
CACHE_WORDS = 400_000  # words of either generation that a worker remembers, at most


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class WordEncoder:
    """Ids of words without white space, by the tokenizer library.

    Words of lower-case Latin-1 letters pass its normaliser and pre-tokeniser unchanged but
    for the byte letters, so they go to its model directly, if it does so with PROBES.

    ``remembered`` keeps words in two generations: when the younger one is full, it takes the
    older one's place, and words that are still met move on, so rare words don't drive out
    frequent ones."""

    PROBES = ("a", "the", "stthere", "élève", "größe", "ñandú", "zzxqj", "ÿþøå")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.letters = Tokenizer.from_file(path), byte_letters()
        self.model = self.whole.model
        self.young, self.old = {}, {}
        self.direct = True
        self.direct = all(self(p.encode()) == self.whole.encode(p, add_special_tokens=False).ids for p in self.PROBES)

    def __call__(self, word: bytes) -> list[int]:
        text = word.decode()
        if self.direct and text.isalpha() and text.islower() and (text.isascii() or max(text) < "\u0100"):
            return [t.id for t in self.model.tokenize(text if text.isascii() else word.decode("latin-1").translate(self.letters))]
        return self.whole.encode(text, add_special_tokens=False).ids

    def remembered(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        made = []
        young, old = self.young.get, self.old.get
        for word in words:
            ids = young(word)
            if ids is None:
                ids = old(word) or array("I", self(word)).tobytes()
                if len(word) < 64:
                    self.young[word] = ids
                    if len(self.young) >= CACHE_WORDS:
                        self.young, self.old = {}, self.young
                        young, old = self.young.get, self.old.get
            made.append(ids)
        return made


@cache
def word_encoder(path: str) -> WordEncoder:
    """One for each tokenizer file and worker, so that its words are remembered across tasks."""
    return WordEncoder(path)


def encode_slice(data: np.ndarray, offsets: np.ndarray, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with END_ID appended, and the offsets of the texts in them.

    The tokenizer lower-cases and splits at white space, letters, digits and signs, so the
    distinct pieces are encoded one by one; texts that may hold special tokens go whole."""
    low = lower_ascii(data)
    raw = data.tobytes()
    whole = np.array([i for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) if raw.find(b"<|", a, b) >= 0] if b"<|" in raw else [], np.int64)
    for row in whole:
        low[offsets[row] : offsets[row + 1]] = data[offsets[row] : offsets[row + 1]]
    edges, first = cuts(low, offsets, whole, ascii_only=True)
    coded = binary_column(low, edges).dictionary_encode()
    own, ends = text_bytes(coded.dictionary)
    flat, ends = own.tobytes(), ends.tolist()
    made = encoder.remembered([flat[a:b].strip() for a, b in zip(ends[:-1], ends[1:], strict=True)])
    counts = np.fromiter(map(len, made), np.int64, len(made)) // 4
    table, begin = np.frombuffer(b"".join(made), "<u4"), np.cumsum(counts) - counts
    codes = coded.indices.to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(counts[codes])])[first]
    ids = np.insert(table[ranges(begin[codes], counts[codes])], upto[1:], END_ID)
    return ids, upto + np.arange(len(upto))


def id_cuts(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of chunks."""
    power = np.cumprod(np.full(len(ids), BASE, np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(len(ids), pow(BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)
    total = np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * back, dtype=np.uint64)
    rolling = total.copy()
    rolling[WINDOW:] -= total[:-WINDOW]
    rolling *= power  # of the WINDOW ids up to here, wherever they stand
    inner = np.flatnonzero((rolling * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - CHUNK_BITS) == 0) + 1
    return chunk_ends(inner, offsets, WINDOW, MIN_GAP, MAX_CHUNK)


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree over the digests; an odd one goes up as it is.  Leaves and inner nodes are hashed apart."""
    level = [hashlib.sha256(b"\x00" + d).digest() for d in digests] or [hashlib.sha256(b"\x00").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def pack_ids(ids: np.ndarray) -> bytes:
    wide = 2 if len(ids) == 0 or ids.max() < 1 << 16 else 4
    return bytes([wide]) + pack_numbers(ids, wide)


def pack_runs(ids: np.ndarray, runs: list[tuple[int, int]]) -> list[bytes]:
    """``pack_ids`` of each run (begin, end); the planes of ids of two bytes are made once for all."""
    if not len(ids) or ids.max() >= 1 << 16:
        return [pack_ids(ids[a:b]) for a, b in runs]
    low, high = (ids.astype("<u2").view(np.uint8)[k::2].tobytes() for k in (0, 1))
    return [b"\x02" + packed for packed in squeeze_all(low[a:b] + high[a:b] for a, b in runs)]


def unpack_ids(body: bytes) -> np.ndarray:
    return unpack_numbers(body[1:], body[0]).astype("<u4")


CHUNK, RECIPE = "chunk", "recipe"


def in_part():
    """A part's documents in their order."""
    return Window.partitionBy("part").orderBy("doc_id", "root")


def items(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Chunks (digest, n, body: ids) and recipes (doc_id, digest: Merkle root, n, body: the chunks' digests in order), by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for rows, data, offsets in text_slices(batches, limit=4 << 20):
            ids, upto = encode_slice(data, offsets, encoder)
            ends = id_cuts(ids, upto)
            edges = [0, *ends.tolist()]
            view = memoryview(ids.astype("<u4").tobytes())
            digests = [hashlib.sha256(view[4 * a : 4 * b]).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            own = {d: i for i, d in enumerate(digests)}
            at = np.searchsorted(ends, upto, side="right").tolist()
            lists = [digests[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            parts = (
                (CHUNK, pa.nulls(len(own), pa.int64()), list(own), [edges[i + 1] - edges[i] for i in own.values()], pack_runs(ids, [(edges[i], edges[i + 1]) for i in own.values()])),
                (RECIPE, rows.column("doc_id"), [merkle(x) for x in lists], np.diff(upto), [b"".join(x) for x in lists]),
            )
            for kind, doc_ids, digest, n, body in parts:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(digest), pa.string()), doc_ids, pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(body, pa.binary())], ["kind", "doc_id", "digest", "n", "body"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind string, doc_id long, digest binary, n long, body binary")


def write_store(documents: DataFrame, folder: str, tokenizer_path: str | None = None) -> None:
    """Encodes the documents and writes the store's files."""
    if tokenizer_path is None:
        import public_tokenizers as P

        tokenizer_path = P.path("word_bpe_49k.json")
    spark = documents.sparkSession
    distinct = items(documents, tokenizer_path).groupBy("kind", "doc_id", "digest", "n", "body").agg(F.count("*").alias("copies"))
    distinct.write.partitionBy("kind").parquet(f"{folder}/items")
    listed = stored_items(spark, folder, RECIPE).select("doc_id", F.col("digest").alias("root"), F.col("n").alias("n_tokens"), F.col("body").alias("digests"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    rows = stored_items(spark, folder, RECIPE).agg(F.sum("copies")).first()[0] or 0
    ordered = listed.repartitionByRange(max(width(spark), -(-rows // PART_DOCUMENTS)), "doc_id", "root", "copy").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "root", "copy")
    ordered.select("part", "doc_id", "n_tokens", "digests", "root").write.parquet(f"{folder}/recipes")

    numbered = spark.read.parquet(f"{folder}/recipes").select("part", F.row_number().over(in_part()).alias("nth"), "n_tokens", "root")
    part_manifests(numbered).write.parquet(f"{folder}/manifests")


def part_manifests(numbered: DataFrame) -> DataFrame:
    """part, documents, tokens, root of each part's documents (part, nth, n_tokens, root); a part has about PART_DOCUMENTS."""

    def manifest(table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        return pa.table({"part": table.column("part").slice(0, 1), "documents": [table.num_rows], "tokens": [sum(table.column("n_tokens").to_pylist())], "root": [merkle(table.column("root").to_pylist())]})

    return numbered.select("part", "nth", "n_tokens", "root").groupBy("part").applyInArrow(manifest, "part int, documents long, tokens long, root binary")


def stored_items(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    schema = "doc_id long, digest binary, n long, body binary, copies long, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/items").filter(F.col("kind") == kind)


def digest_list(body) -> object:
    """The digests, 32 bytes each, that a recipe joins."""
    n = (F.length(body) / 32).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(body, (i - 1) * 32 + 1, F.lit(32)))


# Checksums of joined texts: crc(ab) = shift(crc(a), length of b) ^ crc(b); a shift by 2^j bytes is linear over bits.


def _shift_tables() -> np.ndarray:
    """For j of 0 to 39, and each byte of a checksum: its image under a shift by 2^j bytes."""
    columns = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)], np.uint64)
    tables = np.zeros((40, 4, 256), np.uint64)
    for j in range(40):
        for byte in range(4):
            for bit in range(8):
                tables[j, byte] ^= np.where(np.arange(256) >> bit & 1, columns[8 * byte + bit], 0).astype(np.uint64)
        columns = _shift(columns, tables[j])
    return tables


def _shift(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for byte in range(4):
        out ^= table[byte][((crc >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)]
    return out


_TABLES = _shift_tables()


def join_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of joined byte strings, from those of the two and the second's length."""
    out = first.copy()
    for j in range(int(length.max(initial=0)).bit_length()):
        on = (length >> j & 1).astype(bool)
        out[on] = _shift(out[on], _TABLES[j])
    return out ^ second


def verified_documents(spark: SparkSession, folder: str) -> DataFrame:
    """part, nth, doc_id, start, n_tokens, ids_crc32, root (built from the chunks read), fine (whether it is the recipe's), cut from its lineage."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [unpack_ids(b).tobytes() for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()), pa.array([len(b) // 4 for b in bodies], pa.int64()), pa.array([zlib.crc32(b) for b in bodies], pa.int64())], ["digest", "found", "size", "crc"])

    chunks = stored_items(spark, folder, CHUNK).select("digest", "body").mapInArrow(check, "digest binary, found binary, size long, crc long")
    recipes = spark.read.parquet(f"{folder}/recipes")
    numbered = recipes.withColumn("nth", F.row_number().over(in_part())).withColumn("inside", F.sum("n_tokens").over(in_part().rowsBetween(Window.unboundedPreceding, -1)))
    places = numbered.select("part", "nth", F.posexplode(digest_list(F.col("digests"))).alias("at", "digest"))
    found = places.join(chunks, "digest", "left").groupBy("part", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "found", "size", "crc"))).alias("pieces"))
    totals = spark.read.parquet(f"{folder}/manifests").select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    whole = numbered.select("part", "nth", "doc_id", "n_tokens", "root", F.coalesce("inside", F.lit(0)).alias("inside")).join(found, ["part", "nth"], "left").join(totals, "part", "left")
    whole = whole.select("part", "nth", "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "root", F.coalesce("pieces", F.array().cast("array<struct<at: int, found: binary, size: bigint, crc: bigint>>")).alias("pieces"))
    names = ["part", "nth", "doc_id", "start", "n_tokens", "ids_crc32", "root", "fine"]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces")
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            of = lambda name, kind: flat.field(name).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            size, crc, begin = of("size", np.int64), of("crc", np.uint64), np.cumsum(sizes) - sizes
            digests = flat.field("found").to_pylist()
            total, tokens = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64)
            for k in range(int(sizes.max(initial=0))):
                on = np.flatnonzero(sizes > k)
                own = begin[on] + k
                total[on] = join_crc(total[on], crc[own], 4 * size[own])
                tokens[on] += size[own]
            roots = [merkle([d or b"" for d in digests[a : a + n]]) for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
            fine = [r == s and t == n for r, s, t, n in zip(roots, batch.column("root").to_pylist(), tokens.tolist(), batch.column("n_tokens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(tokens, pa.int64()), pa.array(total.astype(np.int64)), pa.array(roots, pa.binary()), pa.array(fine)], names)

    return cut(whole.mapInArrow(combine, "part int, nth int, doc_id long, start long, n_tokens long, ids_crc32 long, root binary, fine boolean"))


def compared_parts(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """part, intact: whether the part's documents have the root and the numbers that its manifest names."""
    said = spark.read.parquet(f"{folder}/manifests").select("part", F.struct("documents", "tokens", "root").alias("said"))
    found = part_manifests(documents).select("part", F.struct("documents", "tokens", "root").alias("found"))
    return said.join(found, "part", "full").select("part", F.coalesce(F.col("said") == F.col("found"), F.lit(False)).alias("intact"))


def verify_parts(spark: SparkSession, folder: str) -> DataFrame:
    """part, intact of every part that the manifests or the recipes name."""
    return compared_parts(spark, folder, verified_documents(spark, folder))


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified: what the store's files hold."""
    documents = verified_documents(spark, folder)
    judged = documents.join(compared_parts(spark, folder, documents), "part", "left")
    return judged.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("fine") & F.coalesce("intact", F.lit(False))).alias("verified"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """part, nth (in the part), doc_id, ids: the documents' ids, put together from chunks."""
    places = spark.read.parquet(f"{folder}/recipes").withColumn("nth", F.row_number().over(in_part())).select("part", "nth", "doc_id", F.posexplode(digest_list(F.col("digests"))).alias("at", "digest"))
    found = places.join(stored_items(spark, folder, CHUNK).select("digest", "body"), "digest").groupBy("part", "nth", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]).alias("bodies"))

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack_ids(b) for b in own]) for own in batch.column("bodies").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "nth", "doc_id")), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["part", "nth", "doc_id", "ids"])

    return found.mapInArrow(glue, "part int, nth int, doc_id long, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    folder = f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), folder)
    return verify(spark, folder)
