"""Alignment of two tokenizers' ids, counted in dense matrices striped by the ids of one side.

1. A slice of texts is encoded by both tokenizers, each distinct piece once, and the tokens'
   byte ends are merged: between two ends lies one link, an A and a B token that overlap, so
   links are fewer than both sides' tokens together.
2. Each block of documents keeps its links, and sends its distinct id pairs, with the number
   of its documents that hold them, to stripes: A id modulo STRIPES.  However frequent an id
   is, a block sends a pair once.
3. A stripe adds the counts up in a dense matrix (its A ids x all B ids); the maxima of the
   rows give the best count of each A id.  Many blocks are added in groups first, and groups
   of groups, so that no task reads all blocks.
4. The pairs asked for are partitioned like the counts, by stripe and group, and answered
   there; answers then meet the links of their block, which are summed for each document.

Stripes are as many as STRIPES says and a block has a row for each, so rows grow in
proportion to the input; a matrix is as large as the vocabularies make it.

Defined cases: texts that are null or empty, or that a side doesn't spell back byte for byte
(U+2581, which side B can't tell from a space), have no tokens: zeros and an empty
groups_sha256; blank texts have tokens; strings of special tokens are plain text; a very long
text is a block of its own; equal texts have equal results, and each row counts as a
document, also rows that repeat a doc_id or have none; of equal highest counts all are best;
an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import binary_column, pack_numbers, ranges, text_bytes, text_slices, unpack_numbers
from .segments import cuts
from .shared import settled

STRIPES = 512
SLICE = 4 << 20  # bytes of text in a block, about
GROUP_ROWS = 4_000_000  # documents whose blocks one group of a stripe adds up, about
FAN_IN = 64  # groups that are added up together
META = "▁"  # fixed value: side B's sign for a space


class Side:
    """One tokenizer: where texts can be cut, ids of pieces, bytes of ids."""

    def __init__(self, path: str, kind: str):
        self.kind = kind
        if kind == "byte":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.coder = Tokenizer.from_file(path)
            self.coder.encode_special_tokens = True
            vocabulary = self.coder.get_vocab(with_added_tokens=False)
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, others for 256, 257, ...
            sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
            spelled = {i: bytes(sign[c] for c in token) for token, i in vocabulary.items()}
        else:
            import sentencepiece

            self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
            # Merges can't cross from a word to the space after it if no piece does.
            self.apart = not any(p[i] != META and p[i + 1] == META for p in pieces for i in range(len(p) - 1))
            spelled = {i: bytes([int(p[3:-1], 16)]) if self.coder.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)}
            self.blank = [self.coder.piece_to_id(META)]
        self.size = max(spelled, default=-1) + 1
        self.spelled = [spelled.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of pieces that can be encoded one by one, and each text's first."""
        if self.kind == "byte":
            return cuts(data, offsets)
        starts = np.zeros(len(data) + 1, bool)
        if self.apart and len(data):
            starts[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        starts[offsets] = True
        edges = np.flatnonzero(starts) if len(data) else np.zeros(1, np.int64)
        return edges, np.searchsorted(edges, offsets)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        if self.kind == "byte":
            return [x.ids for x in self.coder.encode_batch([p.decode() for p in pieces], add_special_tokens=False)]
        made = self.coder.encode([p[1:].decode() for p in pieces], num_threads=1)  # it puts a space before each
        return [self.blank if p == b" " else ids for p, ids in zip(pieces, made, strict=True)]

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts' tokens, the first token of each text, and whether the text is spelled back."""
        edges, first = self.pieces(data, offsets)
        coded = binary_column(data, edges).dictionary_encode()
        words = coded.dictionary.to_pylist()
        made = self.encode(words)
        counts = np.array([len(x) for x in made], np.int64)
        flat, begin = np.fromiter((i for x in made for i in x), np.int64), np.cumsum(counts) - counts
        right = np.array([b"".join(self.spelled[i] for i in x) == w for x, w in zip(made, words, strict=True)], bool)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(counts[codes])])
        wrong = np.concatenate([[0], np.cumsum(~right[codes])])
        return flat[ranges(begin[codes], counts[codes])], upto[first], np.diff(wrong[first]) == 0


@cache
def side(path: str, kind: str) -> Side:
    return Side(path, kind)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text that isn't empty with a space before it."""
    sizes = np.diff(offsets)
    more = sizes + (sizes > 0)
    upto = np.concatenate([[0], np.cumsum(more)])
    out = np.full(upto[-1], 0x20, np.uint8)
    out[ranges(upto[:-1] + (sizes > 0), sizes)] = data
    return out, upto


def tally(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums by row, of whole numbers."""
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, rows, weights)
    return out


def group_digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last: np.ndarray, row_items: np.ndarray, size: int) -> list[str]:
    """sha256 of each text's groups, ``a1,a2|b1;a3|b2,b3``; ``row_items`` are the edges of the texts' tokens, both sides together."""
    groups = len(last)
    upto_a, upto_b = np.searchsorted(group_a, np.arange(groups + 1)), np.searchsorted(group_b, np.arange(groups + 1))
    items = np.zeros(len(a) + len(b), np.int64)
    ends_a, ends_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    items[np.arange(len(a)) + upto_b[group_a]] = a + size * ends_a  # then "|"
    items[np.arange(len(b)) + upto_a[group_b + 1]] = b + 2 * size * ends_b  # then ";"
    said = pa.array([b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(size)], pa.large_binary())
    raw, at = text_bytes(said.take(pa.array(items)))
    return [hashlib.sha256(raw[at[x] : at[y] - 1]).hexdigest() if y > x else "" for x, y in zip(row_items[:-1].tolist(), row_items[1:].tolist(), strict=True)]


BLOCKS = "block long, doc_ids array<long>, totals binary, sums array<string>, pairs binary, times binary, stripes array<int>, keys array<binary>, held array<binary>"


def linked(documents: DataFrame, a_path: str, b_path: str, limit: int = SLICE) -> DataFrame:
    """BLOCKS: the documents' totals and digests; their links as places among the block's distinct pairs, and times; those pairs by stripe, with the documents that hold them.

    A pair's key is its place in the dense matrix of its stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left, right, part = side(a_path, "byte"), side(b_path, "piece"), TaskContext.get().partitionId()
        matrix = -(-left.size // STRIPES) * right.size
        place = (np.arange(left.size) % STRIPES) * matrix + np.arange(left.size) // STRIPES * right.size
        for nth, (rows, data, offsets) in enumerate(text_slices(batches, limit=limit)):
            data, offsets = spaced(data, offsets)
            n = rows.num_rows
            (a, first_a, right_a), (b, first_b, right_b) = left.tokens(data, offsets), right.tokens(data, offsets)
            good = right_a & right_b
            n_a, n_b = np.diff(first_a) * good, np.diff(first_b) * good
            a, b = a[ranges(first_a[:-1], n_a)], b[ranges(first_b[:-1], n_b)]
            ends_a, ends_b, row_ends = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b]), np.cumsum(np.diff(offsets) * good)
            total = int(row_ends[-1]) if n else 0
            in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
            in_a[ends_a], in_b[ends_b] = True, True
            ends, common = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
            row = np.searchsorted(row_ends, ends)
            link = place[a[np.searchsorted(ends_a, ends)]] + b[np.searchsorted(ends_b, ends)]
            group_row = np.searchsorted(row_ends, common)
            sums = group_digests(a, b, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), common, np.concatenate([[0], np.cumsum(n_a + n_b)]), max(left.size, right.size))
            wide = STRIPES * matrix
            held, times = np.unique(row * wide + link, return_counts=True)
            distinct, pairs = np.unique(held % wide, return_inverse=True)
            documents_of = tally(pairs, len(distinct))
            stripes, begin = np.unique(distinct // matrix, return_index=True)
            parts = [slice(x, y) for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(distinct)], strict=True)] if len(distinct) else []
            totals = np.stack([n_a, n_b, tally(group_row, n), tally(row, n), tally(held // wide, n)])
            ids = rows.column("doc_id").to_pylist()
            name = xxhash.xxh3_64_intdigest(f"{part}:{nth}:{ids}".encode()) - (1 << 63)
            keys, counts = [pack_numbers(distinct[p] % matrix, 4) for p in parts], [pack_numbers(documents_of[p], 4) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack_numbers(totals.ravel())], pa.binary()), pa.array([sums], pa.list_(pa.string())),
                    pa.array([pack_numbers(pairs, 4)], pa.binary()), pa.array([pack_numbers(times, 4)], pa.binary()),
                    pa.array([stripes.tolist()], pa.list_(pa.int32())), pa.array([keys], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.binary())),
                ],
                ["block", "doc_ids", "totals", "sums", "pairs", "times", "stripes", "keys", "held"],
            )

    return settled(documents).mapInArrow(run, BLOCKS).repartition("block")


def asked(blocks: DataFrame, groups: int) -> DataFrame:
    """block, stripe, part (its group of blocks), keys, counts: a row for each stripe of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "stripes", "keys", "held"]).to_pylist():
                n = len(row["stripes"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * n, pa.int64()), pa.array(row["stripes"], pa.int32()), pa.array([row["block"] % groups] * n, pa.int32()), pa.array(row["keys"], pa.binary()), pa.array(row["held"], pa.binary())],
                    ["block", "stripe", "part", "keys", "counts"],
                )

    return blocks.mapInArrow(run, "block long, stripe int, part int, keys binary, counts binary")


COUNTS = "stripe int, part int, keys binary, counts binary, best binary"


def added(rows: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """COUNTS: the rows of a stripe and group added up in a dense matrix; best says which counts are the highest of their A id."""
    height = -(-a_size // STRIPES)

    def run(table: pa.Table) -> pa.Table:
        dense = np.zeros((height, b_size), np.int64)
        flat = dense.ravel()
        for keys, counts in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            np.add.at(flat, unpack_numbers(keys, 4).astype(np.int64), unpack_numbers(counts, 4 if narrow else 8).astype(np.int64))
        keys = np.flatnonzero(flat)
        best = flat[keys] == dense.max(axis=1)[keys // b_size]
        one = [table.column(c).slice(0, 1).combine_chunks() for c in ("stripe", "part")]
        return pa.table([*one, pa.array([pack_numbers(keys, 4)], pa.binary()), pa.array([pack_numbers(flat[keys])], pa.binary()), pa.array([pack_numbers(best, 1)], pa.binary())], ["stripe", "part", "keys", "counts", "best"])

    narrow = "block" in rows.columns  # a block's counts have four bytes, sums eight
    return rows.select("stripe", "part", "keys", "counts").groupBy("stripe", "part").applyInArrow(run, COUNTS)


def counted(asks: DataFrame, groups: int, a_size: int, b_size: int) -> DataFrame:
    """COUNTS of the whole corpus, one row for each stripe."""
    sums = added(asks, a_size, b_size)
    while groups > 1:
        groups = -(-groups // FAN_IN)
        sums = added(sums.withColumn("part", F.pmod("part", F.lit(groups)).cast("int")), a_size, b_size)
    return sums


def answered(asks: DataFrame, totals: DataFrame, groups: int) -> DataFrame:
    """block, stripe, counts, best of the pairs that the blocks asked for, in their order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = unpack_numbers(right.column("keys")[0].as_py(), 4)
        counts, best = unpack_numbers(right.column("counts")[0].as_py()), unpack_numbers(right.column("best")[0].as_py(), 1)
        at = [np.searchsorted(keys, unpack_numbers(x, 4)) for x in left.column("keys").to_pylist()]
        return pa.table([left.column("block"), left.column("stripe"), pa.array([pack_numbers(counts[x]) for x in at], pa.binary()), pa.array([pack_numbers(best[x], 1) for x in at], pa.binary())], ["block", "stripe", "counts", "best"])

    spread = totals.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sides = [x.groupBy("stripe", "part") for x in (asks.select("block", "stripe", "part", "keys"), spread.select("stripe", "part", "keys", "counts", "best"))]

    def present(left: pa.Table, right: pa.Table) -> pa.Table:  # a group of blocks may ask nothing of a stripe
        return run(left, right) if left.num_rows else pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())], ["block", "stripe", "counts", "best"])

    return sides[0].cogroup(sides[1]).applyInArrow(present, "block long, stripe int, counts binary, best binary")


def scored(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("stripe")
        none = np.zeros(0, np.uint64)
        counts = np.concatenate([none, *(unpack_numbers(x) for x in right.column("counts").to_pylist())]).astype(np.int64)
        best = np.concatenate([none, *(unpack_numbers(x, 1) for x in right.column("best").to_pylist())]).astype(np.int64)
        row = {c: left.column(c)[0].as_py() for c in ("doc_ids", "totals", "sums", "pairs", "times")}
        n = len(row["doc_ids"])
        totals = unpack_numbers(row["totals"]).astype(np.int64).reshape(5, n)
        pairs, times = unpack_numbers(row["pairs"], 4).astype(np.int64), unpack_numbers(row["times"], 4).astype(np.int64)
        of = np.repeat(np.arange(n), totals[4])
        columns = [*totals[:4], tally(of, n, times * best[pairs]), tally(of, n, times * counts[pairs])]
        return pa.table([pa.array(row["doc_ids"], pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(row["sums"], pa.string())], ["doc_id", *NAMES, "groups_sha256"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in NAMES) + ", groups_sha256 string")


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    if a_path is None or b_path is None:
        import public_tokenizers as P

        return a_path or P.path("byte_bpe_50k.json"), b_path or P.path("piece_bpe_32k.model")
    return a_path, b_path


def _prepared(documents: DataFrame, a_path: str | None, b_path: str | None, group_rows: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    a_path, b_path = _paths(a_path, b_path)
    groups = 1 + documents.count() // group_rows  # only a measure of the input: results don't depend on it
    blocks = linked(documents, a_path, b_path, limit)
    asks = asked(blocks, groups)
    return blocks, asks, counted(asks, groups, side(a_path, "byte").size, side(b_path, "piece").size), groups, side(b_path, "piece").size


def align(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, group_rows: int = GROUP_ROWS, limit: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    blocks, asks, totals, groups, _ = _prepared(documents, a_path, b_path, group_rows, limit)
    return scored(blocks, answered(asks, totals, groups))


def id_pairs(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, group_rows: int = GROUP_ROWS, limit: int = SLICE) -> DataFrame:
    """a_id, b_id, documents (that hold the pair linked), best (whether no other b_id has more with this a_id)."""
    *_, totals, _, b_size = _prepared(documents, a_path, b_path, group_rows, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpack_numbers(row["keys"], 4).astype(np.int64)
                columns = [keys // b_size * STRIPES + row["stripe"], keys % b_size, unpack_numbers(row["counts"]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(unpack_numbers(row["best"], 1).astype(bool))], ["a_id", "b_id", "documents", "best"])

    return totals.mapInArrow(run, "a_id long, b_id long, documents long, best boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return align(table(spark, sf_dir, "documents"))
