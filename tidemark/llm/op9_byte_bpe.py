"""Byte-level BPE by a global distinct-word shuffle.

1. Documents are packed into blocks; their texts are cut into pieces at places where the
   pre-token pattern always begins a match, so that a piece holds whole pre-tokens.
2. A block sends each of its distinct pieces once, to the task that the piece's hash names.
   There the distinct pieces of all blocks meet and each is encoded once.
3. The ids go back to the blocks, whose documents are put together by position.
4. Decoding joins the ids with the table of token bytes.

Fragments of the pieces are as many as the input's size asks for, so a task's share of them
doesn't grow with the corpus.

Defined cases: null and empty texts have no ids; strings that look like special tokens are
ordinary text; equal texts have equal ids, so ties don't arise; repeated rows and null doc_ids are kept; a very
long text is a block of its own, and a very long piece a word like any other; an empty
table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_SCHEMA, binary_column, expand, open_block, pack_blocks, pack_numbers, ranges, span_hashes, squeeze, text_bytes, unpack_numbers
from .segments import cuts
from .shared import fragment_count, settled


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _paths(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    if ranks_path is None or pattern is None:
        import public_tokenizers as P

        return ranks_path or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN
    return ranks_path, pattern


def dictionary(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """First piece of each text; the pieces' words; the distinct words by fragment; where each fragment's begin; their place in that order."""
    edges, first = cuts(data, offsets)
    coded = binary_column(data, edges).dictionary_encode()
    words = coded.dictionary
    raw, at = text_bytes(words)
    frag = (span_hashes(raw, at[:-1], np.diff(at)) % np.uint64(n)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    order = np.argsort(frag, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return first, coded.indices.to_numpy(zero_copy_only=False), words.take(pa.array(order)), np.searchsorted(frag[order], np.arange(n + 1)), place


def distinct_words(blocks: DataFrame, n: int) -> DataFrame:
    """block, frag, sizes, words: the distinct pieces of a block that a fragment gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "body")), strict=True):
                _, _, words, edges, _ = dictionary(*open_block(sizes, body), n)
                live = [i for i in range(n) if edges[i + 1] > edges[i]]
                raw, at = text_bytes(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(live), pa.int64()), pa.array(live, pa.int32()),
                     pa.array([pack_numbers(np.diff(at[edges[i] : edges[i + 1] + 1]), 4) for i in live], pa.binary()), pa.array([squeeze(raw[at[edges[i]] : at[edges[i + 1]]].tobytes()) for i in live], pa.binary())],
                    ["block", "frag", "sizes", "words"],
                )

    return blocks.mapInArrow(run, "block long, frag int, sizes binary, words binary")


def encode_words(parts: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """block, frag, counts, ids: the ids of each part's words in order, each distinct word encoded once in a fragment."""

    def run(table: pa.Table) -> pa.Table:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        sizes = [unpack_numbers(x, 4).astype(np.int64) for x in table.column("sizes").to_pylist()]
        raw = b"".join(expand(x) for x in table.column("words").to_pylist())
        coded = binary_column(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])).dictionary_encode()
        made = [encoding.encode_ordinary(w.decode()) for w in coded.dictionary.to_pylist()]
        counts = np.array([len(x) for x in made], np.int64)
        ids, begin = np.fromiter((i for x in made for i in x), np.int64), np.cumsum(counts) - counts
        codes = coded.indices.to_numpy(zero_copy_only=False)
        edges = np.cumsum([0] + [len(s) for s in sizes])
        own = [codes[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table(
            [table.column("block"), table.column("frag"), pa.array([pack_numbers(counts[c], 4) for c in own], pa.binary()), pa.array([pack_numbers(ids[ranges(begin[c], counts[c])], 4) for c in own], pa.binary())],
            ["block", "frag", "counts", "ids"],
        )

    return parts.groupBy("frag").applyInArrow(run, "block long, frag int, counts binary, ids binary")


def encode(documents: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids of every document."""
    ranks_path, pattern = _paths(ranks_path, pattern)
    n = fragment_count(documents)
    blocks = settled(documents).mapInArrow(pack_blocks, BLOCK_SCHEMA).repartition(n, "block")
    encoded = encode_words(distinct_words(blocks, n), ranks_path, pattern)

    def join_ids(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("frag")
        counts = np.concatenate([unpack_numbers(x, 4) for x in right.column("counts").to_pylist()] or [np.zeros(0)]).astype(np.int64)
        ids = np.concatenate([unpack_numbers(x, 4) for x in right.column("ids").to_pylist()] or [np.zeros(0)]).astype(np.int32)
        begin = np.cumsum(counts) - counts
        doc_ids, lists = [], []
        for b in left.to_pylist():
            first, codes, _, _, place = dictionary(*open_block(b["sizes"], b["body"]), n)
            words = place[codes]
            upto = np.concatenate([[0], np.cumsum(counts[words])])
            flat = ids[ranges(begin[words], counts[words])]
            lists.append(pa.ListArray.from_arrays(pa.array(upto[first], pa.int32()), pa.array(flat, pa.int32())))
            doc_ids += b["doc_ids"]
        return pa.table([pa.array(doc_ids, pa.int64()), pa.concat_arrays(lists)], ["doc_id", "ids"])

    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(join_ids, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, body (bytes) of every document; with ``digests`` n_tokens, ids_sha256 and decoded_sha256 instead of the body."""
    ranks_path, _ = _paths(ranks_path, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        tokens, numbers = pa.array(table, pa.large_binary()), pa.array([b"%d " % i for i in range(len(table))], pa.large_binary())
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                part = batch.slice(done, 500)
                done += part.num_rows
                lists = part.column("ids")
                sizes = np.diff(lists.offsets.to_numpy())
                flat, edges = lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])
                raw, at = text_bytes(tokens.take(flat))
                bodies = [raw[at[a] : at[b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                if not digests:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bodies, pa.binary())], ["doc_id", "body"])
                    continue
                said, at = text_bytes(numbers.take(flat))
                spelled = [said[at[a] : max(at[a], at[b] - 1)].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                sums = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (spelled, bodies)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), *sums], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, body binary")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return decode(encode(table(spark, sf_dir, "documents")), digests=True)
