"""Array kernels over Arrow text columns, shared by the operators of this subpackage.

A task sees its rows as Arrow batches.  ``text_slices`` cuts a batch into slices of
bounded bytes (a single longer text makes a slice of its own), and the kernels below
work on the flat UTF-8 bytes of a slice, so no Python loop runs over words.
Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

SLICE_BYTES = 8 << 20
SLICE_ROWS = 32768
WIDE_COLUMN = 1 << 31  # bytes from which a column's offsets need 64 bits

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# The white space of the contracts, [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat UTF-8 bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    if not len(a) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of at most SLICE_ROWS rows with at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(name))
        first = 0
        while first < batch.num_rows:
            last = min(max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1), first + SLICE_ROWS)
            part = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turns = np.concatenate([[0] if inside[0] else [], turns, [len(data)] if inside[-1] else []]).astype(np.int64)
    starts, ends = turns[0::2], turns[1::2]
    joints = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    joints = joints[inside[joints - 1] & inside[joints]]
    if len(joints):
        starts = np.insert(starts, np.searchsorted(starts, joints), joints)
        ends = np.insert(ends, np.searchsorted(ends, joints), joints)
    return starts, ends - starts, np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, from its bytes and length only."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    out = lengths.astype(np.uint64) * _M3
    at, position, rest = None, starts, lengths
    while True:
        x = out if at is None else out[at]
        x = (x ^ (eight[position] & _MASK[np.minimum(rest, 8)])) * _M1
        x ^= x >> np.uint64(32)
        if at is None:
            out = x
        else:
            out[at] = x
        more = np.flatnonzero(rest > 8)
        if not len(more):
            return mix(out)
        at = more if at is None else at[more]
        position, rest = position[more] + 8, rest[more] - 8


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def follow(prefix: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hash of a sequence one element longer than that of ``prefix``."""
    return mix(prefix * _M1 + nxt)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i], starts[i] + 1, ... of lengths[i] numbers each."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose values are consecutive parts of ``data``, without a copy of the values; with 64-bit offsets where 32 bits can't hold them."""
    kind, offset = (pa.binary(), np.int32) if len(data) < WIDE_COLUMN else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(offset)), pa.py_buffer(np.ascontiguousarray(data))])


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def squeeze_all(parts: Iterable[bytes], level: int = 1) -> list[bytes]:
    """Each part as ``squeeze`` gives it, by one compressor."""
    compressor = zstandard.ZstdCompressor(level=level)
    return [compressor.compress(raw) for raw in parts]


def expand(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack_numbers(values: np.ndarray, width: int = 8) -> bytes:
    """Compressed byte planes of unsigned numbers of ``width`` bytes."""
    raw = values.astype(f"<u{width}")
    return squeeze(raw.view(np.uint8).reshape(-1, width).T.tobytes())


def unpack_numbers(packed: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(expand(packed), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as compressed planes of their differences."""
    return pack_numbers(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(packed), dtype=np.uint64)


def fragment_bounds(values: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the 64-bit order begins in ascending ``values`` (n + 1 positions)."""
    cuts = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, cuts), [len(values)]]).astype(np.int64)


#: A block: whole rows with at most about SLICE_BYTES of text.
BLOCK_SCHEMA = "block long, doc_ids array<long>, sizes binary, body binary"


def pack_blocks(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) rows to BLOCK_SCHEMA.  The block's number follows from its rows and its partition, so a task that is run again makes the same blocks if it gets its rows in the same order (``shared.settled``)."""
    from pyspark import TaskContext

    task = TaskContext.get()
    for nth, (rows, data, offsets) in enumerate(text_slices(batches, limit=limit)):
        ids = rows.column("doc_id").cast(pa.int64())
        raw = data.tobytes()
        seed = f"{task.partitionId() if task else 0}:{nth}:{ids.to_pylist()}".encode()
        number = xxhash.xxh3_64_intdigest(raw, xxhash.xxh3_64_intdigest(seed)) - (1 << 63)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([pack_numbers(np.diff(offsets))], pa.binary()), pa.array([squeeze(raw, 3)], pa.binary())],
            ["block", "doc_ids", "sizes", "body"],
        )


def open_block(sizes: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a block."""
    lengths = unpack_numbers(sizes).astype(np.int64)
    return np.frombuffer(expand(body), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def chunk_ends(inner: np.ndarray, offsets: np.ndarray, window: int, gap: int, most: int) -> np.ndarray:
    """Ends of chunks, from ascending candidate cuts ``inner``; with all ends of non-empty rows.

    A candidate counts if its window lies in its row and no candidate of the row is within
    ``gap`` before it; chunks end after ``most`` elements at last."""
    row = np.searchsorted(offsets, inner, side="left") - 1
    fits = (inner - window >= offsets[row]) & (inner < offsets[row + 1])
    inner, row = inner[fits], row[fits]
    apart = np.ones(len(inner), bool)
    apart[1:] = (np.diff(inner) > gap) | (row[1:] != row[:-1])
    ends = np.unique(np.concatenate([inner[apart], offsets[1:]]))
    ends = ends[ends > 0].astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    long = np.flatnonzero(sizes > most)
    if len(long):
        ends = np.unique(np.concatenate([ends, *(np.arange(ends[i] - sizes[i] + most, ends[i], most) for i in long)]))
    return ends
