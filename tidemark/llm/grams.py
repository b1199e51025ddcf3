"""Hashed byte n-grams of texts, for the linear models of this subpackage."""

from __future__ import annotations

import numpy as np

from .blocks import _M1, _MASK, lower_ascii

# Letters and digits stay (lower-cased A-Z, all bytes from 128 on), other bytes are blanks.
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
#: Runs of these end a sentence.
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True
WINDOW = 4 << 20  # bytes; not less than the slices of the operators that use gram_sums


def gram_ids(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte, a row for each size; -1 where it would leave its text or is all blanks."""
    plain = _PLAIN[lower_ascii(data)]
    padded = np.concatenate([plain, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    out = np.empty((len(sizes), len(data)), np.int32)
    for row, size in enumerate(sizes):
        x = (eight & _MASK[size]) * _M1
        x = (x ^ (x >> np.uint64(31)) ^ np.uint64(size)) * _M1
        out[row] = (x >> np.uint64(64 - bits)).astype(np.int32)
        out[row][(left < size) | ((plain == 0x20) & (padded[size - 1 : size - 1 + len(data)] == 0x20))] = -1
    return out


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the sentences (n + 1) and the first sentence of each text (texts + 1); non-empty texts have one at least."""
    stop = _STOP[data]
    ends = np.flatnonzero(stop[:-1] & ~stop[1:]) + 1 if len(data) else np.zeros(0, np.int64)
    edges = np.unique(np.concatenate([ends, offsets]))
    return edges, np.searchsorted(edges, offsets)


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i + 1]]; each depends on its own values only, so equal runs have equal sums wherever they stand."""
    out = np.zeros(len(edges) - 1)
    some = edges[1:] > edges[:-1]
    if some.any():
        out[some] = np.add.reduceat(values[: edges[-1]], edges[:-1][some], dtype=np.float64)
    return out


def gram_sums(columns: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, edges: np.ndarray, sizes: tuple[int, ...], bits: int, window: int = WINDOW) -> np.ndarray:
    """For each column of bucket weights, the sums over the n-grams that begin in data[edges[i]:edges[i + 1]]; a row for each column.

    A single text that is longer than ``window`` is worked through in windows counted from
    its begin, so memory doesn't grow with it; several texts together are one window."""
    step = window if len(offsets) == 2 else max(1, len(data))
    weights = [np.append(c, 0).astype(c.dtype) for c in columns]
    out = np.zeros((len(columns), len(edges) - 1))
    for a in range(0, len(data), step):
        b = min(a + step, len(data))
        upto = min(b + max(sizes), len(data))
        ids = gram_ids(data[a:upto], np.clip(offsets, a, upto) - a, sizes, bits)[:, : b - a]
        first, last = np.searchsorted(edges, a, side="right") - 1, np.searchsorted(edges, b, side="left")
        own = np.clip(edges[first : last + 1], a, b) - a
        for total, weight in zip(out, weights, strict=True):
            total[first:last] += sums(weight[ids].sum(axis=0), own)
    return out
