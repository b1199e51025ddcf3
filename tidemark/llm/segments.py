"""Cuts of texts at places where the pre-token patterns of byte-pair vocabularies always begin a match.

Patterns of the form ``'s|'t|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin a
match before a run of white space, before the last white space of a run that a word
follows, and where letters, digits and signs meet (but after an apostrophe, which may
begin a contraction).  A library that encodes the pieces one by one gives the ids of the
whole text, so distinct pieces need encoding only once.  White space is what Unicode calls
so; characters whose class depends on the version of Unicode are left with their neighbours.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

SIGNS = {"L": 1, "N": 2}  # kinds of Unicode's classes; others are signs

_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 sign, 4 beyond ASCII
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 4


def wide_space(data: np.ndarray) -> np.ndarray:
    """Places of UTF-8 sequences of white space beyond ASCII."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = data[at], padded[at + 1], padded[at + 2]
    return at[
        ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
        | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    ]


@cache
def code_class(code: int) -> int:
    """Kind of a character beyond ASCII; 4 if it isn't in Unicode 3.2 or has changed its kind since, as libraries differ in their versions."""
    now, then = (SIGNS.get(x.category(chr(code))[0], 3) for x in (unicodedata, unicodedata.ucd_3_2_0))
    return now if now == then and unicodedata.ucd_3_2_0.category(chr(code))[0] not in "CZ" else 4


def wide_kinds(data: np.ndarray, kind: np.ndarray) -> None:
    """Sets the kinds of the bytes of letters, digits and signs beyond ASCII."""
    lead = np.flatnonzero(data >= 0xC0)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    code = padded[lead] & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        code = np.where(size > k, code << 6 | padded[lead + k] & 0x3F, code)
    found, places = np.unique(code, return_inverse=True)
    own = np.array([code_class(int(c)) for c in found], np.uint8)[places] if len(found) else np.zeros(0, np.uint8)
    for k in range(4):
        kind[lead[size > k] + k] = own[size > k]


def cuts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the pieces (n + 1), which cover all bytes, and the first piece of each text (texts + 1).

    Texts whose rows are in ``whole`` are one piece; with ``ascii_only`` (for tokenizers that
    compose characters before they split) those with white space beyond ASCII are too, and
    no character beyond ASCII is cut from its neighbours."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    kind, wide = _KIND[data], wide_space(data)
    back = np.zeros(len(data), np.int64)  # from the last byte of a white space to its first
    if not ascii_only:
        if (data >= 0xC0).any():
            wide_kinds(data, kind)
        size = np.where(data[wide] == 0xC2, 2, 3)
        for k in range(3):
            kind[wide[size > k] + k] = 0
        back[wide + size - 1] = size - 1
    space = kind == 0
    cut = np.zeros(len(data) + 1, bool)
    last = np.zeros(len(data) + 1, bool)  # a text ends before
    last[offsets] = True
    before, here = kind[:-1], kind[1:]
    cut[1:-1] = (before != here) & (((before < 4) & (here < 4) & (before > 0) & (here > 0) & (data[:-1] != 0x27)) | (here == 0))
    word_next = np.zeros(len(data), bool)
    word_next[:-1] = ~space[1:] & ~last[1:-1]
    final = np.flatnonzero(space & word_next)  # last bytes of runs of white space
    final -= back[final]
    cut[final[(final > 0) & space[final - 1]]] = True
    rows = np.searchsorted(offsets, wide, side="right") - 1 if ascii_only else np.zeros(0, np.int64)
    for row in np.unique(rows if whole is None else np.concatenate([rows, whole])):
        cut[offsets[row] : offsets[row + 1]] = False
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    return edges, np.searchsorted(edges, offsets)
