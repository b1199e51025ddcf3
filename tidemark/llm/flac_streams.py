"""FLAC streams of any encoder: one frame after another, with all kinds of subframes, channels and sample sizes.

For streams that weren't written by ``op1_flac``'s encoder, whose own decoder works on many
equal frames at once.  ``Broken`` says that bytes contradict the format or a checksum,
``Unsupported`` that the format reserves what the stream uses.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

# Fixed values of the format (RFC 9639).
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


class Broken(ValueError):
    pass


class Unsupported(ValueError):
    pass


class Pcm(NamedTuple):
    rate: int
    bits: int
    samples: np.ndarray  # a row for each sample, a column for each channel
    places: list[tuple[int, int]]  # first sample and byte offset of each frame


class Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.bit = data, 8 * at

    def take(self, n: int) -> int:
        first, last = self.bit >> 3, (self.bit + n + 7) >> 3
        if last > len(self.data):
            raise Broken("the stream ends within a frame")
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.bit - n)
        self.bit += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (value >> (n - 1) << n) if n else 0

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def number(self) -> int:
        """The format's UTF-8 like code."""
        lead = self.take(8)
        more = 0
        while more < 8 and lead & (0x80 >> more):
            more += 1
        if more in (1, 8):
            raise Broken("a frame number begins with a byte that can't begin one")
        value = lead & (0x7F >> more)
        for _ in range(max(0, more - 1)):
            value = value << 6 | (self.take(8) & 0x3F)
        return value


def checksum(data: bytes, poly: int, bits: int) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc >> (bits - 1) else crc << 1) & ((1 << bits) - 1)
    return crc


def residuals(r: Reader, size: int, order: int) -> list[int]:
    method, parts = r.take(2), 1 << r.take(4)
    if method > 1:
        raise Unsupported("a reserved way of residuals")
    if size % parts or size // parts < order:
        raise Broken("partitions don't divide the block")
    wide, out = (4, 5)[method], []
    for part in range(parts):
        n, k = size // parts - (0 if part else order), r.take(wide)
        if k == (1 << wide) - 1:  # an escape: plain numbers
            plain = r.take(5)
            out += [r.signed(plain) for _ in range(n)]
            continue
        for _ in range(n):
            u = r.unary() << k | r.take(k)
            out.append((u >> 1) ^ -(u & 1))
    return out


def subframe(r: Reader, size: int, bits: int) -> list[int]:
    if r.take(1):
        raise Broken("a subframe's first bit is set")
    kind = r.take(6)
    wasted = r.unary() + 1 if r.take(1) else 0
    bits -= wasted
    if kind == 0:
        x = [r.signed(bits)] * size
    elif kind == 1:
        x = [r.signed(bits) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        if order > size:
            raise Broken("a predictor is longer than its block")
        x = [r.signed(bits) for _ in range(order)]
        coefficients, shift = FIXED[order] if kind <= 12 else (), 0
        if kind >= 32:
            precision = r.take(4) + 1
            shift = r.signed(5)
            if precision == 16 or shift < 0:
                raise Unsupported("a reserved precision or shift")
            coefficients = [r.signed(precision) for _ in range(order)]
        for e in residuals(r, size, order):
            x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(coefficients)) >> shift))
    else:
        raise Unsupported(f"subframes of reserved kind {kind}")
    return [v << wasted for v in x]


def frame(data: bytes, at: int, info: dict) -> tuple[list[list[int]], int]:
    """Samples of each channel, and the byte after the frame."""
    r = Reader(data, at)
    if r.take(15) != 0x7FFC:
        raise Broken(f"no frame begins at byte {at}")
    r.take(1)
    size, rate, channels, bits = r.take(4), r.take(4), r.take(4), r.take(3)
    if size == 0 or rate == 15 or channels > MID_SIDE or bits == 3 or r.take(1):
        raise Unsupported("a frame's header has reserved values")
    r.number()
    size = r.take((8, 16)[size - 6]) + 1 if size in (6, 7) else BLOCK_SIZES[size]
    r.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = r.bit >> 3
    if r.take(8) != checksum(data[at:head], 0x07, 8):
        raise Broken(f"the header at byte {at} has another checksum")
    bits = SAMPLE_BITS[bits] if bits else info["bits"]
    side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(channels)
    x = [subframe(r, size, bits + (c == side)) for c in range(channels + 1 if side is None else 2)]
    end = (r.bit + 7) >> 3
    r.bit = 8 * end
    if r.take(16) != checksum(data[at:end], 0x8005, 16):
        raise Broken(f"the frame at byte {at} has another checksum")
    if channels == LEFT_SIDE:
        x[1] = [a - b for a, b in zip(*x, strict=True)]
    elif channels == SIDE_RIGHT:
        x[0] = [a + b for a, b in zip(*x, strict=True)]
    elif channels == MID_SIDE:
        whole = [(m << 1 | s & 1, s) for m, s in zip(*x, strict=True)]
        x = [[(m + s) >> 1 for m, s in whole], [(m - s) >> 1 for m, s in whole]]
    return x, end + 2


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples in as few bytes as hold them."""
    wide = (bits + 7) // 8
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()


def decode(data: bytes, info: dict) -> Pcm:
    """All samples of a stream with header ``info`` (frames, samples, md5, rate, channels, bits); a length of 0 is unknown."""
    at, parts, places, done = info["frames"], [], [], 0
    while at < len(data) and (not info["samples"] or done < info["samples"]):
        places.append((done, at - info["frames"]))
        x, at = frame(data, at, info)
        parts.append(np.array(x, np.int64).T)
        done += len(parts[-1])
    samples = np.concatenate(parts) if parts else np.zeros((0, info["channels"]), np.int64)
    if info["samples"] and done != info["samples"]:
        raise Broken("samples are missing")
    if any(info["md5"]) and hashlib.md5(pcm_bytes(samples, info["bits"])).digest() != info["md5"]:
        raise Broken("the samples have another MD5")
    return Pcm(info["rate"], info["bits"], samples, places)
