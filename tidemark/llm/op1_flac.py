"""Media columns: FLAC streams with 192-sample frames, eight bits, one channel.

``encode_media`` stores the bytes of a text as samples (byte minus 128), padded with
blanks to whole frames.  ``open_streams`` reads the stored bytes: it finds frames by sync
code, number and header checksum, decodes Rice residuals and linear predictors, verifies
frame checksums, the stream's length, its MD5 and its seek table, and gives PCM blocks with
their sample offsets; the last block is decoded once more from the seek table's nearest
point and must be the same.  ``pcm_blocks`` writes those blocks as rows, ``decode_media``
computes its columns from them, and ``seek`` reads any range.

All frames of a slice are coded in step: one numpy operation handles the same position
of thousands of frames, so no Python loop runs over samples of single documents.  Streams
of other encoders (other block sizes, channels, sample sizes) are decoded frame by frame
in ``flac_streams``; their PCM is interleaved, signed and little-endian.

Defined cases: a null or empty text is one frame of blanks; equal texts give equal
streams, also of rows that repeat a doc_id or have none; a very long text is coded in groups
of frames of bounded size; a broken stream gives ``state`` ``broken`` (bad checksum, wrong
MD5, frames missing, wrong seek point) and no samples, one that uses what the format
reserves ``unsupported``; a null stream is broken; an empty table gives no rows; other
columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac_streams
from .blocks import text_slices

# Fixed values of the format (RFC 9639).
FRAME = 192  # samples, block size code 1
MAGIC = b"fLaC"
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
SYNC = (0xFF, 0xF8, 0x10, 0x02)

RATE = 8000
LPC_ORDER, PRECISION = 4, 9
PARTITIONS = 4  # of a frame's residuals
SEEK_FRAMES = 32
GROUP = 16384  # frames coded at once
BLOCK_FRAMES = 64  # of a PCM block


def _table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = (table << 1) ^ np.where(table >> (bits - 1) & 1, poly, 0).astype(np.uint32)
        table &= (1 << bits) - 1
    return table


CRC8, CRC16 = _table(0x07, 8).astype(np.uint8), _table(0x8005, 16).astype(np.uint16)
_CLZ = np.array([16] + [16 - i.bit_length() for i in range(1, 65536)], np.int64)


def crc8(columns: list[np.ndarray], widths: list[np.ndarray]) -> np.ndarray:
    crc = np.zeros(len(columns[0]), np.uint8)
    for byte, wide in zip(columns, widths, strict=True):
        crc = np.where(wide > 0, CRC8[crc ^ byte.astype(np.uint8)], crc)
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of data[starts[i]:ends[i]].  Zeros in front don't change one, so all ranges are aligned at their ends."""
    crc = np.zeros(len(starts), np.uint16)
    longest = int((ends - starts).max(initial=0))
    for back in range(longest, 0, -1):
        at = ends - back
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0)
        crc = (crc << np.uint16(8)) ^ CRC16[(crc >> np.uint16(8)) ^ byte]
    return crc


def frame_numbers(numbers: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bytes and widths of the numbers in the format's UTF-8 like code; six columns."""
    n = numbers.astype(np.int64)
    more = (n >= 0x80).astype(int) + (n >= 0x800) + (n >= 0x10000) + (n >= 0x200000) + (n >= 0x4000000)
    lead = np.array([0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])
    values = [lead[more] | (n >> (6 * more))]
    for i in range(1, 6):
        values.append(0x80 | ((n >> np.maximum(6 * (more - i), 0)) & 0x3F))
    widths = [np.full(len(n), 8)] + [np.where(more >= i, 8, 0) for i in range(1, 6)]
    return values, widths


def rice(residual: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag residuals (those before ``order`` zero), a parameter for each partition, and the frames' bits."""
    u = (residual << 1) ^ (residual >> 31)
    parts = u.reshape(len(u), PARTITIONS, -1)
    n = np.full(PARTITIONS, FRAME // PARTITIONS)
    n[0] -= order
    k = np.clip(np.floor(np.log2(np.maximum(parts.sum(axis=2) / n, 1))), 0, 8).astype(np.int32)
    bits = 6 + 4 * PARTITIONS + (n * (1 + k)).sum(axis=1) + (parts >> k[:, :, None]).sum(axis=(1, 2))
    return u, k, bits


def linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of order LPC_ORDER and shifts, by Levinson's recursion on all frames at once."""
    f = x.astype(np.float64)
    auto = np.stack([(f[:, lag:] * f[:, : FRAME - lag]).sum(axis=1) for lag in range(LPC_ORDER + 1)])
    auto[0] = auto[0] * 1.0001 + 1
    a = np.zeros((LPC_ORDER, len(x)))
    error = auto[0].copy()
    for i in range(LPC_ORDER):
        reflect = (auto[i + 1] - (a[:i] * auto[i:0:-1][:i]).sum(axis=0)) / error
        a[:i] = a[:i] - reflect * a[:i][::-1]
        a[i] = reflect
        error = np.maximum(error * (1 - reflect**2), 1e-9)
    most = np.maximum(np.abs(a).max(axis=0), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)), 0, 12).astype(np.int64)
    half = 1 << (PRECISION - 1)
    return np.clip(np.round(a * (1 << shift)), -half, half - 1).astype(np.int64), shift


def predict(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals; x has LPC_ORDER or more samples in each row."""
    order = len(coefficients)
    total = np.zeros((len(x), FRAME - order), np.int32)
    for j in range(order):
        total += x[:, order - 1 - j : FRAME - 1 - j] * coefficients[j].astype(np.int32)[:, None]
    out = np.zeros_like(x)
    out[:, order:] = x[:, order:] - (total >> shift.astype(np.int32)[:, None])
    return out


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of samples x (rows of FRAME) one after another, and where each begins (n + 1)."""
    n = len(x)
    x = x.astype(np.int32)
    coefficients, shift = linear_predictors(x)
    kind, order = np.full(n, 1), np.zeros(n, np.int64)  # verbatim, unless another way is shorter
    residual, cost = x, np.abs(x).sum(axis=1)
    chosen, fixed = x.copy(), np.zeros(n, np.int64)
    for o in list(FIXED)[1:]:
        residual = np.diff(residual, axis=1)
        size = np.abs(residual).sum(axis=1)
        less = np.flatnonzero(size < cost)
        cost[less], fixed[less] = size[less], o
        chosen[less, :o] = 0
        chosen[less, o:] = residual[less]
    u, k, bits = rice(chosen, 0)
    pu, pk, pbits = rice(predict(x, coefficients, shift), LPC_ORDER)
    bits, pbits = bits + 8 * fixed, pbits + 9 + (PRECISION + 8) * LPC_ORDER
    lpc = np.flatnonzero(pbits < bits)
    u[lpc], k[lpc] = pu[lpc], pk[lpc]
    kind = np.where(np.minimum(bits, pbits) < 8 * FRAME, np.where(pbits < bits, 32 + LPC_ORDER - 1, 8 + fixed), kind)
    order = np.where(kind >= 32, LPC_ORDER, np.where(kind >= 8, fixed, order))
    flat = (x == x[:, :1]).all(axis=1)
    kind, order = np.where(flat, 0, kind), np.where(flat, 1, order)
    coded, plain, lpc = kind >= 8, kind == 1, kind >= 32

    values: list[np.ndarray] = [np.full(n, b) for b in SYNC]
    lengths: list[np.ndarray] = [np.full(n, 8)] * 4
    v, w = frame_numbers(numbers)
    values, lengths = values + v, lengths + w
    values.append(crc8(values, lengths))
    values.append(kind * 2)
    lengths += [np.full(n, 8)] * 2
    for i in range(LPC_ORDER):
        values.append(x[:, i] & 255)
        lengths.append(np.where(order > i, 8, 0))
    values += [np.full(n, PRECISION - 1), shift & 31, *(coefficients & ((1 << PRECISION) - 1)), np.full(n, PARTITIONS.bit_length() - 1)]
    lengths += [np.where(lpc, 4, 0), np.where(lpc, 5, 0), *[np.where(lpc, PRECISION, 0)] * LPC_ORDER, np.where(coded, 6, 0)]
    step = FRAME // PARTITIONS
    head = len(values)
    value = np.zeros((n, head + PARTITIONS * (step + 1)), np.int32)
    length = np.zeros_like(value)
    wide = np.zeros_like(value)
    value[:, :head] = np.stack(values, axis=1)
    length[:, :head] = wide[:, :head] = np.stack(lengths, axis=1)
    for p in range(PARTITIONS):
        at = head + p * (step + 1)
        value[:, at], wide[:, at] = k[:, p], np.where(coded, 4, 0)
        length[:, at] = wide[:, at]
        kp = k[:, p, None].astype(np.int32)
        up, own = u[:, p * step : (p + 1) * step], slice(at + 1, at + 1 + step)
        live = coded[:, None] & (np.arange(p * step, (p + 1) * step) >= order[:, None])
        value[:, own] = np.where(live, (1 << kp) | (up & ((1 << kp) - 1)), np.where(plain[:, None], x[:, p * step : (p + 1) * step] & 255, 0))
        wide[:, own] = np.where(live, kp + 1, np.where(plain[:, None], 8, 0))
        length[:, own] = np.where(live, (up >> kp) + kp + 1, wide[:, own])
    ends = np.cumsum(length, axis=1, dtype=np.int64)
    sizes = (ends[:, -1] + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first = ends - wide + 8 * starts[:-1, None]  # bit where a field's own bits begin
    live = wide > 0
    first, wide, value = first[live], wide[live], value[live]
    shifted = value << (16 - (first & 7) - wide)
    at = first >> 3
    total = int(starts[-1])
    out = (np.bincount(at, shifted >> 8, total + 1) + np.bincount(at + 1, shifted & 255, total + 1))[:total].astype(np.uint8)
    check = crc16(out, starts[:-1], starts[1:] - 2)
    out[starts[1:] - 2], out[starts[1:] - 1] = check >> 8, check & 255
    return out, starts


def stream(samples: bytes, frames: bytes, sizes: np.ndarray) -> bytes:
    """A whole stream: header, seek table, frames.  samples: the signed 8-bit ones."""
    places = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    info = struct.pack(">HH", FRAME, FRAME) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | len(samples)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    seek = b"".join(struct.pack(">QQH", i * FRAME, int(places[i]), FRAME) for i in range(0, len(sizes), SEEK_FRAMES))
    return MAGIC + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + frames


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """Streams of payloads, whose lengths are multiples of FRAME."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    x = (data ^ 128).view(np.int8).reshape(-1, FRAME)
    counts = np.array([len(p) // FRAME for p in payloads])
    numbers = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    made, sizes = [], []
    for i in range(0, len(x), GROUP):
        out, starts = encode_frames(x[i : i + GROUP], numbers[i : i + GROUP])
        made.append(out.tobytes())
        sizes.append(np.diff(starts))
    body, size = b"".join(made), np.concatenate(sizes)
    streams, at, frame, signed = [], 0, 0, memoryview(x.tobytes())
    for c in counts.tolist():
        own = size[frame : frame + c]
        streams.append(stream(signed[frame * FRAME : (frame + c) * FRAME], body[at : at + int(own.sum())], own))
        at, frame = at + int(own.sum()), frame + c
    return streams


class Bits:
    """Reads the same field of many frames at once."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.eight, self.last = np.ndarray((len(data) + 8,), "<u8", buffer=padded, strides=(1,)), len(data) + 7
        self.at = starts.astype(np.int64) * 8

    def some(self, frames: np.ndarray) -> Bits:
        """The same for some of the frames."""
        one = Bits.__new__(Bits)
        one.eight, one.last, one.at = self.eight, self.last, self.at[frames]
        return one

    def window(self) -> np.ndarray:
        """The next 57 bits or more, from the top."""
        return self.eight[np.minimum(self.at >> 3, self.last)].byteswap() << (self.at & 7).view(np.uint64)

    def take(self, bits) -> np.ndarray:
        """Unsigned values of ``bits`` bits, a number or an array; 0 bits give 0."""
        bits = np.broadcast_to(bits, self.at.shape).astype(np.int64)
        value = (self.window() >> np.uint64(1)) >> (63 - bits).astype(np.uint64)
        self.at = self.at + bits
        return value.astype(np.int64)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """Zigzag values."""
        window = self.window()
        zeros = _CLZ[(window >> np.uint64(48)).view(np.int64)]
        if zeros.max(initial=0) == 16:
            for i in np.flatnonzero(zeros == 16):
                one, total = self.some(np.array([i])), 0
                while (z := int(_CLZ[int(one.window()[0] >> np.uint64(48))])) == 16 and total < 8 * self.last:
                    one.at, total = one.at + 16, total + 16
                zeros[i] = total + z
            self.at = self.at + zeros + 1
            low = self.take(k)
        else:
            low = ((window << (zeros + 1).view(np.uint64)) >> np.uint64(1) >> (63 - k).view(np.uint64)).view(np.int64)
            self.at = self.at + (zeros + 1 + k)
        return zeros << k | low


def signed(values: np.ndarray, bits) -> np.ndarray:
    return values - ((values >> (np.maximum(bits, 1) - 1) & 1) << bits)


def residuals(bits: Bits, x: np.ndarray, order: np.ndarray, lpc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (FRAME rows, a column for each frame) from predictors and residuals; x has those before ``order``.  Then whether the fields make sense."""
    n, most = len(order), int(order.max(initial=0))
    precision = bits.take(np.where(lpc, 4, 0)) + 1
    shift = np.where(lpc, signed(bits.take(np.where(lpc, 5, 0)), 5), 0)
    c = np.zeros((most, n), np.int64)
    for j in range(most):
        wide = np.where(lpc & (order > j), precision, 0)
        c[j] = np.where(wide > 0, signed(bits.take(wide), wide), 0)
        for o, known in FIXED.items():
            if j < len(known):
                c[j] = np.where(~lpc & (order == o), known[j], c[j])
    method = bits.take(6)
    parts = 1 << (method & 15)
    good = (method < 16) & (FRAME % parts == 0) & (shift >= 0)
    parts, shift = np.where(good, parts, 1), np.where(good, shift, 0)
    step, k = FRAME // parts, np.zeros(n, np.int64)
    steps = np.unique(step)
    for i in range(FRAME):
        if (i % steps == 0).any():
            begins = i % step == 0
            k = np.where(begins, bits.take(np.where(begins, 4, 0)), k)
        if i < most:
            before = bits.at
            u = bits.rice(k)
            live = i >= order
            bits.at, u = np.where(live, bits.at, before), np.where(live, u, 0)
        else:
            u = bits.rice(k)
        value = (u >> 1) ^ -(u & 1)
        if most and i:
            guess = c[0] * x[i - 1]
            for j in range(1, min(most, i)):
                guess += c[j] * x[i - 1 - j]
            value += guess >> shift
        x[i] = np.where(live, value, x[i]) if i < most else value
    return x, good


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples (rows of FRAME, int8), frame numbers, ends, and whether both checksums hold, of the frames that begin at ``starts``."""
    n = len(starts)
    bits = Bits(data, starts)
    columns = [bits.take(8) for _ in range(4)]
    fine = (columns[0] == SYNC[0]) & (columns[1] == SYNC[1]) & (columns[2] == SYNC[2]) & (columns[3] == SYNC[3])
    lead = bits.take(8)
    more = np.clip(8 - 1 - np.floor(np.log2(np.maximum(lead ^ 255, 1))).astype(np.int64) - 1, 0, 5)
    number = lead & np.where(lead < 0x80, 0x7F, (1 << (6 - more)) - 1)
    columns.append(lead)
    widths = [np.full(n, 8)] * 5
    for i in range(5):
        wide = np.where(more > i, 8, 0)
        byte = bits.take(wide)
        number = np.where(more > i, number << 6 | (byte & 0x3F), number)
        columns.append(byte)
        widths.append(wide)
    fine &= bits.take(8) == crc8(columns, widths)
    kind = bits.take(8) >> 1
    constant, plain, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    fine &= constant | plain | fixed | lpc
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, np.where(constant, 1, 0)))
    most = int(order.max(initial=0))
    x = np.zeros((FRAME, n), np.int64)
    for i in range(most):
        wide = np.where(order > i, 8, 0)
        x[i] = np.where(order > i, signed(bits.take(wide), wide), 0)
    x[:, plain] = data[np.minimum((bits.at[plain] >> 3) + np.arange(FRAME)[:, None], len(data) - 1)].view(np.int8)  # whole bytes, as the header is
    bits.at[plain] += 8 * FRAME
    x[:, constant] = x[0, constant]
    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        own = bits.some(coded)
        x[:, coded], good = residuals(own, x[:, coded], order[coded], lpc[coded])
        bits.at[coded], fine[coded] = own.at, fine[coded] & good
    ends = np.minimum((bits.at + 7) // 8 + 2, len(data))
    check = crc16(data, starts, ends - 2)
    fine &= (data[ends - 2].astype(np.uint16) << 8 | data[ends - 1]) == check
    return x.T.astype(np.int8), number, ends, fine


def header(media: bytes) -> dict | None:
    """Length in samples, form of the samples, MD5, seek points and the place of the first frame."""
    if media[:4] != MAGIC:
        return None
    at, found = 4, {"seek": []}
    while at + 4 <= len(media):
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if len(body) < size or kind == 0 and size != 34 or kind == 3 and size % 18:
            return None
        if kind == 0:
            form = int.from_bytes(body[10:18], "big")
            found |= {"samples": form & ((1 << 36) - 1), "bits": (form >> 36 & 31) + 1, "channels": (form >> 41 & 7) + 1, "rate": form >> 44, "block": struct.unpack(">HH", body[:4]), "md5": body[18:34]}
        elif kind == 3:
            found["seek"] = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size, 18)]
        at += 4 + size
        if last:
            return found | {"frames": at} if "samples" in found else None
    return None


def frame_starts(media: np.ndarray, first: int, frames: int) -> np.ndarray | None:
    """Where the frames 0, 1, ... begin, by sync code, number and header checksum; None if they can't be told apart that way."""
    body = media[first:]
    hit = np.flatnonzero((body[:-3] == SYNC[0]) & (body[1:-2] == SYNC[1]) & (body[2:-1] == SYNC[2]) & (body[3:] == SYNC[3])) + first
    return hit if len(hit) == frames else None


def walk(media: np.ndarray, first: int, frames: int) -> np.ndarray:
    """The same one frame after another, for a stream in which a sync code occurs by chance."""
    starts = [first]
    while len(starts) < frames:
        end = int(decode_frames(media, np.array([starts[-1]]))[2][0])
        if end >= len(media):
            break
        starts.append(end)
    return np.array(starts)


def own_form(h: dict) -> bool:
    """Whether a stream has the form of ``encode_media``."""
    return h["block"] == (FRAME, FRAME) and h["bits"] == 8 and h["channels"] == 1 and h["samples"] > 0 and h["samples"] % FRAME == 0


class Opened(NamedTuple):
    state: str  # intact, broken or unsupported
    blocks: list[tuple[int, bytes]]  # sample offset and PCM of each block
    channels: int
    bits: int


BROKEN, UNSUPPORTED = Opened("broken", [], 0, 0), Opened("unsupported", [], 0, 0)


def open_streams(medias: list[bytes], frames: int = BLOCK_FRAMES) -> list[Opened]:
    """PCM blocks of ``frames`` frames of each stream, verified and sought."""
    out = [BROKEN] * len(medias)
    heads, starts, owner, base = [header(m) for m in medias], [], [], 0
    for i, (m, h) in enumerate(zip(medias, heads, strict=True)):
        if h and not own_form(h):
            out[i] = open_other(m, h, frames * FRAME)
        elif h:
            a, n = np.frombuffer(m, np.uint8), h["samples"] // FRAME
            own = frame_starts(a, h["frames"], n)
            own = walk(a, h["frames"], n) if own is None else own
            points = np.array([(first // FRAME, place) for first, place, _ in h["seek"]], np.int64).reshape(-1, 2)
            if len(own) == n and (points[:, 0] < n).all() and (own[points[:, 0]] == h["frames"] + points[:, 1]).all():
                starts.append(own + base)
                owner.append((i, n))
        base += len(m)
    if not owner:
        return out
    data, at = np.frombuffer(b"".join(medias), np.uint8), np.concatenate(starts)
    parts = [decode_frames(data, at[i : i + GROUP]) for i in range(0, len(at), GROUP)]
    x, number, fine = (np.concatenate([p[j] for p in parts]) for j in (0, 1, 3))
    # The frame at the last seek point of each stream, decoded from the place that the table names.
    begin = np.cumsum([0] + [n for _, n in owner])
    last = [max((p[:2] for p in heads[i]["seek"]), default=(0, 0)) for i, _ in owner]
    offsets = np.cumsum([0] + [len(m) for m in medias])
    sought, _, _, good = decode_frames(data, np.array([offsets[i] + heads[i]["frames"] + place for (i, _), (_, place) in zip(owner, last, strict=True)]))
    good &= (sought == x[begin[:-1] + np.array([first // FRAME for first, _ in last])]).all(axis=1)
    for (i, n), frame, found in zip(owner, begin, good, strict=False):
        own = slice(frame, frame + n)
        samples = x[own].tobytes()
        if found and fine[own].all() and (number[own] == np.arange(n)).all() and hashlib.md5(samples).digest() == heads[i]["md5"]:
            pcm, step = (x[own].view(np.uint8) ^ 128).tobytes(), frames * FRAME
            out[i] = Opened("intact", [(a, pcm[a : a + step]) for a in range(0, len(pcm), step)], 1, 8)
    return out


def open_other(media: bytes, h: dict, step: int) -> Opened:
    """The same of a stream of another form; blocks have ``step`` samples."""
    try:
        pcm = flac_streams.decode(media, h)
    except flac_streams.Unsupported:
        return UNSUPPORTED
    except flac_streams.Broken:
        return BROKEN
    if not {p[:2] for p in h["seek"] if p[0] != (1 << 64) - 1} <= set(pcm.places):  # all ones: a point that is kept free
        return BROKEN
    blocks = [(a, flac_streams.pcm_bytes(pcm.samples[a : a + step], pcm.bits)) for a in range(0, len(pcm.samples), step)]
    return Opened("intact", blocks, h["channels"], pcm.bits)


def decode_streams(medias: list[bytes]) -> list[bytes | None]:
    """Payloads; None for a stream that isn't intact."""
    return [b"".join(pcm for _, pcm in s.blocks) if s.state == "intact" else None for s in open_streams(medias)]


def seek(media: bytes, sample: int, count: int) -> bytes:
    """``count`` payload bytes from ``sample`` on, decoded from the nearest seek point before."""
    h = header(media)
    data = np.frombuffer(media, np.uint8)
    first, place, _ = max(p for p in h["seek"] if p[0] <= sample)
    at, got = h["frames"] + place, []
    last = min(sample + count, h["samples"])
    while first + FRAME * len(got) < last:
        x, _, end, fine = decode_frames(data, np.array([at]))
        if not fine[0]:
            raise ValueError(f"broken frame at byte {at}")
        got.append((x[0].view(np.uint8) ^ 128).tobytes())
        at = int(end[0])
    return b"".join(got)[sample - first : last - first]


def payload(raw: bytes) -> bytes:
    """The bytes, with blanks up to a positive multiple of FRAME."""
    return raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME))


def encode_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text of each document as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, limit=2 << 20):
            raw, edges = data.tobytes(), offsets.tolist()
            medias = encode_streams([payload(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(medias, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for rows, data, offsets in text_slices(batches, "media", limit):
        raw, edges = data.tobytes(), offsets.tolist()
        yield rows, [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def pcm_blocks(media: DataFrame, frames: int = BLOCK_FRAMES) -> DataFrame:
    """doc_id, sample_offset, samples, pcm, channels, bits, state: blocks of ``frames`` frames of each stream; one that isn't intact gives one row without samples."""
    names = ["doc_id", "sample_offset", "samples", "pcm", "channels", "bits", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, medias in _slices(batches, 2 << 20):
            out: list[list] = [[] for _ in names]
            for doc, s in zip(rows.column("doc_id").to_pylist(), open_streams(medias, frames), strict=True):
                for at, pcm in s.blocks or [(0, None)]:
                    n = len(pcm or b"") // (s.channels * ((s.bits + 7) // 8) or 1)
                    for column, value in zip(out, (doc, at, n, pcm, s.channels, s.bits, s.state), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, sample_offset long, samples long, pcm binary, channels int, bits int, state string")


def measured(blocks: list[tuple[int, bytes]]) -> tuple[int, str, int, str]:
    """Length, SHA-256, checksum of the last 16 bytes, and feature (sum, energy, sign changes and peak of the signed samples) of PCM blocks, one after another."""
    whole, size, total, energy, turns, peak, before = hashlib.sha256(), 0, 0, 0, 0, 0, None
    for at, pcm in blocks:
        if at != size:
            raise ValueError(f"a block begins at sample {at}, not {size}")
        whole.update(pcm)
        x = (np.frombuffer(pcm, np.uint8) ^ 128).view(np.int8).astype(np.int64)
        negative = x < 0
        turns += np.count_nonzero(negative[1:] != negative[:-1]) + int(before is not None and before != negative[0])
        total, energy, peak, before, size = total + int(x.sum()), energy + int((x * x).sum()), max(peak, int(np.abs(x).max())), negative[-1], size + len(pcm)
    return size, whole.hexdigest(), zlib.crc32(blocks[-1][1][-16:]), f"sum={total};energy={energy};turns={turns};peak={peak}"


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored streams of ``encode_media`` hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_blocks, state; all from PCM blocks."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, medias in _slices(batches, 2 << 20):
            streams = open_streams(medias)
            size, whole, tail, feature = zip(*(measured(s.blocks) if s.state == "intact" and s.bits == 8 else (None,) * 4 for s in streams), strict=True)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_bytes"), pa.array(size, pa.int64()), pa.array(whole, pa.string()), pa.array(tail, pa.int64()),
                 pa.array([len(m) for m in medias], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in medias], pa.string()), pa.array(feature, pa.string()),
                 pa.array([len(s.blocks) for s in streams], pa.int64()), pa.array([s.state for s in streams])],
                names,
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, state string")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return decode_media(encode_media(table(spark, sf_dir, "documents")))
