"""Media columns in lossless WebP: bytes as RGBA samples, stored and decoded to pixel arrays.

The encoder writes literals, cache references and back-references. Images of few colours get a palette, and those of OWN
pixels or more prefix codes of their own and, where their bytes take fewer bits so, the predictor, cross-colour or
subtract-green transform; the smallest stream is kept. All others share one set of codes, since tables for each small
image would take most of the time.

The decoder reads the whole format. Images under one set of prefix codes are decoded in arrays, those that share a header
many at a time: the end of a symbol is computed for every bit position at once, following these ends from each image's
first bit gives its symbols, and what references copy is found by pointer jumping. Others are read pixel by pixel.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm._arrow import id_and_text, slices, utf8

#: Payloads are filled up to a multiple of so many bytes; bits of the encoder's colour cache; texts' bytes taken at once.
UNIT, CACHE_BITS, TOGETHER = 64, 8, 1 << 18
#: Pixels from which an image gets codes of its own and transforms are tried; longest match and largest distance.
OWN, LONGEST, FARTHEST = 4096, 4096, (1 << 20) - 120
#: Rows of a tile of predictors, as a power of two.
TILE = 4
_SIDE = 1 << 14

# Fixed values of the format: order of code lengths, neighbours of short distances as (columns left, rows up).
_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
_HASH = 0x1E35A7BD


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of a canonical prefix code, their first bit lowest."""
    codes = np.zeros(len(lengths), np.uint32)
    code = 0
    for n in range(1, 16):
        for s in np.flatnonzero(lengths == n).tolist():
            codes[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
        code <<= 1
    return codes


def lookup(lengths: np.ndarray) -> np.ndarray:
    """For every 15 bits ahead: symbol * 16 + length of its code. One symbol alone takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.full(1 << 15, int(used[0]) << 4, np.int32)
    table = np.full(1 << 15, -1, np.int32)
    codes = canonical(lengths)
    for s in used.tolist():
        n = int(lengths[s])
        table[int(codes[s]) :: 1 << n] = s << 4 | n
    if (table < 0).any():
        raise ValueError("incomplete prefix code")
    return table


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data + b"\0" * 8, at, 8 * len(data)

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        out = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return out

    def symbol(self, table: np.ndarray) -> int:
        x = int(table[self.peek() & 0x7FFF])
        self.at += x & 15
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return x >> 4


def _code(bits: Bits, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.int32)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lookup(lengths)
    own = np.zeros(19, np.int32)
    for i in range(4 + bits.read(4)):
        own[_LENGTH_ORDER[i]] = bits.read(3)
    table = lookup(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left > 0:
        left -= 1
        s = bits.symbol(table)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > size:
                raise ValueError("too many code lengths")
            lengths[at : at + n] = last if s == 16 else 0
            at += n
    return lookup(lengths)


def _group(bits: Bits, cache_bits: int) -> list[np.ndarray]:
    return [_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


def _number(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """An entropy-coded image as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cell, cells, step = [], 0, 0
    groups = 1
    if main and bits.read(1):
        step = bits.read(3) + 2
        cells = (width + (1 << step) - 1) >> step
        cell = [(p >> 8) & 0xFFFF for p in _pixels(bits, cells, (height + (1 << step) - 1) >> step, False)]
        groups = max(cell) + 1
    codes = [_group(bits, cache_bits) for _ in range(groups)]
    if main and groups == 1:
        found = _walk([bits.data[:-8]], [bits.at], [(width, height)], cache_bits, codes[0])[0]
        if found is not None:
            return found.tolist()
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    done = 0
    total = width * height
    while len(out) < total:
        n = len(out)
        green, red, blue, alpha, far = codes[cell[(n // width >> step) * cells + (n % width >> step)] if cell else 0]
        s = bits.symbol(green)
        if s < 256:
            r = bits.symbol(red)
            b = bits.symbol(blue)
            out.append(bits.symbol(alpha) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length = _number(bits, s - 256)
            d = _number(bits, bits.symbol(far))
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > n or n + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(n, n + length):
                out.append(out[i - d])
        else:
            while done < n:  # what was written since is remembered only when it is asked for
                p = out[done]
                cache[(_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                done += 1
            out.append(cache[s - 280])
    return out


def _each(f, *ps: int) -> int:
    return sum((f(*((p >> k) & 255 for p in ps)) & 255) << k for k in (0, 8, 16, 24))


def _half(a: int, b: int) -> int:
    return _each(lambda x, y: (x + y) >> 1, a, b)


def _clip(x: int) -> int:
    return min(255, max(0, x))


def _select(left: int, top: int, corner: int) -> int:
    to = lambda a, b: sum(abs(((a >> k) & 255) - ((b >> k) & 255)) for k in (0, 8, 16, 24))
    return left if to(top, corner) < to(left, corner) else top


#: Predictors by number: of left, top, top right and top left.
_PREDICT = [
    lambda l, t, r, c: 0xFF000000, lambda l, t, r, c: l, lambda l, t, r, c: t, lambda l, t, r, c: r, lambda l, t, r, c: c,
    lambda l, t, r, c: _half(_half(l, r), t), lambda l, t, r, c: _half(l, c), lambda l, t, r, c: _half(l, t), lambda l, t, r, c: _half(c, t), lambda l, t, r, c: _half(t, r),
    lambda l, t, r, c: _half(_half(l, c), _half(t, r)), lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: _each(lambda x, y, z: _clip(x + y - z), l, t, c), lambda l, t, r, c: _each(lambda x, z: _clip(x + int((x - z) / 2)), _half(l, t), c),
]


def add_prediction(pixels: list[int], width: int, modes: list[int], step: int, sign: int = 1) -> list[int]:
    """Invert the predictor transform, or with sign -1 apply it."""
    cells = (width + (1 << step) - 1) >> step
    out: list[int] = []
    known = out if sign > 0 else pixels
    for i, p in enumerate(pixels):
        x, y = i % width, i // width
        if i == 0:
            guess = 0xFF000000
        elif y == 0:
            guess = known[i - 1]
        elif x == 0:
            guess = known[i - width]
        else:
            mode = modes[(y >> step) * cells + (x >> step)]
            guess = _PREDICT[mode if mode < 14 else 0](known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        out.append(_each(lambda a, b: a + sign * b, p, guess))
    return out


def add_colour(pixels: list[int], width: int, elements: list[int], step: int, sign: int = 1) -> list[int]:
    """Invert the cross-colour transform, or with sign -1 apply it."""
    cells = (width + (1 << step) - 1) >> step
    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    out = []
    for i, p in enumerate(pixels):
        e = elements[(i // width >> step) * cells + (i % width >> step)]
        g, r, b = (p >> 8) & 255, (p >> 16) & 255, p & 255
        red = (r + sign * delta(e & 255, g)) & 255
        true_red = red if sign > 0 else r
        blue = (b + sign * (delta((e >> 8) & 255, g) + delta((e >> 16) & 255, true_red))) & 255
        out.append((p & 0xFF00FF00) | red << 16 | blue)
    return out


def chunk(webp: bytes) -> bytes:
    """The lossless stream in a WebP file."""
    if webp[:4] != b"RIFF" or webp[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while at + 8 <= len(webp):
        size = struct.unpack_from("<I", webp, at + 4)[0]
        if webp[at : at + 4] == b"VP8L":
            return webp[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def decode_one(stream: bytes) -> tuple[int, int, np.ndarray]:
    """Any lossless stream: width, height, ARGB pixels."""
    bits = Bits(stream)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, x = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            step = bits.read(3) + 2
            cells = (x + (1 << step) - 1) >> step
            undo.append((kind, x, step, _pixels(bits, cells, (height + (1 << step) - 1) >> step, False)))
        elif kind == 2:
            undo.append((kind, x, 0, []))
        else:
            n = bits.read(8) + 1
            table, last = [], 0
            for p in _pixels(bits, n, 1, False):
                last = _each(lambda a, b: a + b, p, last)
                table.append(last)
            step = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, x, step, table))
            x = (x + (1 << step) - 1) >> step
    pixels = _pixels(bits, x, height, True)
    for kind, x, step, data in reversed(undo):
        if kind == 0:
            pixels = add_prediction(pixels, x, [(p >> 8) & 15 for p in data], step)
        elif kind == 1:
            pixels = add_colour(pixels, x, data, step)
        elif kind == 2:
            pixels = [(p & 0xFF00FF00) | (((p >> 16) + (p >> 8)) & 255) << 16 | (p + (p >> 8)) & 255 for p in pixels]
        else:
            packed = (x + (1 << step) - 1) >> step
            size, mask = 8 >> step, (1 << (8 >> step)) - 1
            index = [(pixels[y * packed + (i >> step)] >> 8 >> (size * (i & ((1 << step) - 1)))) & mask for y in range(height) for i in range(x)]
            pixels = [data[i] if i < len(data) else 0 for i in index]
    return width, height, np.array(pixels, np.uint32)


# The encoder's own codes.


def _huffman(weights: np.ndarray) -> np.ndarray:
    lengths = np.zeros(len(weights), np.int32)
    heap = [(float(w), i, [i]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        lengths[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    return lengths if lengths.max() <= 15 else _huffman(np.asarray(weights) + np.sum(weights) / (1 << 13))


def _weights() -> np.ndarray:
    """How often bytes are expected in text, by a rule, so that all images have one set of codes."""
    w = np.full(256, 1.0)
    w[32:127], w[48:58], w[65:91], w[97:123], w[128:192], w[0xC3] = 3, 6, 6, 50, 4, 20
    for c, x in zip(b" etaonirsh", (220, 150, 110, 100, 100, 110, 100, 90, 80, 70), strict=True):
        w[c] = x
    w[0] = 8
    return w


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code_lengths(self, lengths: np.ndarray) -> None:
        """A code in full: the lengths themselves with a code of 4 bits for 0 to 15."""
        self.put(0, 1)
        self.put(15, 4)
        for s in _LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        own = canonical(np.array([4] * 16 + [0] * 3))
        for n in lengths.tolist():
            self.put(int(own[n]), 4)

    def runs(self, lengths: np.ndarray) -> None:
        """A code with runs of zeros in short, under a fixed code for the lengths; a single symbol takes no bits."""
        used = np.flatnonzero(lengths)
        if len(used) <= 1 and (not len(used) or used[0] < 256):
            return self.one_symbol(int(used[0]) if len(used) else 0)
        self.put(0, 1)
        self.put(15, 4)
        for s in _LENGTH_ORDER:
            self.put(int(_RUN_LENGTHS[s]), 3)
        self.put(0, 1)
        at, known = 0, lengths.tolist()
        while at < len(known):
            n = 1
            while known[at] == 0 and n < 138 and at + n < len(known) and known[at + n] == 0:
                n += 1
            s, extra, more = (known[at], 0, 0) if n < 3 else (17, 3, n - 3) if n < 11 else (18, 7, n - 11)
            self.put(int(_RUN_CODES[s]), int(_RUN_LENGTHS[s]))
            self.put(more, extra)
            at += 1 if n < 3 else n

    def one_symbol(self, symbol: int) -> None:
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)


_RUN_LENGTHS = np.array([4] * 12 + [5, 5, 5, 5, 0, 4, 4])
_RUN_CODES = canonical(_RUN_LENGTHS)
_W = _weights()
GREEN = _huffman(np.concatenate([_W, np.full(24, 1.0), np.full(1 << CACHE_BITS, 1.2)]))
OTHER = _huffman(_W)
FAR = _huffman(np.full(40, 1.0))
_SHARED_LENGTHS = [GREEN, OTHER, OTHER, OTHER, FAR]
_head = Writer()
_head.put(0, 1)  # no transform
_head.put(1, 1)
_head.put(CACHE_BITS, 4)
_head.put(0, 1)  # one set of codes
for _lengths in _SHARED_LENGTHS:
    _head.code_lengths(_lengths)
HEAD_BITS = _head.n
HEAD = _head.value.to_bytes((HEAD_BITS + 7) // 8, "little")
_SHARED_CODES = [canonical(n) for n in _SHARED_LENGTHS]
_OTHER_TABLE = lookup(OTHER)
#: The tables of the shared header.
_SHARED_TABLES = [lookup(GREEN), _OTHER_TABLE, _OTHER_TABLE, _OTHER_TABLE, lookup(FAR)]
#: Further bits of lengths and distances by symbol.
_EXTRA = np.maximum(0, (np.arange(40) - 2) >> 1)


def shape(pixels: int) -> tuple[int, int]:
    """Width and height for so many pixels (a multiple of 16): 16 wide while that fits, else the last row may be filled up."""
    width = 16
    while -(-pixels // width) > _SIDE:
        width *= 2
    if width > _SIDE:
        raise ValueError("a text of more than 1 GB doesn't fit in one image")
    return width, -(-pixels // width)


def _earlier(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of key and then place, and whether each one's predecessor has the same key. Keys have so few bits
    that places fit beside them."""
    bits = np.uint64(max(1, len(key).bit_length()))
    both = np.sort(key.astype(np.uint64) << bits | np.arange(len(key), dtype=np.uint64))
    same = np.zeros(len(key), bool)
    same[1:] = both[1:] >> bits == both[:-1] >> bits
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), same


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of lengths or distances, and their further bits."""
    x = v - 1
    high = np.frexp(np.maximum(x, 1).astype(float))[1] - 1
    symbol = np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1))
    return symbol, x & ((1 << _EXTRA[symbol]) - 1)


@functools.cache
def _near(width: int) -> np.ndarray:
    """Distance codes of short distances, 0 where there is none."""
    out = np.zeros(8 + 7 * width + 1, np.int64)
    for k in range(len(_NEAR), 0, -1):
        out[max(1, _NEAR[k - 1][0] + _NEAR[k - 1][1] * width)] = k
    return out


class Tokens(NamedTuple):
    """What a stream says, in order: the first pixel, kind and symbols of each token, with further bits of references."""

    at: np.ndarray
    literal: np.ndarray
    ref: np.ndarray  # places of back-references among the tokens
    symbols: list[np.ndarray]  # first of each token; red, blue, alpha of each; distance of each back-reference
    more: np.ndarray
    more_far: np.ndarray


def _matches(argb: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How far back the last place of the same image lies where the next three pixels are the same, or 0."""
    far = np.zeros(len(argb), np.int64)
    if len(argb) < 4:
        return far
    p = argb.astype(np.uint64)
    h = p[:-2] * np.uint64(0x9E3779B97F4A7C15) + p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:] * np.uint64(0x165667B19E3779F9) + doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    order, same = _earlier(h >> np.uint64(len(h).bit_length()))
    now, last = order[1:][same[1:]], order[:-1][same[1:]]
    ok = (doc[last] == doc[now + 2]) & (now - last <= FARTHEST)
    for k in range(3):
        ok &= argb[now + k] == argb[last + k]
    far[now[ok]] = (now - last)[ok]
    return far


def _tokens(argb: np.ndarray, doc: np.ndarray, width: int, cache_bits: int) -> Tokens:
    """Tokens of images that lie one after the other: matches where they take fewer bits than pixels would, cache references
    and literals else."""
    channels = [(argb >> np.uint32(k) & np.uint32(255)).astype(np.int64) for k in (8, 16, 0, 24)]
    first = channels[0]
    hit = np.zeros(len(argb), bool)
    if cache_bits:
        slot = ((argb * np.uint32(_HASH)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        order, same = _earlier(doc << cache_bits | slot)
        hit[order[1:]] = same[1:] & (argb[order[1:]] == argb[order[:-1]])
        first = np.where(hit, 280 + slot, first)
    far = _matches(argb, doc)
    edge = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1], [True]]))
    start, stop = edge[:-1], edge[1:]
    own = far[start] > 0
    start, stop = start[own], stop[own] + 2
    d = far[start]
    start = start.copy()
    start[1:] = np.maximum(start[1:], stop[:-1])
    bits = np.where(hit, 9, sum(n[c] for n, c in zip(_SHARED_LENGTHS, channels, strict=False)))
    total = np.concatenate([[0], np.cumsum(bits)])
    near = _near(width)
    code = np.where(d < len(near), near[np.minimum(d, len(near) - 1)], 0)
    code = np.where(code > 0, code, d + 120)
    size = stop - start
    cost = 17 + _EXTRA[_prefix(np.clip(size, 1, LONGEST))[0]] + _EXTRA[_prefix(code)[0]]
    keep = (size > 0) & (total[stop] - total[start] > cost * -(-size // LONGEST))
    start, size, code = start[keep], size[keep], code[keep]
    covered = np.zeros(len(argb) + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + size, -1)
    pieces = -(-size // LONGEST)
    part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(start, pieces) + LONGEST * part
    length = np.minimum(np.repeat(size, pieces) - LONGEST * part, LONGEST)
    code = np.repeat(code, pieces)
    is_ref = np.zeros(len(argb), bool)
    is_ref[begin] = True
    at = np.flatnonzero((np.cumsum(covered)[:-1] == 0) | is_ref)
    ref = np.flatnonzero(is_ref[at])
    symbol, more = _prefix(length)
    far_symbol, more_far = _prefix(code)
    first = first[at]
    first[ref] = 256 + symbol
    literal = first < 256
    return Tokens(at, literal, ref, [first, *(c[at] for c in channels[1:]), far_symbol], more, more_far)


def _packed(tokens: Tokens, codes: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each token, and how many they are: 58 at most."""
    first = tokens.symbols[0]
    value, length = codes[0].astype(np.uint64)[first], lengths[0].astype(np.int64)[first]
    for c, code, n in zip(tokens.symbols[1:4], codes[1:4], lengths[1:4], strict=True):
        value |= np.where(tokens.literal, code.astype(np.uint64)[c] << length.astype(np.uint64), np.uint64(0))
        length += np.where(tokens.literal, n[c], 0)
    ref, far = tokens.ref, tokens.symbols[4]
    v, n = value[ref], length[ref]
    for bits, size in ((tokens.more, _EXTRA[first[ref] - 256]), (codes[4][far], lengths[4][far]), (tokens.more_far, _EXTRA[far])):
        v |= bits.astype(np.uint64) << n.astype(np.uint64)
        n = n + size
    value[ref], length[ref] = v, n
    return value, length


def _laid(value: np.ndarray, length: np.ndarray, doc: np.ndarray, docs: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in which the tokens of each image follow `lead` free bits, where each image begins and how many bits it has."""
    total = np.concatenate([[0], np.cumsum(length)])
    at = np.searchsorted(doc, np.arange(docs + 1))
    bits = total[at[1:]] - total[at[:-1]] + lead
    base = np.concatenate([[0], np.cumsum((bits + 63) // 64 + 1)])
    place = total[:-1] + (base[:-1] * 64 + lead - total[at[:-1]])[doc]
    out = np.zeros(int(base[-1]) + 1, np.uint64)
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    low = value << shift
    high = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[begin]] |= np.bitwise_or.reduceat(low, begin)
    out[word[begin] + 1] |= np.bitwise_or.reduceat(high, begin)
    return out.view(np.uint8), base[:-1] * 8, bits


def _image(out: Writer, argb: np.ndarray, width: int, cache_bits: int = 0, main: bool = False) -> None:
    """An image under codes of its own."""
    tokens = _tokens(argb, np.zeros(len(argb), np.int64), width, cache_bits)
    seen = [tokens.symbols[0], *(c[tokens.literal] for c in tokens.symbols[1:4]), tokens.symbols[4]]
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    codes, lengths = [], []
    for c, size in zip(seen, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True):
        many = np.bincount(c, minlength=size)
        used = np.flatnonzero(many)
        n = np.zeros(size, np.int64)
        n[used] = _huffman(many[used]) if len(used) > 1 else 1
        out.runs(n)
        codes.append(canonical(n))
        lengths.append(n if len(used) > 1 else np.zeros(size, np.int64))
    value, length = _packed(tokens, codes, lengths)
    raw, _, bits = _laid(value, length, np.zeros(len(value), np.int64), 1, 0)
    out.put(int.from_bytes(raw[: (int(bits[0]) + 7) // 8].tobytes(), "little"), int(bits[0]))


def _split(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green and blue as rows."""
    return np.stack([argb >> np.uint32(k) & np.uint32(255) for k in (24, 16, 8, 0)]).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[0] << np.uint32(24) | c[1] << np.uint32(16) | c[2] << np.uint32(8) | c[3]


def _guesses(known: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """What each predictor says of every pixel from the second one of the second row on, in channels."""
    n = known.shape[1]
    left, top, right, corner = (known[:, width + 1 - k : n - k] for k in (1, width, width - 1, width + 1))
    half = lambda x, y: (x + y) >> 1
    yield np.broadcast_to(np.array([[255], [0], [0], [0]], np.int32), left.shape)
    yield from (left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right)))
    yield np.where(np.abs(top - corner).sum(0) < np.abs(left - corner).sum(0), left, top)
    yield np.clip(left + top - corner, 0, 255)
    mean = half(left, top)
    away = mean - corner
    yield np.clip(mean + np.sign(away) * (np.abs(away) >> 1), 0, 255)


def _predicted(known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the predictors leave, and the predictor of each tile: the one that leaves the least."""
    n = known.shape[1]
    left = known.copy()
    left[:, 0] = known[:, 0] - np.array([255, 0, 0, 0])
    left[:, 1:width] = known[:, 1:width] - known[:, : width - 1]
    if n > width + 1:
        x, y = np.arange(width + 1, n) % width, np.arange(width + 1, n) // width
        cells = (width + (1 << TILE) - 1) >> TILE
        tile = (y >> TILE) * cells + (x >> TILE)
        tiles = int(tile.max()) + 1
        least, modes, best = np.full(tiles, np.inf), np.zeros(tiles, np.int64), np.zeros((4, n - width - 1), np.int32)
        for mode, guess in enumerate(_guesses(known, width)):
            rest = known[:, width + 1 :] - guess & 255
            cost = np.bincount(tile, np.minimum(rest, 256 - rest).sum(0), tiles)
            less = cost < least
            least[less], modes[less] = cost[less], mode
            own = less[tile]
            best[:, own] = rest[:, own]
        left[:, width + 1 :] = best
    else:
        modes = np.zeros(1, np.int64)
    edge = np.arange(width, n, width)
    left[:, edge] = known[:, edge] - known[:, edge - width]
    out = np.zeros(-(-(n // width) >> TILE) * ((width + (1 << TILE) - 1) >> TILE), np.int64)
    out[: len(modes)] = modes
    return left & 255, out


def _crossed(c: np.ndarray) -> tuple[np.ndarray, int]:
    """Channels after the cross-colour transform with one element for the image, and the element."""
    signed = (c ^ 128) - 128
    _, red, green, blue = signed

    def slope(y: np.ndarray, x: np.ndarray) -> int:
        return int(np.clip(round(32 * float((x * y).sum()) / max(1.0, float((x * x).sum()))), -128, 127))

    to_red, to_blue = slope(red, green), slope(blue, green)
    again = slope(((blue - (to_blue * green >> 5)) + 128 & 255) - 128, red)
    out = c.copy()
    out[1] -= to_red * green >> 5
    out[3] -= (to_blue * green >> 5) + (again * red >> 5)
    return out & 255, 0xFF000000 | (again & 255) << 16 | (to_blue & 255) << 8 | (to_red & 255)


def _less_green(c: np.ndarray) -> np.ndarray:
    out = c.copy()
    out[1] -= c[2]
    out[3] -= c[2]
    return out & 255


def _entropy(c: np.ndarray) -> float:
    many = np.concatenate([np.bincount(x, minlength=256) for x in c]).astype(float)
    many = many[many > 0]
    return float((many * (np.log2(c.shape[1]) - np.log2(many))).sum())


def _with_transforms(argb: np.ndarray, width: int, height: int) -> Writer | None:
    """The image after the transforms that leave the least entropy; None if that is none."""
    known = _split(argb)
    rest, modes = _predicted(known, width)
    crossed = {"c": _crossed(known), "pc": _crossed(rest)}
    choices = {"": known, "g": _less_green(known), "p": rest, "pg": _less_green(rest)} | {k: c for k, (c, _) in crossed.items()}
    head = {"p": 100 + _entropy(modes[None]), "c": 100, "g": 3}  # about what the transforms take themselves
    best = min(choices, key=lambda k: _entropy(choices[k]) + sum(head[x] for x in k))
    if not best:
        return None
    out = Writer()
    for k in best:
        out.put(1, 1)
        out.put({"p": 0, "c": 1, "g": 2}[k], 2)
        if k == "p":
            out.put(TILE - 2, 3)
            _image(out, (0xFF000000 | modes << 8).astype(np.uint32), (width + (1 << TILE) - 1) >> TILE)
        elif k == "c":
            out.put(7, 3)
            cells = ((width + 511) >> 9) * ((height + 511) >> 9)
            _image(out, np.full(cells, crossed[best][1], np.uint32), (width + 511) >> 9)
    out.put(0, 1)
    _image(out, _join(choices[best]), width, CACHE_BITS, True)
    return out


def _with_palette(argb: np.ndarray, width: int, height: int, colours: np.ndarray) -> Writer:
    n = len(colours)
    out = Writer()
    out.put(1, 1)
    out.put(3, 2)
    out.put(n - 1, 8)
    _image(out, _join(np.diff(_split(colours), prepend=0)), n)
    step = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    packed = (width + (1 << step) - 1) >> step
    index = np.zeros((height, packed << step), np.int64)
    index[:, :width] = np.searchsorted(colours, argb).reshape(height, width)
    index = (index.reshape(height, packed, 1 << step) << (8 >> step) * np.arange(1 << step)).sum(2).reshape(-1)
    out.put(0, 1)
    _image(out, (0xFF000000 | index << 8).astype(np.uint32), packed, 0, True)
    return out


def _file(width: int, height: int, body: bytes) -> bytes:
    data = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14 | 1 << 28) + body
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def _alone(argb: np.ndarray, width: int, height: int, colours: np.ndarray) -> Writer:
    """The smallest stream of one image."""
    found = []
    if len(colours) <= 256:
        found.append(_with_palette(argb, width, height, colours))
    if len(argb) >= OWN:
        plain = Writer()
        plain.put(0, 1)
        _image(plain, argb, width, CACHE_BITS, True)
        found += [x for x in (plain, _with_transforms(argb, width, height)) if x]
    return min(found, key=lambda x: x.n)


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """WebP files of payloads (each a multiple of UNIT bytes)."""
    sizes = [shape(len(p) // 4) for p in payloads]
    files: list = [None] * len(payloads)
    images = []
    for p, (w, h) in zip(payloads, sizes, strict=True):
        flat = np.zeros(4 * w * h, np.uint8)
        flat[: len(p)] = p
        r, g, b, a = (flat[k::4].astype(np.uint32) for k in range(4))
        images.append(a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b)
    alone = {}
    for i, argb in enumerate(images):
        colours = np.unique(argb)
        if len(argb) >= OWN or (len(colours) <= 256 and 4 * len(colours) <= len(argb)):
            alone[i] = _alone(argb, *sizes[i], colours)
    rest = [i for i, argb in enumerate(images) if len(argb) < OWN]
    if rest:
        n = np.array([len(images[i]) for i in rest])
        doc = np.repeat(np.arange(len(rest)), n)
        tokens = _tokens(np.concatenate([images[i] for i in rest]), doc, shape(16)[0], CACHE_BITS)
        value, length = _packed(tokens, _SHARED_CODES, _SHARED_LENGTHS)
        raw, start, bits = _laid(value, length, doc[tokens.at], len(rest), HEAD_BITS)
        head = np.frombuffer(HEAD, np.uint8)
        for i, a, many in zip(rest, start.tolist(), bits.tolist(), strict=True):
            if i not in alone or alone[i].n > many:
                raw[a : a + len(head)] |= head
                files[i] = _file(*sizes[i], raw[a : a + (many + 7) // 8].tobytes())
    for i, out in alone.items():
        if files[i] is None:
            files[i] = _file(*sizes[i], out.value.to_bytes((out.n + 7) // 8, "little"))
    return files


def _is_shared(stream: bytes) -> bool:
    whole, rest = HEAD_BITS >> 3, (1 << (HEAD_BITS & 7)) - 1
    return stream[0] == 0x2F and stream[5 : 5 + whole] == HEAD[:whole] and (not rest or stream[5 + whole] & rest == HEAD[whole] & rest)


def decode(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """Width, height and ARGB pixels of each file; those with the shared header are decoded together."""
    streams = [chunk(f) for f in files]
    out: list = [None] * len(files)
    together = [i for i, s in enumerate(streams) if _is_shared(s)]
    if together:
        packed = [struct.unpack_from("<I", streams[i], 1)[0] for i in together]
        sizes = [((p & 0x3FFF) + 1, (p >> 14 & 0x3FFF) + 1) for p in packed]
        found = _walk([streams[i] for i in together], [40 + HEAD_BITS] * len(together), sizes, CACHE_BITS, _SHARED_TABLES)
        for i, (w, h), argb in zip(together, sizes, found, strict=True):
            out[i] = None if argb is None else (w, h, argb)
    for i, s in enumerate(streams):
        if out[i] is None:
            out[i] = decode_one(s)
    return out


def _roots(source: np.ndarray) -> np.ndarray:
    """The place at the end of each chain of places."""
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return source
        source = further


def _walk(streams: list[bytes], first: list[int], sizes: list[tuple[int, int]], cache_bits: int, tables: list[np.ndarray]) -> list[np.ndarray | None]:
    """ARGB pixels of each stream, whose symbols begin at bit `first` and follow the given tables; None for a broken stream."""
    green, *rest, far = tables
    raw = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    wide = raw.astype(np.uint32)
    ahead = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    peek = ((ahead[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0x7FFF)).reshape(-1).astype(np.uint16)
    ahead = ahead[:-1] | wide[3:] << np.uint32(24)
    own = {id(t): t[peek] for t in rest}
    ahead_of = {k: t & 15 for k, t in own.items()}
    g = green[peek]
    last = np.int32(len(peek) - 1)
    end = np.minimum(np.arange(len(peek), dtype=np.int32) + (g & 15), last)
    long = end
    for t in rest:
        long = np.minimum(long + ahead_of[id(t)][long], last)
    kind = g >> 4
    after = np.where(kind < 256, long, end)
    some = np.flatnonzero((kind >= 256) & (kind < 280))
    q = np.minimum(end[some] + _EXTRA[kind[some] - 256], last)
    f = far[peek[q]]
    after[some] = np.minimum(q + (f & 15) + _EXTRA[f >> 4], last)
    follow = memoryview(np.ascontiguousarray(after, np.int32))
    places: list[int] = []
    many, at, stops = [], 0, []
    for s, begin, (w, h) in zip(streams, first, sizes, strict=True):
        b, stop, mine = at * 8 + begin, (at + len(s)) * 8, []
        add = mine.append
        for _ in range(w * h):
            if b >= stop:
                break
            add(b)
            b = follow[b]
        places += mine
        many.append(len(mine))
        stops.append(stop)
        at += len(s)
    p = np.array(places, np.int64)
    doc = np.repeat(np.arange(len(streams)), many)
    width, total = (np.array([x[0] for x in sizes]), np.array([x[0] * x[1] for x in sizes]))
    k = kind[p].astype(np.int64)
    ref = np.flatnonzero((k >= 256) & (k < 280))

    def number(symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        more = ahead[np.minimum(place >> 3, len(ahead) - 1)].astype(np.int64) >> (place & 7) & ((1 << _EXTRA[symbol]) - 1)
        return np.where(symbol < 4, symbol, (2 + (symbol & 1)) << _EXTRA[symbol]) + more + 1

    length = np.ones(len(p), np.int64)
    length[ref] = number(k[ref] - 256, end[p[ref]].astype(np.int64))
    q = np.minimum(end[p[ref]] + _EXTRA[k[ref] - 256], last)
    f = far[peek[q]].astype(np.int64)
    code = number(f >> 4, np.minimum(q + (f & 15), last).astype(np.int64))
    x, y = np.array(_NEAR, np.int64)[np.minimum(code, 120) - 1].T
    d = np.zeros(len(p), np.int64)
    d[ref] = np.where(code > 120, code - 120, np.maximum(1, x + y * width[doc[ref]]))
    before = np.cumsum(length) - length
    begins = np.searchsorted(doc, np.arange(len(streams)))
    if len(p):
        before -= before[np.minimum(begins, len(p) - 1)][doc]
    used = before < total[doc]
    good = np.bincount(doc[used], length[used], len(streams)) == total
    good[doc[used & ((d > before) | (after[p] > np.array(stops)[doc]))]] = False
    used &= good[doc]
    p, doc, k, length, d, before = (v[used] for v in (p, doc, k, length, d, before))
    base = np.cumsum(np.where(good, total, 0)) - np.where(good, total, 0)
    place = base[doc] + before
    n = int(total[good].sum())
    argb, source = np.zeros(n, np.uint32), np.arange(n)
    lit = np.flatnonzero(k < 256)
    q, value = end[p[lit]], (k[lit] << 8).astype(np.uint32)
    for t, shift in zip(rest, (16, 0, 24), strict=True):
        value |= (own[id(t)][q] >> 4).astype(np.uint32) << np.uint32(shift)
        q = np.minimum(q + ahead_of[id(t)][q], last)
    argb[place[lit]] = value
    ref = np.flatnonzero(d)
    inside = np.arange(int(length[ref].sum())) - np.repeat(np.cumsum(length[ref]) - length[ref], length[ref])
    copied = np.repeat(place[ref], length[ref]) + inside
    source[copied] = copied - np.repeat(d[ref], length[ref])
    cached = np.flatnonzero(k >= 280)
    if len(cached):
        asked = np.full(n, -1)
        asked[place[cached]] = k[cached] - 280
        root = _roots(source)
        slot = np.where(asked[root] >= 0, asked[root], (argb[root] * np.uint32(_HASH)) >> np.uint32(32 - cache_bits))
        order, same = _earlier(np.repeat(np.arange(len(streams)), np.where(good, total, 0)) << cache_bits | slot)
        from_ = np.maximum.accumulate(np.where((asked[order] < 0) | ~same, np.arange(n), 0))
        source = np.where(asked >= 0, 0, source)
        here = asked[order] >= 0  # takes what the slot's last other pixel was; black without alpha if nothing was remembered
        source[order[here]] = order[from_[here]]
    argb = argb[_roots(source)]
    return [argb[a : a + int(t)] if ok else None for a, t, ok in zip(base.tolist(), total, good.tolist(), strict=True)]


def samples(argb: np.ndarray) -> np.ndarray:
    """Pixel array as samples R, G, B, A."""
    out = np.empty((len(argb), 4), np.uint8)
    for k, shift in enumerate((16, 8, 0, 24)):
        out[:, k] = (argb >> np.uint32(shift)) & np.uint32(255)
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, media (a WebP file). A null text is empty; an empty one is stored as UNIT zero bytes.

    Rows are stored one by one, so repeated rows stay, and equal texts give equal files. Other columns are left out.
    """
    source = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=TOGETHER):
            data, off = utf8(batch.column("text"))
            payloads = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                p = np.zeros(max(UNIT, -(-(b - a) // UNIT) * UNIT), np.uint8)
                p[: b - a] = data[a:b]
                payloads.append(p)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(off)), pa.array(encode(payloads), pa.binary())], [id_col, "n_bytes", "media"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def load(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns, and width, height and pixels (binary: samples R, G, B, A by row), which take the place of columns with
    these names. A null file gives nulls."""
    media = media.drop("width", "height", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media_col, TOGETHER):
            files = batch.column(media_col).to_pylist()
            found = iter(decode([f for f in files if f is not None]))
            rows = [None if f is None else next(found) for f in files]
            cols = [pa.array([x and x[0] for x in rows], pa.int32()), pa.array([x and x[1] for x in rows], pa.int32()), pa.array([x and samples(x[2]).tobytes() for x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "width", "height", "pixels"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{fields}, width int, height int, pixels binary")


def features(loaded: DataFrame, length_col: str) -> DataFrame:
    """All columns, and of the first length_col bytes of pixels: payload_sha256, tail_crc32 and the means of the four
    samples, which take the place of columns with these names."""
    loaded = loaded.drop("payload_sha256", "tail_crc32", "means")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, crc, means = [], [], []
            for pixels, n in zip(batch.column("pixels").to_pylist(), batch.column(length_col).to_pylist(), strict=True):
                payload = pixels[:n]
                sha.append(hashlib.sha256(payload).hexdigest())
                crc.append(zlib.crc32(payload[-UNIT:]))
                mean = np.frombuffer(payload, np.uint8).reshape(-1, 4).mean(0)
                means.append(",".join(f"{x:.3f}" for x in mean))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(means, pa.string())], [*batch.schema.names, "payload_sha256", "tail_crc32", "means"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in loaded.schema)
    return loaded.mapInArrow(run, f"{fields}, payload_sha256 string, tail_crc32 long, means string")


def op4_webp(spark, sf_dir: str) -> DataFrame:
    stored = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    loaded = load(stored).withColumn("payload_bytes", F.greatest(F.lit(UNIT), F.ceil(F.col("n_bytes") / UNIT) * UNIT).cast("long"))
    made = loaded.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}).drop("media")
    feature = F.concat_ws(":", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")), "means")
    return features(made, "payload_bytes").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
