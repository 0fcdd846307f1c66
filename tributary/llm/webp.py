"""Lossless WebP media columns (operator 10).

``decode`` reads any lossless WebP (VP8L) image: prefix codes in groups, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms with pixel bundling.  ``encode`` writes images with any of these.

A payload (text bytes, padded to a multiple of 64) is stored as the samples of gray images 64 pixels wide, up to ``TILE`` bytes an
image: one image file, or the frames of an animation if there are several.  The images are written and read by vector operations:
prefix codes and back-references of many images in lockstep, palettes, predictors and green as whole arrays.  Images
with a colour cache, cross-colour or other predictors, which ``store`` never finds worth while, go through ``decode``.

Media are written as a table in the shared folder and read back before features are computed.  The plan has no shuffle.

Edge cases: a null or empty text is 64 zero bytes with n_bytes 0; null ids stay null; repeated rows give a row each; texts may
be of any length; damaged media raise ValueError; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_and_text, release, slices, utf8, written

WIDTH, TILE = 64, 8192
#: Fixed values of the format: the order in which code length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES = 24, 40
#: Distance codes of near pixels, in order of distance, then of columns, left ones after right ones.
NEAR = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# --- bits and prefix codes ------------------------------------------------------------------------------------------------


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.have = data, 0, 0, 0

    def peek(self, n: int) -> int:
        if self.have < n:
            more = self.data[self.at : self.at + 64]
            self.word |= int.from_bytes(more, "little") << self.have
            self.at += len(more)
            self.have += 8 * len(more)
        return self.word & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if n > self.have:
            raise ValueError("the image ends early")
        self.word >>= n
        self.have -= n

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.skip(n)
        return x


class BitWriter:
    def __init__(self) -> None:
        self.word, self.size = 0, 0
        self.done: list[bytes] = []

    def put(self, value: int, n: int) -> None:
        self.word |= value << self.size
        self.size += n
        if self.size >= 4096:
            whole = self.size // 8
            self.done.append((self.word & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.word >>= 8 * whole
            self.size -= 8 * whole

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.word.to_bytes(-(-self.size // 8), "little")


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Huffman code lengths of at most ``limit`` bits; counts are halved until they fit.  A single symbol has length 1."""
    used = sorted((n, s) for s, n in enumerate(counts) if n)
    out = [0] * len(counts)
    m = len(used)
    if m < 2:
        for _, s in used:
            out[s] = 1
        return out
    weight = [n for n, _ in used]
    while True:
        # The two lightest of leaves and inner nodes, both of which come in order of weight.
        w, parent, leaf, inner = weight + [0] * (m - 1), [0] * (2 * m - 1), 0, m
        for k in range(m, 2 * m - 1):
            total = 0
            for _ in (0, 1):
                if leaf < m and (inner >= k or w[leaf] <= w[inner]):
                    at, leaf = leaf, leaf + 1
                else:
                    at, inner = inner, inner + 1
                total += w[at]
                parent[at] = k
            w[k] = total
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:m]) <= limit:
            for (_, s), n in zip(used, depth, strict=False):
                out[s] = n
            return out
        weight = [n + 1 >> 1 for n in weight]


_MIRRORED = [int(format(i, "015b")[::-1], 2) for i in range(1 << 15)]


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code with its first bit lowest, length)."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[s] = (_MIRRORED[code] >> 15 - n, n)
        code += 1
    return out


class Prefix:
    """A prefix code to decode with; a code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        if not used:
            self.only = 0
        if self.only is None and sum(1 << 15 - n for n, _ in used) != 1 << 15:
            raise ValueError("not a complete prefix code")
        self.table = {(n, code): s for s, (code, n) in canonical(lengths).items()}
        self.sizes = sorted({n for n, _ in used})

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        word = bits.peek(15)
        for n in self.sizes:
            s = self.table.get((n, word & ((1 << n) - 1)))
            if s is not None:
                bits.skip(n)
                return s
        raise ValueError("no such code")


def read_lengths(bits: BitReader, size: int) -> list[int]:
    out = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise ValueError("a symbol outside the alphabet")
            out[s] = 1
        return out
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    most = size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        if most > size:
            raise ValueError("too many code lengths")
    code, at, before = Prefix(first), 0, 8
    table = [(code.only, 0)] * 128
    for (n, word), s in code.table.items() if code.only is None else ():
        table[word :: 1 << n] = [(s, n)] * (128 >> n)
    while at < size and most:
        most -= 1
        word = bits.peek(14)
        s, n = table[word & 127]
        if s < 16:
            bits.skip(n)
            out[at] = s
            at += 1
            before = s or before
            continue
        wide = (2, 3, 7)[s - 16]
        bits.skip(n + wide)
        run = (word >> n & (1 << wide) - 1) + (11 if s == 18 else 3)
        if at + run > size:
            raise ValueError("code lengths run over")
        if s == 16:
            out[at : at + run] = [before] * run
        at += run
    return out


def put_lengths(bits: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        bits.put(1, 1)
        bits.put(len(used) - 1, 1)
        bits.put(1, 1)
        for s in used:
            bits.put(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, bits of it
    for n, same in groupby(lengths):
        run = len(list(same))
        if n:
            tokens.append((n, 0, 0))
            run -= 1
            while run >= 3:
                k = min(6, run)
                tokens.append((16, k - 3, 2))
                run -= k
        while not n and run >= 3:
            k = min(138, run)
            tokens.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
            run -= k
        tokens += [(n, 0, 0)] * run
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    first = code_lengths(counts, 7)
    last = max(i for i in range(19) if first[LENGTH_ORDER[i]])
    bits.put(0, 1)
    bits.put(max(0, last - 3), 4)
    for i in range(max(4, last + 1)):
        bits.put(first[LENGTH_ORDER[i]], 3)
    bits.put(0, 1)
    codes = canonical(first)
    one = sum(map(bool, first)) == 1
    for s, extra, n in tokens:
        if not one:
            bits.put(*codes[s])
        if n:
            bits.put(extra, n)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number for a length or distance (from 1)."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def value_of(symbol: int, bits: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + bits.read(extra) + 1


# --- images ---------------------------------------------------------------------------------------------------------------

ALPHABET = (256 + LENGTHS, 256, 256, 256, DISTANCES)


def _cache_slot(argb: int, cache_bits: int) -> int:
    return (0x1E35A7BD * argb & 0xFFFFFFFF) >> 32 - cache_bits


def _read_image(bits: BitReader, width: int, height: int, main: bool) -> list[int]:
    """Entropy-coded pixels (ARGB)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, which = 0, None
    if main and bits.read(1):
        block = 2 + bits.read(3)
        across = (width + (1 << block) - 1) >> block
        which = [p >> 8 & 0xFFFF for p in _read_image(bits, across, (height + (1 << block) - 1) >> block, False)]
    cached = 1 << cache_bits if cache_bits else 0
    groups = [[Prefix(read_lengths(bits, n + (cached if i == 0 else 0))) for i, n in enumerate(ALPHABET)] for _ in range(max(which, default=0) + 1 if which else 1)]
    out: list[int] = []
    cache, noted, total = [0] * cached, 0, width * height
    while len(out) < total:
        at = len(out)
        group = groups[which[(at // width >> block) * across + (at % width >> block)]] if which else groups[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 256 + LENGTHS:
            n = value_of(s - 256, bits)
            d = value_of(group[4].read(bits), bits)
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            while noted < len(out):
                cache[_cache_slot(out[noted], cache_bits)] = out[noted]
                noted += 1
            out.append(cache[s - 256 - LENGTHS])
    return out


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    a, r, g, b = c
    return (a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255


def _average(a: int, b: int) -> int:
    return _join([x + y >> 1 for x, y in zip(_split(a), _split(b), strict=True)])


def _clamp(x: int) -> int:
    return min(255, max(0, x))


def _predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predictor's value from the left, top, top-right and top-left pixels."""
    if mode == 11:
        sides = zip(_split(left), _split(top), _split(corner), strict=True)
        to_left = to_top = 0
        for x, y, z in sides:
            to_left += abs(y - z)
            to_top += abs(x - z)
        return left if to_left < to_top else top
    if mode == 12:
        return _join([_clamp(x + y - z) for x, y, z in zip(_split(left), _split(top), _split(corner), strict=True)])
    if mode == 13:
        mean = _split(_average(left, top))
        return _join([_clamp(m + int((m - z) / 2)) for m, z in zip(mean, _split(corner), strict=True)])
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    pair = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}.get(mode)
    if pair:
        return _average(*pair)
    return {1: left, 2: top, 3: right, 4: corner}.get(mode, 0xFF000000)


def _predict(pixels: list[int], width: int, modes: list[int], block: int, inverse: bool) -> list[int]:
    """Add the predictions to the residuals (inverse), or take them from the pixels."""
    across = (width + (1 << block) - 1) >> block
    out = [0] * len(pixels)
    known = out if inverse else pixels
    sign = 1 if inverse else -1
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        if y == 0:
            guess = known[i - 1] if x else 0xFF000000
        elif x == 0:
            guess = known[i - width]
        else:
            mode = modes[(y >> block) * across + (x >> block)] >> 8 & 15
            guess = _predicted(mode, known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        out[i] = _join([u + sign * v for u, v in zip(_split(p), _split(guess), strict=True)])
    return out


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def _cross(pixels: list[int], width: int, elements: list[int], block: int, inverse: bool) -> list[int]:
    across = (width + (1 << block) - 1) >> block
    out = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        _, red_blue, green_blue, green_red = map(_signed, _split(elements[(y >> block) * across + (x >> block)]))
        a, r, g, b = _split(p)
        toward_red = green_red * _signed(g) >> 5
        if inverse:
            r = r + toward_red & 255
            b += (green_blue * _signed(g) >> 5) + (red_blue * _signed(r) >> 5)
        else:
            b -= (green_blue * _signed(g) >> 5) + (red_blue * _signed(r) >> 5)
            r -= toward_red
        out.append(_join((a, r, g, b)))
    return out


def _bundle(colours: int) -> int:
    """Bits that say how many indices share a pixel: 3 (eight of them) for 2 colours, 2 for 4, 1 for 16, else none."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def chunk_of(data: bytes) -> tuple[bytes, int]:
    """The VP8L chunk of the image file that data begins with, and the file's size."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    end, at = 8 + struct.unpack_from("<I", data, 4)[0], 12
    if end > len(data):
        raise ValueError("the file ends early")
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size], end
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height x width x 4 bytes: red, green, blue, alpha) of a lossless WebP file."""
    chunk, _ = chunk_of(data)
    bits = BitReader(chunk)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    steps, wide, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = 2 + bits.read(3)
            part = _read_image(bits, (wide + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            steps.append((kind, wide, part, block))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _read_image(bits, n, 1, False)
            for i in range(1, n):
                table[i] = _join([a + b for a, b in zip(_split(table[i]), _split(table[i - 1]), strict=True)])
            steps.append((kind, wide, table, _bundle(n)))
            wide = (wide + (1 << _bundle(n)) - 1) >> _bundle(n)
        else:
            steps.append((kind, wide, [], 0))
    pixels = _read_image(bits, wide, height, True)
    for kind, wide, part, block in reversed(steps):
        if kind == PREDICTOR:
            pixels = _predict(pixels, wide, part, block, True)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, wide, part, block, True)
        elif kind == SUBTRACT_GREEN:
            pixels = [_join((a, r + g, g, b + g)) for a, r, g, b in map(_split, pixels)]
        else:
            across, each = (wide + (1 << block) - 1) >> block, 8 >> block
            index = ((pixels[y * across + (x >> block)] >> 8) >> each * (x & (1 << block) - 1) & (1 << each) - 1 for y in range(height) for x in range(wide))
            pixels = [part[i] if i < len(part) else 0 for i in index]
    out = np.array(pixels, "<u4").reshape(height, width)
    return np.stack([out >> 16 & 255, out >> 8 & 255, out & 255, out >> 24], axis=2).astype(np.uint8)


def _file(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _put_image(bits: BitWriter, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    bits.put(1, 1) if cache_bits else bits.put(0, 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if main:
        bits.put(0, 1)
    near = {dx + dy * width: k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR))) if dx + dy * width >= 1}
    symbols: list[tuple] = []
    cache, last, at = {}, {}, 0
    while at < len(pixels):
        n, p = 1, pixels[at]
        key = tuple(pixels[at : at + 3])
        found = last.get(key) if references else None
        if found is not None:
            n = 0
            while at + n < len(pixels) and n < 4096 and pixels[found + n] == pixels[at + n]:
                n += 1
            d = at - found
            symbols.append(("copy", prefix_of(n), prefix_of(near.get(d, d + len(NEAR)))))
        elif cache_bits and cache.get(_cache_slot(p, cache_bits)) == p:
            symbols.append(("cached", 256 + LENGTHS + _cache_slot(p, cache_bits)))
        else:
            symbols.append(("pixel", p))
        for i in range(at, at + n):
            last[tuple(pixels[i : i + 3])] = i
            if cache_bits:
                cache[_cache_slot(pixels[i], cache_bits)] = pixels[i]
        at += n
    counts = [[0] * (n + (1 << cache_bits if cache_bits and i == 0 else 0)) for i, n in enumerate(ALPHABET)]
    parts: list[list[tuple[int, int, int, int]]] = []  # channel, symbol, extra, bits
    for s in symbols:
        if s[0] == "copy":
            parts.append([(0, 256 + s[1][0], *s[1][1:]), (4, *s[2])])
        elif s[0] == "cached":
            parts.append([(0, s[1], 0, 0)])
        else:
            a, r, g, b = _split(s[1])
            parts.append([(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)])
    for part in parts:
        for channel, symbol, _, _ in part:
            counts[channel][symbol] += 1
    codes = []
    for c in counts:
        lengths = code_lengths(c, 15)
        put_lengths(bits, lengths)
        codes.append(canonical(lengths) if sum(map(bool, lengths)) > 1 else {})
    for part in parts:
        for channel, symbol, extra, n in part:
            if codes[channel]:
                bits.put(*codes[channel][symbol])
            if n:
                bits.put(extra, n)


def encode(image: np.ndarray, transforms: tuple[int, ...] = (), *, cache_bits: int = 0, references: bool = False, block: int = 4, mode=lambda x, y: (x + y) % 14, element: int = 0x00F3051B) -> bytes:
    """A lossless WebP file of pixels (height x width x 4 bytes: red, green, blue, alpha) with these transforms, in this order."""
    height, width = image.shape[:2]
    bits = BitWriter()
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(1, 1)
    bits.put(0, 3)
    pixels = [_join((a, r, g, b)) for r, g, b, a in image.reshape(-1, 4).tolist()]
    wide = width
    for kind in transforms:
        bits.put(1, 1)
        bits.put(kind, 2)
        across, down = (wide + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
        if kind == PREDICTOR:
            modes = [0xFF000000 | mode(x, y) << 8 for y in range(down) for x in range(across)]
            bits.put(block - 2, 3)
            _put_image(bits, modes, across, False)
            pixels = _predict(pixels, wide, modes, block, False)
        elif kind == CROSS_COLOUR:
            elements = [0xFF000000 | element] * (across * down)
            bits.put(block - 2, 3)
            _put_image(bits, elements, across, False)
            pixels = _cross(pixels, wide, elements, block, False)
        elif kind == SUBTRACT_GREEN:
            pixels = [_join((a, r - g, g, b - g)) for a, r, g, b in map(_split, pixels)]
        else:
            table = sorted(set(pixels))
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            bits.put(len(table) - 1, 8)
            deltas = [_join([a - b for a, b in zip(_split(c), _split(d), strict=True)]) for c, d in zip(table, [0, *table[:-1]], strict=True)]
            _put_image(bits, deltas, len(table), False)
            place, share = {c: i for i, c in enumerate(table)}, _bundle(len(table))
            each, packed = 8 >> share, (wide + (1 << share) - 1) >> share
            rows = []
            for y in range(height):
                row = [0] * packed
                for x in range(wide):
                    row[x >> share] |= place[pixels[y * wide + x]] << each * (x & (1 << share) - 1)
                rows += [0xFF000000 | v << 8 for v in row]
            pixels, wide = rows, packed
    bits.put(0, 1)
    _put_image(bits, pixels, wide, True, cache_bits, references)
    return _file(bits.bytes())


# --- payloads, a batch at a time ------------------------------------------------------------------------------------------
#
# A tile is a gray image.  How it is written is decided tile by tile: as a palette image with several indices a pixel if it has few
# values; predicted from the pixel above or to the left if that is estimated to save bytes; else with green subtracted alone, which
# leaves nothing of red and blue.  Back-references are taken from word to word.

#: Bits that one look-up sees, and the longest codes of green and of distances.
DEPTH, LONGEST, FAR = 12, 11, 10
GREEN = ALPHABET[0]
PLAIN, PALETTED, FROM_LEFT, FROM_TOP = range(4)
#: The least back-reference, and the bytes that find it.
SHORTEST, SEEN = 12, 8
_REVERSED = np.array([int(format(i, f"0{DEPTH}b")[::-1], 2) for i in range(1 << DEPTH)])
_PLACES = np.arange(1 << DEPTH)
_REVERSED_FAR = np.array([int(format(i, f"0{FAR}b")[::-1], 2) for i in range(1 << FAR)])
_BASE = np.array([s + 1 if s < 4 else (2 + (s & 1) << (s - 2 >> 1)) + 1 for s in range(DISTANCES)])
_EXTRA = np.array([max(0, s - 2 >> 1) for s in range(DISTANCES)])


def _near(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distance of each near code (from 1), and the code of each distance that has one (0 for others)."""
    far = np.array([0, *(max(1, dx + dy * width) for dx, dy in NEAR)])
    code = np.zeros(int(far.max()) + 1, np.int64)
    code[far[:0:-1]] = np.arange(len(NEAR), 0, -1)
    return far, code


_NEAR_FAR, _NEAR_CODE = _near(WIDTH)


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)).astype(np.uint64)


def _copies(data: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references that don't overlap, in order: place, length, distance.  They begin at words whose eight first bytes the tile has
    had before, and go on over the words that follow at the same distance."""
    start = data == 0x20
    start[1:] = start[:-1] & ~start[1:] | (np.diff(owner) > 0)
    start[:1] = True
    at = np.flatnonzero(start)
    at = at[at + SEEN <= ends[owner[at]]]
    none = np.zeros(0, np.int64)
    if len(at) < 2:
        return none, none, none
    window = _windows(data)
    order = np.lexsort((window[at], owner[at]))
    same = (window[at[order[1:]]] == window[at[order[:-1]]]) & (owner[at[order[1:]]] == owner[at[order[:-1]]])
    before = np.full(len(at), -1)
    before[order[1:][same]] = at[order[:-1][same]]
    hit = np.flatnonzero(before >= 0)
    if not len(hit):
        return none, none, none
    place, far = at[hit], at[hit] - before[hit]
    # A run of words at one distance: the next word begins within the eight bytes, or within sixteen that are the same.
    gap = np.diff(place)
    second = np.minimum(place[:-1] + SEEN, len(data) - 1)
    on = (np.diff(far) == 0) & (owner[place[1:]] == owner[place[:-1]]) & ((gap <= SEEN) | (gap <= 2 * SEEN) & (window[second] == window[second - far[:-1]]))
    first = np.flatnonzero(np.concatenate([[True], ~on]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    begin, end, far = place[first], place[last] + SEEN, far[first]
    end[:-1] = np.minimum(end[:-1], begin[1:])
    keep = end - begin >= SHORTEST
    begin, end, far = begin[keep], end[keep], far[keep]
    parts = -(-(end - begin) // 4096)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    place = np.repeat(begin, parts) + 4096 * nth
    return place, np.minimum(4096, np.repeat(end, parts) - place), np.repeat(far, parts)


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """prefix_of for each value."""
    v = value - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    bits = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), np.where(v < 4, 0, v & (1 << np.maximum(high - 1, 0)) - 1), bits


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that an ideal code of each row's own counts takes."""
    n = counts.sum(1, keepdims=True)
    return (counts * np.log2(np.maximum(n, 1) / np.maximum(counts, 1))).sum(1)


def _streams(tiles: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """What is written of each tile: kinds, all bytes, their numbers, and the palettes."""
    data = np.frombuffer(b"".join(tiles), np.uint8)
    size = np.fromiter(map(len, tiles), np.int64, len(tiles))
    owner, base = np.repeat(np.arange(len(tiles)), size), np.cumsum(size) - size
    count = lambda x: np.bincount(owner << 8 | x, minlength=256 * len(tiles)).reshape(-1, 256)
    plain = count(data)
    inside = np.arange(len(data)) - base[owner]
    left = data - np.where(inside % WIDTH > 0, np.roll(data, 1), np.where(inside >= WIDTH, np.roll(data, WIDTH), 0)).astype(np.uint8)
    top = data - np.where(inside >= WIDTH, np.roll(data, WIDTH), np.where(inside > 0, np.roll(data, 1), 0)).astype(np.uint8)
    guess = np.stack([_entropy(plain) * 0.8, _entropy(count(left)) + 60, _entropy(count(top)) + 60])
    kind = np.where((plain > 0).sum(1) <= 16, PALETTED, np.array([PLAIN, FROM_LEFT, FROM_TOP])[guess.argmin(0)])
    out, palettes = np.where((kind == FROM_LEFT)[owner], left, np.where((kind == FROM_TOP)[owner], top, data)), []
    if not (kind == PALETTED).any():
        return kind, out, size, palettes
    parts, sizes = [], size.copy()
    for i, k in enumerate(kind.tolist()):
        part = out[base[i] : base[i] + size[i]]
        if k == PALETTED:
            table = np.flatnonzero(plain[i])
            palettes.append(table.tolist())
            share = _bundle(len(table))
            index = np.searchsorted(table, part).reshape(-1, 1 << share)
            part = (index << (8 >> share) * np.arange(1 << share)).sum(1).astype(np.uint8)
            sizes[i] = len(part)
        parts.append(part)
    return kind, np.concatenate(parts), sizes, palettes


def _head(bytes_here: int, kind: int, palette: list[int], lengths: list[int], far: list[int]) -> tuple[int, int]:
    """The bits before the samples, as a number, and how many."""
    bits = BitWriter()
    put = lambda *pairs: [bits.put(value, n) for value, n in pairs]
    put((0x2F, 8), (WIDTH - 1, 14), (bytes_here // WIDTH - 1, 14), (0, 1), (0, 3))
    if kind == PALETTED:
        put((1, 1), (PALETTE, 2), (len(palette) - 1, 8))
        steps = [b - a for a, b in zip([0, *palette[:-1]], palette, strict=True)]
        _put_image(bits, [_join((0 if i else 255, x, x, x)) for i, x in enumerate(steps)], len(palette), False)
    elif kind in (FROM_LEFT, FROM_TOP):
        put((1, 1), (PREDICTOR, 2), (7, 3))
        _put_image(bits, [0xFF000000 | (1 if kind == FROM_LEFT else 2) << 8], 1, False)
    if kind != PALETTED:
        put((1, 1), (SUBTRACT_GREEN, 2))
    put((0, 1), (0, 1), (0, 1))
    put_lengths(bits, lengths)
    for only in (0, 0, 0 if kind in (FROM_LEFT, FROM_TOP) else 255):
        put((1, 1), (0, 1), (1, 1), (only, 8))
    put_lengths(bits, far)
    return int.from_bytes(bits.bytes(), "little"), 8 * sum(map(len, bits.done)) + bits.size


def _books(counts: np.ndarray, limit: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """For each row of counts its code lengths, and tables of codes and their bits (none for a single symbol)."""
    every, code, bits = [], np.zeros(counts.shape, np.uint64), np.zeros(counts.shape, np.int64)
    for i, row in enumerate(counts.tolist()):
        lengths = code_lengths(row, limit)
        every.append(lengths)
        book = canonical(lengths)
        if len(book) > 1:
            at = list(book)
            code[i, at], bits[i, at] = [c for c, _ in book.values()], [k for _, k in book.values()]
    return every, code, bits


def store(payloads: list[bytes]) -> list[bytes]:
    """The media of payloads whose lengths are positive multiples of 64."""
    tiles = [p[i : i + TILE] for p in payloads for i in range(0, len(p), TILE)]
    if not tiles:
        return []
    kind, data, size, palettes = _streams(tiles)
    owner, ends = np.repeat(np.arange(len(tiles)), size), np.cumsum(size)
    place, length, far = _copies(data, owner, np.where(kind == PALETTED, 0, ends))
    # Items in order: single samples, and copies where they begin.
    covered = np.zeros(len(data) + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + length, -1)
    single = np.cumsum(covered[:-1]) == 0
    single[place] = True
    at = np.flatnonzero(single)
    where, nth = owner[at], np.searchsorted(at, place)
    symbol = data[at].astype(np.int64)
    near = _NEAR_CODE[np.minimum(far, len(_NEAR_CODE) - 1)] * (far < len(_NEAR_CODE))
    (sym, extra, n_extra), (far_sym, far_extra, far_n) = _prefixes(length), _prefixes(np.where(near > 0, near, far + len(NEAR)))
    symbol[nth] = 256 + sym
    lengths, code, bits = _books(np.bincount(where * GREEN + symbol, minlength=GREEN * len(tiles)).reshape(-1, GREEN), LONGEST)
    far_lengths, far_code, far_bits = _books(np.bincount(where[nth] * DISTANCES + far_sym, minlength=DISTANCES * len(tiles)).reshape(-1, DISTANCES), FAR)
    value, n = code[where, symbol], bits[where, symbol]
    mine = where[nth]
    for part, k in ((extra.astype(np.uint64), n_extra), (far_code[mine, far_sym], far_bits[mine, far_sym]), (far_extra.astype(np.uint64), far_n)):
        value[nth] |= part << n[nth].astype(np.uint64)
        n[nth] += k
    colours = iter(palettes)
    heads = [_head(len(t), k, next(colours) if k == PALETTED else [], x, y) for t, k, x, y in zip(tiles, kind.tolist(), lengths, far_lengths, strict=True)]
    bits_head = np.fromiter((k for _, k in heads), np.int64, len(heads))
    body = np.bincount(where, n, len(tiles)).astype(np.int64)
    total = bits_head + body
    words = (total + 63 >> 6) + 1
    base = (np.cumsum(words) - words) << 6
    stop = np.cumsum(n)
    to = stop - n + (base + bits_head - np.cumsum(body) + body)[where]
    out = np.zeros(int(words.sum()), np.uint64)
    word, shift = to >> 6, (to & 63).astype(np.uint64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
        over = np.flatnonzero((to & 63) + n > 64)
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    raw = bytearray(out.tobytes())
    made: list[bytes] = []
    for i, (head, k) in enumerate(heads):
        begin, whole = int(base[i]) >> 3, -(-k // 8)
        merged = int.from_bytes(raw[begin : begin + whole], "little") | head
        raw[begin : begin + whole] = merged.to_bytes(whole, "little")
        made.append(bytes(raw[begin : begin + (int(total[i]) + 7) // 8]))
    out_media, done = [], 0
    for p in payloads:
        k = -(-len(p) // TILE)
        out_media.append(_file(made[done]) if k == 1 else _animation(made[done : done + k], [len(t) // WIDTH for t in tiles[done : done + k]]))
        done += k
    return out_media


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _animation(images: list[bytes], heights: list[int]) -> bytes:
    """One file of several images of the common width, as its frames."""
    three = lambda x: struct.pack("<I", x)[:3]
    frames = [_chunk(b"ANMF", three(0) * 2 + three(WIDTH - 1) + three(h - 1) + three(100) + b"\2" + _chunk(b"VP8L", x)) for x, h in zip(images, heights, strict=True)]
    head = _chunk(b"VP8X", b"\2\0\0\0" + three(WIDTH - 1) + three(max(heights) - 1)) + _chunk(b"ANIM", struct.pack("<IH", 0, 0))
    body = b"WEBP" + head + b"".join(frames)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def images_of(data: bytes) -> list[bytes]:
    """The lossless images of a file, in order: one, or an animation's frames."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise ValueError("the file ends early")
    out, at = [], 12
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a chunk runs over")
        if kind == b"VP8L":
            out.append(data[at + 8 : at + 8 + size])
        elif kind == b"ANMF":
            at += 24  # into the frame
            continue
        at += 8 + size + (size & 1)
    if not out:
        raise ValueError("no lossless image")
    return out


class _Plan:
    """How an image of the kinds that ``store`` writes is read; see _plan."""

    __slots__ = ("kind", "size", "samples", "table", "at", "green", "far", "width")


def _spread(lengths: list[int], depth: int) -> np.ndarray | None:
    """Symbol | bits << 9 for each ``depth`` bits that may come next; None if a code is longer."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return np.full(1 << depth, used[0][1] if used else 0)
    n, s = np.array(used).T
    if n[-1] > depth:
        return None
    if (1 << depth - n).sum() != 1 << depth:
        raise ValueError("not a complete prefix code")
    return np.repeat(s | n << 9, 1 << depth - n)[_REVERSED if depth == DEPTH else _REVERSED_FAR]


def _plan(chunk: bytes) -> _Plan | None:
    """What _lockstep needs of an image; None if it has transforms, codes or a cache that _lockstep doesn't read."""
    bits, plan = BitReader(chunk), _Plan()
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    steps, plan.kind, plan.table, plan.width = [], PLAIN, None, width
    while bits.read(1):
        steps.append(bits.read(2))
        if steps[-1] == PALETTE:
            n = bits.read(8) + 1
            table = np.array(_read_image(bits, n, 1, False))
            plan.kind, plan.table, plan.width = PALETTED, np.cumsum(table >> 8 & 255) & 255, (width + (1 << _bundle(n)) - 1) >> _bundle(n)
        elif steps[-1] == PREDICTOR:
            block = 2 + bits.read(3)
            modes = {p >> 8 & 15 for p in _read_image(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)}
            if modes not in ({1}, {2}):
                return None
            plan.kind = FROM_LEFT if modes == {1} else FROM_TOP
        elif steps[-1] != SUBTRACT_GREEN:
            return None
    if steps not in ([], [SUBTRACT_GREEN], [PALETTE], [PREDICTOR, SUBTRACT_GREEN]) or width != WIDTH or bits.read(1) or bits.read(1):
        return None
    green = read_lengths(bits, GREEN)
    rest = [read_lengths(bits, n) for n in ALPHABET[1:]]
    if any(sum(map(bool, x)) != 1 for x in rest[:3]):
        return None
    plan.green, plan.far = _spread(green, DEPTH), _spread(rest[3], FAR)
    if plan.green is None or plan.far is None:
        return None
    # Two symbols a look-up where both fit: first | second << 9 | samples << 18 | bits << 20; a back-reference has no samples.
    first, n = plan.green & 511, plan.green >> 9
    after = plan.green[_PLACES >> n]
    second, both = after & 511, n + (after >> 9)
    two = (first < 256) & (second < 256) & (both <= DEPTH)
    plan.green = (first | second << 9 | np.where(two, 2, first < 256) << 18 | np.where(two, both, n) << 20).astype(np.int32)
    plan.size, plan.samples, plan.at = plan.width * height, width * height, 8 * bits.at - bits.have
    return plan


def _lockstep(chunks: list[bytes], plans: list[_Plan]) -> list[np.ndarray]:
    """The green values of images, one look-up of every image at a time; a look-up gives two samples, one, or a back-reference."""
    count = len(plans)
    size = np.array([p.size for p in plans])
    padded = [c + b"\0" * 72 for c in chunks]
    ends = np.cumsum([len(c) for c in padded])
    bits = _windows(np.frombuffer(b"".join(padded), np.uint8)).view(np.int64)
    pos = (ends - np.array([len(c) for c in padded])) * 8 + np.array([p.at for p in plans])
    room = size + 64
    begin = np.cumsum(room) - room
    w, end = begin.copy(), begin + size
    out = np.zeros(int(room.sum()), np.uint8)
    table = np.concatenate([p.green for p in plans])
    far_table, width = np.stack([p.far for p in plans]).ravel(), np.array([p.width for p in plans])
    nears = {k: _near(k)[0] for k in set(width.tolist()) - {WIDTH}}
    live = np.flatnonzero(w < end)
    refs: list[tuple] = []
    turn = 0
    while len(live):
        # An image that is over runs on until the next clearing, into its 64 bytes of room.
        for _ in range(16):
            p = pos[live]
            v = bits[p >> 3] >> (p & 7)
            e = table[(live << DEPTH) + (v & (1 << DEPTH) - 1)]
            to, samples, used = w[live], e >> 18 & 3, e >> 20
            out[to] = e
            out[to + 1] = e >> 9
            to += samples
            back = np.flatnonzero(samples == 0)
            if len(back):
                who, k = live[back], used[back]
                x = v[back] >> k
                sym = (e[back] & 511) - 256
                extra = _EXTRA[sym]
                length = _BASE[sym] + (x & (1 << extra) - 1)
                x >>= extra
                f = far_table[(who << FAR) + (x & (1 << FAR) - 1)]
                far_sym, far_n = f & 511, f >> 9
                far_extra = _EXTRA[far_sym]
                far = _BASE[far_sym] + (x >> far_n & (1 << far_extra) - 1)
                refs.append((who, to[back], length, far))
                to[back] = np.minimum(to[back] + length, end[who])
                used[back] = k + extra + far_n + far_extra
            w[live] = to
            pos[live] = p + used
        live = live[w[live] < end[live]]
        if (pos[live] > ends[live] * 8 - 64).any():
            raise ValueError("an image ends early")
    if refs:
        who, place, length, far = (np.concatenate(x) for x in zip(*refs, strict=True))
        mine = place < end[who]
        who, place, length, far = who[mine], place[mine], length[mine], far[mine]
        near = _NEAR_FAR[np.minimum(far, len(NEAR))]
        for k, table_of in nears.items():
            near = np.where(width[who] == k, table_of[np.minimum(far, len(NEAR))], near)
        far = np.where(far > len(NEAR), far - len(NEAR), near)
        if ((far > place - begin[who]) | (place + length > end[who])).any():
            raise ValueError("a back-reference leaves the image")
        source = np.arange(len(out))
        spot = np.repeat(place - np.cumsum(length) + length, length) + np.arange(length.sum())
        source[spot] = spot - np.repeat(far, length)
        while True:  # a copy of a copy: twice as far each time
            follow = source[source[spot]]
            if (follow == source[spot]).all():
                break
            source[spot] = follow
        out[spot] = out[source[spot]]
    return [out[begin[i] : end[i]] for i in range(count)]


def _restored(plan: _Plan, green: np.ndarray) -> np.ndarray:
    """The samples of an image from its green values: transforms inverted."""
    if plan.kind == PALETTED:
        share = _bundle(len(plan.table))
        index = green[:, None] >> ((8 >> share) * np.arange(1 << share)).astype(np.uint8) & (1 << (8 >> share)) - 1
        table = np.zeros(256, np.uint8)
        table[: len(plan.table)] = plan.table
        return table[index.reshape(-1, plan.width << share)[:, :WIDTH].ravel()]
    if plan.kind == PLAIN:
        return green
    x = green.reshape(-1, WIDTH).copy()
    if plan.kind == FROM_TOP:
        x[0] = np.cumsum(x[0], dtype=np.uint8)
        return np.cumsum(x, 0, dtype=np.uint8).ravel()
    x[:, 0] = np.cumsum(x[:, 0], dtype=np.uint8)
    return np.cumsum(x, 1, dtype=np.uint8).ravel()


#: Bytes of payload that are written, and of media that are read, at once.
STORE_SLICE, LOAD_SLICE = 1_000_000, 4_000_000


def load(media: list[bytes]) -> list[np.ndarray]:
    """The samples (green channel, in order) of each media value."""
    owner, chunks, plans = [], [], []
    for i, m in enumerate(media):
        for chunk in images_of(m):
            owner.append(i)
            chunks.append(chunk)
            plans.append(_plan(chunk))
    parts: list = [None] * len(chunks)
    ready = [k for k, p in enumerate(plans) if p is not None]
    for k, p in enumerate(plans):
        if p is None:
            parts[k] = decode(_file(chunks[k]))[:, :, 1].ravel()
    for a in range(0, len(ready), 1024):
        some = ready[a : a + 1024]
        for k, green in zip(some, _lockstep([chunks[k] for k in some], [plans[k] for k in some]), strict=True):
            parts[k] = _restored(plans[k], green)
    joined: list[list[np.ndarray]] = [[] for _ in media]
    for i, p in zip(owner, parts, strict=True):
        joined[i].append(p)
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in joined]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the samples, and how much neighbours differ."""
    count = np.bincount(samples, minlength=256)
    share = count[count > 0] / max(1, len(samples))
    x = samples.astype(np.int64)
    step = int(np.abs(np.diff(x)).sum())
    mean = x.sum() / max(1, len(x))
    var = (x * x).sum() / max(1, len(x)) - mean * mean
    return f"{WIDTH}x{len(samples) // WIDTH};mean={mean:.6f};sd={max(0.0, var) ** 0.5:.6f};entropy={-(share * np.log2(share)).sum() + 0.0:.6f};step={step}"


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and media of each text."""
    source = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in slices(batch.column(1), STORE_SLICE):
                part = batch.slice(a, b - a)
                texts = utf8(part.column(1))
                media = store([x + b"\0" * (-len(x) % 64 if x else 64) for x in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def read_documents(stored: DataFrame, *, with_samples: bool = False) -> DataFrame:
    """Digests and features of stored media; with_samples: the samples themselves, too (binary, a byte a sample)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [stored.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    if with_samples:
        names, kinds = [*names, "samples"], [*kinds, T.BinaryType()]
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in slices(batch.column(2), LOAD_SLICE):
                part = batch.slice(a, b - a)
                media = part.column(2).to_pylist()
                got = load(media)
                raw = [x.tobytes() for x in got]
                cols = [part.column(0), part.column(1), pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(sha, raw))), pa.array([zlib.crc32(x[-64:]) for x in raw], pa.int64()), pa.array(list(map(len, media)), pa.int64()), pa.array(list(map(sha, media))), pa.array(list(map(feature, got)))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(raw, pa.binary())] if with_samples else cols, names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts as media, read them back and compute features."""
    return read_documents(written(store_documents(docs, id_col, text_col), "media"))
