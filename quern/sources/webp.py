"""WebP pictures: the lossless coding (VP8L) in both directions; what is lossy or moves is refused.

A VP8L stream gives transforms first, each with its own data, then the pixels as literals, references back and entries of a
colour cache, under five prefix codes for each group of a coarser image. Transforms are undone in reverse order.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from quern.sources.images import _guard, colour
from quern.sources.rows import Malformed, Report, Unsupported

#: The order in which the lengths of the code for code lengths are stored.
_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Columns and rows back that the short distances stand for.
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
_OPAQUE = 0xFF000000


class _Bits:
    """Bits from the low end of each byte on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        more = self.data[self.at : self.at + 8]
        if not more:
            raise Malformed("the WebP is cut short")
        self.held |= int.from_bytes(more, "little") << self.n
        self.at += len(more)
        self.n += 8 * len(more)

    def read(self, n: int) -> int:
        if self.n < n:
            self._fill()
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return out

    def symbol(self, code: tuple[int, list]) -> int:
        bits, table = code
        if not bits:
            return table[0][0]
        if self.n < bits and self.at < len(self.data):
            self._fill()
        value, length = table[self.held & ((1 << bits) - 1)]
        if length > self.n or not length:
            raise Malformed("the WebP is cut short")
        self.held >>= length
        self.n -= length
        return value


def _reversed(code: int, length: int) -> int:
    return int(f"{code:0{length}b}"[::-1], 2)


def _canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Each used symbol's code, first bit lowest, and length."""
    out, code, before = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - before
        if code >> length:
            raise Malformed("a prefix code has too many words")
        out[symbol] = _reversed(code, length), length
        code, before = code + 1, length
    return out


def _table(lengths: list[int]) -> tuple[int, list]:
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        raise Malformed("a prefix code is empty")
    if len(used) == 1:
        return 0, [(used[0], 0)]
    most = max(lengths)
    table: list = [(0, 0)] * (1 << most)
    for symbol, (code, length) in _canonical(lengths).items():
        table[code :: 1 << length] = [(symbol, length)] * (1 << (most - length))
    return most, table


def _read_code(bits: _Bits, size: int) -> tuple[int, list]:
    lengths = [0] * size
    if bits.read(1):
        several, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1), *(bits.read(8) for _ in range(several))]
        if max(symbols) >= size:
            raise Malformed("a prefix code has a symbol outside its alphabet")
        for s in symbols:
            lengths[s] = 1
        return _table(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[_LENGTH_ORDER[k]] = bits.read(3)
    code = _table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left > 0:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            before, at = s or before, at + 1
            continue
        n, value = (3 + bits.read(2), before) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + n > size:
            raise Malformed("a prefix code is too long")
        lengths[at : at + n] = [value] * n
        at += n
    return _table(lengths)


def _amount(bits: _Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Malformed("the colour cache is too large")
    groups_of, shift, across = None, 0, 0
    groups = 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across, down = (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
        groups_of = ((_pixels(bits, across, down, False) >> 8) & 0xFFFF).tolist()
        groups = max(groups_of) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else []
    codes = [[_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    total, out, hashed = width * height, [], 32 - cache_bits
    symbol, code = bits.symbol, codes[0]
    while len(out) < total:
        at = len(out)
        if groups_of is not None:
            y, x = divmod(at, width)
            code = codes[groups_of[(y >> shift) * across + (x >> shift)]]
        s = symbol(code[0])
        if s < 256:
            red, blue = symbol(code[1]), symbol(code[2])
            pixel = symbol(code[3]) << 24 | red << 16 | s << 8 | blue
            out.append(pixel)
            if cache_bits:
                cache[(pixel * 0x1E35A7BD & 0xFFFFFFFF) >> hashed] = pixel
        elif s < 280:
            n = _amount(bits, s - 256)
            d = _amount(bits, symbol(code[4]))
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise Malformed("a reference leaves the picture")
            for k in range(at - d, at - d + n):
                out.append(out[k])
            if cache_bits:
                for pixel in out[at:]:
                    cache[(pixel * 0x1E35A7BD & 0xFFFFFFFF) >> hashed] = pixel
        else:
            pixel = cache[s - 280]
            out.append(pixel)
            cache[(pixel * 0x1E35A7BD & 0xFFFFFFFF) >> hashed] = pixel
    return np.array(out, np.uint32)


def _average(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))


def _clamped(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _predicted(mode: int, left: tuple, top: tuple, corner: tuple, right: tuple) -> tuple:
    """The guess for a pixel from those to its left, above it, and above it to either side."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7, 8, 9):
        return _average(*{6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}[mode])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        near_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        near_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if near_left < near_top else top
    if mode == 12:
        return tuple(_clamped(x + t - c) for x, t, c in zip(left, top, corner, strict=True))
    if mode == 13:
        half = _average(left, top)
        return tuple(_clamped(h + int((h - c) / 2)) for h, c in zip(half, corner, strict=True))
    return (255, 0, 0, 0)


def _undo_prediction(x: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """x: (height, width, 4) residuals, alpha first."""
    height, width, _ = x.shape
    rest, out = x.reshape(-1, 4).tolist(), []
    for y in range(height):
        for c in range(width):
            at = y * width + c
            if not y:
                guess = out[at - 1] if c else (255, 0, 0, 0)
            elif not c:
                guess = out[at - width]
            else:
                # the last column's neighbour to the right is the row's own first pixel
                guess = _predicted(int(modes[y >> shift, c >> shift]) & 15, out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])
            out.append(tuple((a + b) & 255 for a, b in zip(rest[at], guess, strict=True)))
    return np.array(out, np.uint8).reshape(height, width, 4)


def _channels(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    return pixels.astype(">u4").view(np.uint8).reshape(height, width, 4)


def _decoded(data: bytes) -> np.ndarray:
    """(height, width, 4), alpha first."""
    bits = _Bits(data)
    if bits.read(8) != 0x2F:
        raise Malformed("no lossless WebP stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    _guard(width, height, 4)
    bits.read(1)
    if bits.read(3):
        raise Unsupported("a WebP stream of another version")
    transforms, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise Malformed("a WebP transform comes twice")
        if kind < 2:
            shift = bits.read(3) + 2
            w, h = (across + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            transforms.append((kind, across, shift, _channels(_pixels(bits, w, h, False), h, w)))
        elif kind == 2:
            transforms.append((kind, across, 0, None))
        else:
            size = bits.read(8) + 1
            table = _channels(_pixels(bits, size, 1, False), 1, size)[0].cumsum(0, dtype=np.uint8)
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, across, shift, table))
            across = (across + (1 << shift) - 1) >> shift
    x = _channels(_pixels(bits, across, height, True), height, across)
    for kind, across, shift, data in reversed(transforms):
        if kind == 0:
            x = _undo_prediction(x, data[..., 2], shift)
        elif kind == 1:
            by = np.repeat(np.repeat(data, 1 << shift, 0)[:height], 1 << shift, 1)[:, :across].view(np.int8).astype(np.int32)
            c = x.astype(np.int32)
            signed = lambda v: ((v & 255) ^ 128) - 128
            green = signed(c[..., 2])
            red = c[..., 1] + (by[..., 3] * green >> 5) & 255
            blue = c[..., 3] + (by[..., 2] * green >> 5) + (by[..., 1] * signed(red) >> 5) & 255
            x = np.dstack([c[..., 0], red, c[..., 2], blue]).astype(np.uint8)
        elif kind == 2:
            x = x.copy()
            x[..., 1] += x[..., 2]
            x[..., 3] += x[..., 2]
        else:
            place = np.arange(across)
            index = x[:, place >> shift, 2] >> ((place & ((1 << shift) - 1)) * (8 >> shift)).astype(np.uint8) & ((1 << (8 >> shift)) - 1)
            x = np.concatenate([data, np.zeros((256, 4), np.uint8)])[index]
    return x


def _chunks(b: bytes) -> dict[bytes, bytes]:
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        raise Malformed("no WebP header")
    out, at = {}, 12
    while at + 8 <= len(b):
        size = struct.unpack_from("<I", b, at + 4)[0]
        out.setdefault(b[at : at + 4], b[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return out


def read(b: bytes, report: Report) -> np.ndarray:
    chunks = _chunks(b)
    if b"ANIM" in chunks or b"ANMF" in chunks:
        raise Unsupported("an animated WebP")
    if b"VP8L" not in chunks:
        raise Unsupported("a lossy WebP") if b"VP8 " in chunks else Malformed("the WebP has no picture")
    x = _decoded(chunks[b"VP8L"])
    x = x[..., [1, 2, 3]] if (x[..., 0] == 255).all() else x[..., [1, 2, 3, 0]]
    return np.ascontiguousarray(x)


# writing


def _lengths(counts: np.ndarray, most: int) -> list[int]:
    """Code lengths of at most `most` bits; a single symbol gets one."""
    counts = counts.astype(np.int64)
    while True:
        heap = [(int(n), s, (s,)) for s, n in enumerate(counts) if n]
        heapq.heapify(heap)
        out = [0] * len(counts)
        if len(heap) == 1:
            out[heap[0][1]] = 1
        while len(heap) > 1:
            (a, s, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for k in (*x, *y):
                out[k] += 1
            heapq.heappush(heap, (a + b, s, x + y))
        if max(out) <= most:
            return out
        counts = np.where(counts > 0, np.maximum(1, counts >> 1), 0)


class _Writer:
    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, n: int) -> None:
        self.many(np.array([value]), np.array([n]))

    def many(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.parts.append((values.astype(np.int64), lengths.astype(np.int64)))

    def bytes(self) -> bytes:
        values, lengths = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ends = np.cumsum(lengths)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        for k in range(int(lengths.max(initial=0))):
            some = lengths > k
            out[(ends - lengths)[some] + k] = values[some] >> k & 1
        return np.packbits(out, bitorder="little").tobytes()

    def code(self, counts: np.ndarray) -> dict[int, tuple[int, int]]:
        """Writes a prefix code for symbols that occur so often, and gives it."""
        used = np.flatnonzero(counts).tolist()
        if len(used) <= 2 and max(used, default=0) < 256:
            used = used or [0]
            self.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
            for s in used:
                self.put(s, 8)
            return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
        lengths = _lengths(counts, 15)
        own = _lengths(np.bincount(lengths, minlength=19)[:19], 7)
        if sum(map(bool, own)) == 1:  # one length for all: a second word makes the code whole
            own[next(k for k in range(16) if not own[k])] = 1
        self.put(0, 1)
        self.put(15, 4)
        for k in _LENGTH_ORDER:
            self.put(own[k], 3)
        self.put(0, 1)
        words = _canonical(own)
        self.many(np.array([words[n][0] for n in lengths]), np.array([words[n][1] for n in lengths]))
        return _canonical(lengths)

    def image(self, x: np.ndarray, main: bool) -> None:
        """(pixels, 4) with alpha first, as literals under one group of codes."""
        self.put(0, 1 + main)
        columns = [x[:, k] for k in (2, 1, 3, 0)]
        values, lengths = np.zeros((len(x), 4), np.int64), np.zeros((len(x), 4), np.int64)
        for k, (column, size) in enumerate(zip(columns, (280, 256, 256, 256), strict=True)):
            word = self.code(np.bincount(column, minlength=size))
            value, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for s, (v, n) in word.items():
                value[s], length[s] = v, n
            values[:, k], lengths[:, k] = value[column], length[column]
        self.code(np.zeros(40, np.int64))
        self.many(values.ravel(), lengths.ravel())


def write(image: np.ndarray, report: Report) -> bytes:
    """Lossless: green taken from the others, then each pixel's difference to the one on its left."""
    x = colour(image)
    height, width, n = x.shape
    if max(width, height) > 1 << 14:
        raise Unsupported("a WebP picture has at most 16384 pixels a side")
    alpha = x[..., 3] if n == 4 else np.full((height, width), 255, np.uint8)
    c = np.dstack([alpha, x[..., 0] - x[..., 1], x[..., 1], x[..., 2] - x[..., 1]])
    rest = c.copy()
    rest[:, 1:] -= c[:, :-1]
    rest[1:, 0] -= c[:-1, 0]
    rest[:1, :1, :1] -= np.uint8(255)
    out = _Writer()
    for value, size in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (n == 4, 1), (0, 3), (1, 1), (2, 2), (1, 1), (0, 2), (7, 3)):
        out.put(int(value), size)
    blocks = ((width + 511) >> 9) * ((height + 511) >> 9)
    out.image(np.tile(np.array([[255, 0, 1, 0]], np.uint8), (blocks, 1)), False)
    out.put(0, 1)
    out.image(rest.reshape(-1, 4), True)
    body = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
