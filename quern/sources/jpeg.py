"""JPEG: baseline and progressive DCT with Huffman codes, gray or YCbCr; files are written baseline. Arithmetic ones are refused."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from quern.sources.images import _guard, orientation, oriented
from quern.sources.rows import Malformed, Report, Unsupported

#: The standard's quantisation tables at quality 50, rows of the block.
LUMA = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
CHROMA = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"
#: Places of a block by diagonals, alternating direction.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_N = np.arange(8)
DCT = np.where(_N[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _N[None, :] + 1) * _N[:, None] * np.pi / 16)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if self.at > len(self.data) + 64:
                raise Malformed("the JPEG is cut short")
            self.at += 1
            self.held, self.count = self.held << 8 | byte, self.count + 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.count -= n
        out = self.held >> self.count
        self.held &= (1 << self.count) - 1
        return out

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.need(16)
        n, value = table[self.held >> (self.count - 16)]
        if not n:
            raise Malformed("an unknown JPEG code")
        self.count -= n
        self.held &= (1 << self.count) - 1
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _lookup(counts: bytes, values: bytes) -> list[tuple[int, int]]:
    """Length and value for every 16 bits."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            first = code << (16 - n)
            if first + (1 << (16 - n)) > 65536 or k >= len(values):
                raise Malformed("a damaged JPEG code table")
            out[first : first + (1 << (16 - n))] = [(n, values[k])] * (1 << (16 - n))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def read(b: bytes, report: Report) -> np.ndarray:
    """The picture the way up that its Exif data say."""
    if b[:2] != b"\xff\xd8":
        raise Malformed("no JPEG header")
    at, tables, codes, frame, restart, adobe, turned, scans = 2, {}, {}, None, 0, None, 1, 0
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        kind = b[at + 1]
        if kind in (0xFF, 0x00) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", b, at + 2)[0]
        body = b[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(int)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise Unsupported("a JPEG of more than 8 bits")
            h, w, n = struct.unpack_from(">HHB", body, 1)
            if not h or not w:
                raise Malformed("the JPEG has no pixels")
            _guard(w, h, n)
            frame = _Frame(w, h, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)], kind == 0xC2)
        elif 0xC0 < kind < 0xD0 and kind not in (0xC8, 0xCC):
            raise Unsupported("a JPEG of another kind than baseline or progressive")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            turned = orientation(body[6:])
        elif kind == 0xDA:
            if frame is None:
                raise Malformed("a JPEG scan without a frame")
            pieces, at = _entropy(b, at)
            try:
                frame.scan(body, pieces, codes, restart)
            except KeyError:
                raise Malformed("a JPEG scan names a table that is missing") from None
            scans += 1
    if frame is None:
        raise Malformed("the JPEG has no frame")
    if not scans:
        raise Malformed("the JPEG has no scan")
    planes = frame.planes(tables)
    if len(planes) == 1:
        image = np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)[..., None]
    else:
        if adobe != 0:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        image = np.clip(np.rint(np.dstack(planes)), 0, 255).astype(np.uint8)
    return oriented(image, turned)


def _entropy(b: bytes, at: int) -> tuple[list[bytes], int]:
    """A scan's data between restart marks, and where the next segment begins."""
    pieces, start, end = [], at, at
    while (end := b.find(b"\xff", end)) >= 0 and end + 1 < len(b):
        mark = b[end + 1]
        if mark == 0:
            end += 2
        elif 0xD0 <= mark <= 0xD7:
            pieces.append(b[start:end])
            start = end = end + 2
        elif mark == 0xFF:
            end += 1
        else:
            break
    end = end if end >= 0 else len(b)
    pieces.append(b[start:end])
    return [p.replace(b"\xff\x00", b"\xff") for p in pieces], end


class _Frame:
    """The coefficients of all components, filled in scan by scan."""

    def __init__(self, w: int, h: int, parts: list[tuple[int, int, int, int]], progressive: bool):
        if len(parts) not in (1, 3):
            raise Unsupported("a JPEG with four colours")
        if len(parts) == 1:
            parts = [(parts[0][0], 1, 1, parts[0][3])]
        if any(not 1 <= v <= 4 for p in parts for v in p[1:3]):
            raise Malformed("a JPEG component has no size")
        self.w, self.h, self.parts, self.progressive = w, h, parts, progressive
        self.across, self.down = max(p[1] for p in parts), max(p[2] for p in parts)
        self.columns, self.lines = -(-w // (8 * self.across)), -(-h // (8 * self.down))
        self.blocks = [np.zeros((self.lines * y, self.columns * x, 64), np.int32) for _, x, y, _ in parts]

    def _order(self, some: list[int]):
        """The blocks of each unit: one if a component comes alone, else a rectangle of each component."""
        if len(some) == 1:
            k = some[0]
            _, x, y, _ = self.parts[k]
            rows, columns = -(-(-(-self.h * y // self.down)) // 8), -(-(-(-self.w * x // self.across)) // 8)
            return [[(k, j, i)] for j in range(rows) for i in range(columns)]
        return [[(k, r * self.parts[k][2] + j, c * self.parts[k][1] + i) for k in some for j in range(self.parts[k][2]) for i in range(self.parts[k][1])] for r in range(self.lines) for c in range(self.columns)]

    def scan(self, body: bytes, pieces: list[bytes], codes: dict, restart: int) -> None:
        names = [p[0] for p in self.parts]
        some = [names.index(body[1 + 2 * k]) if body[1 + 2 * k] in names else -1 for k in range(body[0])]
        if -1 in some or not some:
            raise Malformed("a JPEG scan of a component that is missing")
        words = {k: body[2 + 2 * n] for n, k in enumerate(some)}
        first, last, bits_at = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        high, low = bits_at >> 4, bits_at & 15
        if not self.progressive:
            first, last, high, low = 0, 63, 0, 0
        if last > 63 or first > last or self.progressive and first and len(some) > 1:
            raise Malformed("a JPEG scan of coefficients that are missing")
        dc = {k: codes[words[k] >> 4] for k in some} if not first and not high else {}
        ac = {k: codes[0x10 | words[k] & 15] for k in some} if last and (first or not self.progressive) else {}
        bits, before, turn, run = _Bits(pieces[0]), dict.fromkeys(some, 0), 0, 0
        for number, unit in enumerate(self._order(some)):
            if restart and number and number % restart == 0:
                turn += 1
                if turn >= len(pieces):
                    raise Malformed("the JPEG is cut short")
                bits, before, run = _Bits(pieces[turn]), dict.fromkeys(some, 0), 0
            for k, j, i in unit:
                block = self.blocks[k][j, i]
                if not first:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        before[k] += bits.signed(bits.symbol(dc[k]))
                        block[0] = before[k] << low
                if not ac:
                    continue
                run = (_refine if high else _first)(block, bits, ac[k], max(1, first), last, low, run)

    def planes(self, tables: dict) -> list[np.ndarray]:
        out = []
        for (_, x, y, quant), held in zip(self.parts, self.blocks, strict=True):
            if quant not in tables:
                raise Malformed("a JPEG component names a table that is missing")
            c = np.zeros((held.shape[0] * held.shape[1], 64))
            c[:, ZIGZAG] = held.reshape(-1, 64) * tables[quant]
            pixels = np.einsum("ji,njk,kl->nil", DCT, c.reshape(-1, 8, 8), DCT, optimize=True) + 128
            plane = pixels.reshape(self.lines * y, self.columns * x, 8, 8).transpose(0, 2, 1, 3).reshape(self.lines * y * 8, -1)
            out.append(np.repeat(np.repeat(plane, -(-self.down // y), 0), -(-self.across // x), 1)[: self.h, : self.w])
        return out


def _first(block: np.ndarray, bits: _Bits, ac: list, n: int, last: int, low: int, run: int) -> int:
    """Coefficients for the first time; run: blocks that end here and now."""
    if run:
        return run - 1
    while n <= last:
        s = bits.symbol(ac)
        zeros, size = s >> 4, s & 15
        if not size:
            if zeros < 15:
                return (1 << zeros) - 1 + bits.take(zeros)
            n += 16
            continue
        n += zeros
        if n > last:
            raise Malformed("a JPEG block is too long")
        block[n] = bits.signed(size) << low
        n += 1
    return 0


def _refine(block: np.ndarray, bits: _Bits, ac: list, n: int, last: int, low: int, run: int) -> int:
    """One more bit of the coefficients seen so far, and new ones of that size."""
    one = 1 << low

    def sharpen(k: int) -> None:
        if bits.take(1):
            block[k] += one if block[k] > 0 else -one

    if not run:
        while n <= last:
            s = bits.symbol(ac)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            value = 0 if not size else one if bits.take(1) else -one
            while n <= last:
                if block[n]:
                    sharpen(n)
                elif zeros:
                    zeros -= 1
                else:
                    block[n] = value
                    n += 1
                    break
                n += 1
    if run:
        for k in range(n, last + 1):
            if block[k]:
                sharpen(k)
        return run - 1
    return 0


def _code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of at most 16 bits; a further symbol keeps the code of ones free."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, len(counts), [-1])]
    heapq.heapify(heap)
    length = dict.fromkeys([*counts, -1], 0)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    bits = [0] * (max(length.values()) + 2)
    for n in length.values():
        bits[n] += 1
    for n in range(len(bits) - 1, 16, -1):
        while bits[n] > 0:
            m = n - 2
            while not bits[m]:
                m -= 1
            bits[n] -= 2
            bits[n - 1] += 1
            bits[m + 1] += 2
            bits[m] -= 1
    order = sorted(counts, key=lambda s: (-counts[s], s))
    n = max(k for k in range(len(bits)) if bits[k])
    bits[n] -= 1
    out, k = {}, 0
    for size in range(1, 17):
        for _ in range(bits[size] if size < len(bits) else 0):
            out[order[k]] = size
            k += 1
    return out


def _codes(length: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    ordered = sorted(length, key=lambda s: (length[s], s))
    out, code, last = {}, 0, 0
    for s in ordered:
        code <<= length[s] - last
        last = length[s]
        out[s] = (code, last)
        code += 1
    return out, bytes(sum(n == k for n in length.values()) for k in range(1, 17)) + bytes(ordered)


def write(image: np.ndarray, report: Report, quality: int = 85) -> bytes:
    """4:4:4 with code tables made for the picture; alpha over white."""
    from quern.sources.images import flat

    if image.shape[2] in (2, 4):
        report.loss("transparency becomes white")
    x = flat(image).astype(float)
    h, w, n = x.shape
    if max(h, w) > 65535:
        raise Unsupported("the picture is too large for JPEG")
    if not 1 <= quality <= 100:
        raise Unsupported("quality goes from 1 to 100")
    if n == 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        x = np.dstack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b])
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    quants = [np.clip((np.array(list(map(int, t.split()))) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)][: 1 + (n == 3)]
    x = np.pad(x, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    rows, columns = x.shape[0] // 8, x.shape[1] // 8
    planes = []
    for k in range(n):
        blocks = x[..., k].reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        c = np.einsum("ij,njk,lk->nil", DCT, blocks, DCT, optimize=True).reshape(-1, 64)
        planes.append(np.rint(c / quants[min(k, 1) if n == 3 else 0])[:, ZIGZAG].astype(int))
    counts: dict[int, dict[int, int]] = {}
    last = [0] * n
    events: list[tuple[int, int, int, int]] = []

    def emit(table: int, symbol: int, value: int, size: int) -> None:
        counts.setdefault(table, {}).setdefault(symbol, 0)
        counts[table][symbol] += 1
        events.append((table, symbol, value if value >= 0 else value + (1 << size) - 1, size))

    for i in range(rows * columns):
        for k in range(n):
            block = planes[k][i]
            side = min(k, 1)
            d = int(block[0]) - last[k]
            last[k] = int(block[0])
            emit(side, abs(d).bit_length(), d, abs(d).bit_length())
            at = 1
            for p in (np.flatnonzero(block[1:]) + 1).tolist():
                run, v = p - at, int(block[p])
                while run > 15:
                    emit(16 | side, 0xF0, 0, 0)
                    run -= 16
                emit(16 | side, run << 4 | abs(v).bit_length(), v, abs(v).bit_length())
                at = p + 1
            if at < 64:
                emit(16 | side, 0, 0, 0)
    made = {t: _codes(_code_lengths(c)) for t, c in counts.items()}
    held = count = 0
    out = bytearray()
    for table, symbol, value, size in events:
        code, length = made[table][0][symbol]
        held, count = (held << length | code) << size | value, count + length + size
        while count >= 8:
            count -= 8
            byte = held >> count
            out.append(byte)
            if byte == 255:
                out.append(0)
            held &= (1 << count) - 1
    if count:
        byte = held << (8 - count) | (1 << (8 - count)) - 1
        out.append(byte)
        if byte == 255:
            out.append(0)
    segment = lambda kind, body: struct.pack(">BBH", 255, kind, len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += b"".join(segment(0xDB, bytes([k]) + bytes(q[ZIGZAG].tolist())) for k, q in enumerate(quants))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(n)))
    head += b"".join(segment(0xC4, bytes([t]) + body) for t, (_, body) in sorted(made.items()))
    head += segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, min(k, 1) * 0x11]) for k in range(n)) + b"\0\x3f\0")
    return head + bytes(out) + b"\xff\xd9"
