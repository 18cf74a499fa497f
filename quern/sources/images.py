"""Raster images: BMP, QOI, PNG, Netpbm, TGA and uncompressed TIFF to arrays of 8-bit samples and back, and kernels on them.

An image is an array (height, width, channels) of uint8 with 1 (gray), 2 (gray, alpha), 3 or 4 channels.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from quern.sources.rows import Malformed, Report, Unsupported

MOST_SAMPLES = 1 << 31


def _guard(width: int, height: int, channels: int) -> None:
    if width < 1 or height < 1:
        raise Malformed("the image has no pixels")
    if width * height * channels > MOST_SAMPLES:
        raise Unsupported("the image has too many samples")


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of the colours, alpha kept."""
    if image.shape[2] < 3:
        return image
    c = image.astype(np.uint32)
    y = ((19595 * c[..., 0] + 38470 * c[..., 1] + 7471 * c[..., 2] + 32768) >> 16).astype(np.uint8)
    return np.dstack([y, image[..., 3]]) if image.shape[2] == 4 else y[..., None]


def flat(image: np.ndarray) -> np.ndarray:
    """Alpha over white."""
    if image.shape[2] in (1, 3):
        return image
    c, a = image[..., :-1].astype(np.uint32), image[..., -1:].astype(np.uint32)
    return ((c * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


def colour(image: np.ndarray) -> np.ndarray:
    """Three or four channels."""
    n = image.shape[2]
    return image if n > 2 else np.dstack([image[..., 0]] * 3 + ([image[..., 1]] if n == 2 else []))


def downscale(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average, colours weighted by alpha."""
    h, w, n = image.shape
    if width > w or height > h:
        raise ValueError("the target is larger")

    def weights(big: int, small: int) -> np.ndarray:
        edges = np.linspace(0, big, small + 1)
        low, high = np.arange(big), np.arange(1, big + 1)
        return np.clip(np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low), 0, None) * small / big

    rows, columns = weights(h, height), weights(w, width)
    shrink = lambda x: np.einsum("yh,xw,hwc->yxc", rows, columns, x, optimize=True)
    x = image.astype(float)
    if n in (2, 4):
        a = shrink(x[..., -1:])
        c = shrink(x[..., :-1] * x[..., -1:]) / np.maximum(a, 1e-9)
        return np.floor(np.dstack([np.where(a > 0, c, 0), a]) + 0.5).astype(np.uint8)
    return np.floor(shrink(x) + 0.5).astype(np.uint8)


def orientation(exif: bytes) -> int:
    """The orientation, 1 to 8, in Exif data that begin with a TIFF header; 1 if there is none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 10:
        return 1
    at = struct.unpack_from(order + "I", exif, 4)[0]
    if at + 2 > len(exif):
        return 1
    for k in range(struct.unpack_from(order + "H", exif, at)[0]):
        if at + 14 + 12 * k > len(exif):
            break
        number, kind = struct.unpack_from(order + "HH", exif, at + 2 + 12 * k)
        if number == 0x112 and kind == 3:
            value = struct.unpack_from(order + "H", exif, at + 10 + 12 * k)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def oriented(image: np.ndarray, how: int) -> np.ndarray:
    """The picture upright: 5 to 8 are stored on their side, even numbers below and odd ones above mirrored."""
    if how >= 5:
        image = image.transpose(1, 0, 2)
    if how in (2, 3, 6, 7):
        image = image[:, ::-1]
    if how in (3, 4, 7, 8):
        image = image[::-1]
    return np.ascontiguousarray(image)


def read_bmp(b: bytes, report: Report) -> np.ndarray:
    if b[:2] != b"BM" or len(b) < 30:
        raise Malformed("no BMP header")
    offset, size = struct.unpack_from("<I", b, 10)[0], struct.unpack_from("<I", b, 14)[0]
    if size < 40:
        raise Unsupported("BMP header of an old kind")
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", b, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise Unsupported("compressed BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    _guard(width, rows, 4)
    raw = np.frombuffer(b, np.uint8, rows * stride, offset) if len(b) >= offset + rows * stride else None
    if raw is None:
        raise Malformed("the BMP is cut short")
    raw = raw.reshape(rows, stride)
    if bits >= 24:
        x = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)
        x = x[..., [2, 1, 0, 3]] if bits == 32 and packing == 3 else x[..., [2, 1, 0]]
    else:
        used = struct.unpack_from("<I", b, 46)[0] or 1 << bits
        palette = np.frombuffer(b, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, [2, 1, 0]]
        index = np.unpackbits(raw, axis=1) if bits == 1 else raw if bits == 8 else np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)
        index = index[:, :width]
        if index.max(initial=0) >= used:
            raise Malformed("a pixel is outside the palette")
        x = palette[index]
    return np.ascontiguousarray(x[::-1] if height > 0 else x)


def write_bmp(image: np.ndarray, report: Report) -> bytes:
    x = colour(image)
    h, w, n = x.shape
    body = np.zeros((h, (w * n + 3) // 4 * 4), np.uint8)
    body[:, : w * n] = x[..., [2, 1, 0, 3][:n]].reshape(h, -1)
    body = body[::-1].tobytes()
    if n == 3:
        head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    else:
        head = struct.pack("<IiiHHIIiiII4I", 108, w, h, 1, 32, 3, len(body), 2835, 2835, 0, 0, 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + b"\0" * 48
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body


def read_qoi(b: bytes, report: Report) -> np.ndarray:
    if b[:4] != b"qoif" or len(b) < 22:
        raise Malformed("no QOI header")
    width, height, channels = struct.unpack_from(">IIB", b, 4)
    _guard(width, height, channels)
    seen, pixel, out, at, n = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), bytearray(), 14, width * height
    count = 0
    while count < n:
        if at >= len(b) - 8:
            raise Malformed("the QOI is cut short")
        c, run = b[at], 1
        at += 1
        r, g, bl, a = pixel
        if c == 254:
            pixel, at = (*b[at : at + 3], a), at + 3
        elif c == 255:
            pixel, at = tuple(b[at : at + 4]), at + 4
        elif c < 64:
            pixel = seen[c]
        elif c < 128:
            pixel = ((r + (c >> 4 & 3) - 2) & 255, (g + (c >> 2 & 3) - 2) & 255, (bl + (c & 3) - 2) & 255, a)
        elif c < 192:
            d, e = (c & 63) - 32, b[at]
            at += 1
            pixel = ((r + d + (e >> 4) - 8) & 255, (g + d) & 255, (bl + d + (e & 15) - 8) & 255, a)
        else:
            run = (c & 63) + 1
        seen[(pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64] = pixel
        out += bytes(pixel) * min(run, n - count)
        count += run
    return np.frombuffer(bytes(out), np.uint8).reshape(height, width, 4)[..., :channels].copy()


def write_qoi(image: np.ndarray, report: Report) -> bytes:
    x = colour(image)
    h, w, n = x.shape
    pixels = x if n == 4 else np.dstack([x, np.full((h, w), 255, np.uint8)])
    out, seen, last, run = bytearray(b"qoif" + struct.pack(">IIBB", w, h, n, 0)), [None] * 64, (0, 0, 0, 255), 0
    for p in map(tuple, pixels.reshape(-1, 4).tolist()):
        if p == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64
        d = [(p[k] - last[k] + 128 & 255) - 128 for k in range(3)]
        if seen[slot] == p:
            out.append(slot)
        elif p[3] != last[3]:
            out += bytes((255, *p))
        elif all(-2 <= v <= 1 for v in d):
            out.append(64 | d[0] + 2 << 4 | d[1] + 2 << 2 | d[2] + 2)
        elif -32 <= d[1] <= 31 and -8 <= d[0] - d[1] <= 7 and -8 <= d[2] - d[1] <= 7:
            out += bytes((128 | d[1] + 32, d[0] - d[1] + 8 << 4 | d[2] - d[1] + 8))
        else:
            out += bytes((254, *p[:3]))
        seen[slot], last = p, p
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + b"\0" * 7 + b"\1"


def _unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((rows + 1, stride + step), np.uint8)
    at = 0
    for y in range(1, rows + 1):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1)
        at += stride + 1
        up = out[y - 1]
        row = out[y]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = line + up[step:]
        elif kind == 1:
            for k in range(step):
                row[step + k :: step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind in (3, 4):
            r, u, src = row.tolist(), up.tolist(), line.tolist()
            for k in range(stride):
                left, above, corner = r[k], u[k + step], u[k]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
                    guess = left if pa <= pb and pa <= pc else above if pb <= pc else corner
                r[k + step] = (src[k] + guess) & 255
            row[:] = r
        else:
            raise Malformed("an unknown PNG filter")
    return out[1:, step:]


def read_png(b: bytes, report: Report) -> np.ndarray:
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise Malformed("no PNG header")
    at, head, data, palette, clear = 8, None, b"", None, None
    while at + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", b[at + 8 + size : at + 12 + size].ljust(4, b"\0"))[0] != zlib.crc32(kind + body):
            raise Malformed("a PNG chunk is damaged")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
    if head is None:
        raise Malformed("no PNG header")
    width, height, depth, kind, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    _guard(width, height, channels)
    try:
        raw = zlib.decompress(data)
    except zlib.error:
        raise Malformed("the PNG's data is damaged") from None
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)

    def samples(part: bytes, w: int, h: int) -> np.ndarray:
        line = (w * channels * depth + 7) // 8
        if len(part) < h * (line + 1):
            raise Malformed("the PNG is cut short")
        x = _unfilter(part, h, line, step)
        if depth == 16:
            return x.reshape(h, w, channels, 2)[..., 0]
        if depth < 8:
            bits = np.unpackbits(x, axis=1)[:, : w * depth].reshape(h, w, depth)
            v = bits @ (1 << np.arange(depth)[::-1])
            return (v if kind == 3 else v * 255 // ((1 << depth) - 1)).astype(np.uint8)[..., None]
        return x.reshape(h, w, channels)

    if depth == 16:
        report.loss("16-bit samples become 8-bit")
    if interlaced:
        x, at = np.zeros((height, width, channels), np.uint8), 0
        for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
            w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
            if w > 0 and h > 0:
                size = h * ((w * channels * depth + 7) // 8 + 1)
                x[y0::dy, x0::dx] = samples(raw[at : at + size], w, h)
                at += size
    else:
        x = samples(raw[: height * (stride + 1)], width, height)
    if kind == 3:
        if palette is None or x.max(initial=0) >= len(palette):
            raise Malformed("a pixel is outside the palette")
        rgb = palette[x[..., 0]]
        if clear is None:
            return rgb
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.dstack([rgb, alpha[x[..., 0]]])
    if clear is not None and depth == 8:
        key = np.frombuffer(clear, ">u2").astype(np.uint8)
        return np.dstack([x, np.where((x == key).all(2), 0, 255).astype(np.uint8)])
    return np.ascontiguousarray(x)


def write_png(image: np.ndarray, report: Report) -> bytes:
    h, w, n = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.zeros((h, w * n + 1), np.uint8)
    lines[:, 1:] = image.reshape(h, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _header_numbers(b: bytes, at: int, count: int) -> tuple[list[int], int]:
    out = []
    for _ in range(count):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(b, at)
        if not m:
            raise Malformed("a damaged Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1


def read_netpbm(b: bytes, report: Report) -> np.ndarray:
    kind = b[:2]
    if kind == b"P7":
        head, _, body = b.partition(b"ENDHDR\n")
        fields = dict(x.split(None, 1) for x in head.decode("latin-1").split("\n")[1:] if x.strip() and not x.startswith("#") and len(x.split()) > 1)
        w, h, n, most = (int(fields[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        _guard(w, h, n)
        if most > 255:
            raise Unsupported("16-bit Netpbm")
        x = np.frombuffer(body, np.uint8, w * h * n).reshape(h, w, n)
        return (x.astype(np.uint32) * 255 // most).astype(np.uint8)
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise Malformed("no Netpbm header")
    bits, n, plain = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1, kind < b"P4"
    (w, h, *most), at = _header_numbers(b, 2, 2 if bits else 3)
    _guard(w, h, n)
    top = most[0] if most else 1
    if top > 65535 or top < 1:
        raise Malformed("a damaged Netpbm header")
    try:
        if plain:
            text = re.sub(rb"#[^\n]*", b"", b[at - 1 :])
            x = np.array(list(text.translate(None, b" \t\r\n")) if bits else text.split()[: w * h * n], dtype=np.int64 if not bits else np.uint8)
            x = (x[: w * h] - 48 if bits else x).reshape(h, w, n)
        elif bits:
            x = np.unpackbits(np.frombuffer(b, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w, None]
        else:
            x = np.frombuffer(b, ">u2" if top > 255 else np.uint8, w * h * n, at).reshape(h, w, n)
    except ValueError:
        raise Malformed("the image is cut short") from None
    if top > 255:
        report.loss("16-bit samples become 8-bit")
    x = x.astype(np.int64)
    return ((1 - x) * 255 if bits else (x * 255 + top // 2) // top).astype(np.uint8)


def writer_netpbm(kind: str):
    def write(image: np.ndarray, report: Report) -> bytes:
        h, w, n = image.shape
        if kind == "pam":
            tuple_type = {1: "GRAYSCALE", 2: "GRAYSCALE_ALPHA", 3: "RGB", 4: "RGB_ALPHA"}[n]
            return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {n}\nMAXVAL 255\nTUPLTYPE {tuple_type}\nENDHDR\n".encode() + image.tobytes()
        if n in (2, 4):
            report.loss("transparency becomes white")
        x = flat(image)
        if kind == "ppm":
            return f"P6\n{w} {h}\n255\n".encode() + colour(x).tobytes()
        if x.shape[2] == 3:
            report.loss("colours become gray")
        x = gray(x)[..., 0]
        if kind == "pgm":
            return f"P5\n{w} {h}\n255\n".encode() + x.tobytes()
        if ((x > 0) & (x < 255)).any():
            report.loss("grays become black or white")
        return f"P4\n{w} {h}\n".encode() + np.packbits(x < 128, axis=1).tobytes()

    return write


def read_tga(b: bytes, report: Report) -> np.ndarray:
    if len(b) < 18:
        raise Malformed("no TGA header")
    skip, mapped, kind, _, colours, entry, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", b)
    if kind not in (1, 2, 3, 9, 10, 11) or bits not in (8, 24, 32):
        raise Unsupported("a TGA of this kind")
    _guard(w, h, 4)
    step, at = bits // 8, 18 + skip
    palette = None
    if mapped:
        if entry not in (24, 32):
            raise Unsupported("a TGA of this kind")
        palette = np.frombuffer(b, np.uint8, colours * entry // 8, at).reshape(colours, -1)
        at += colours * entry // 8
    if kind < 9:
        raw = b[at : at + w * h * step]
    else:
        out = bytearray()
        while len(out) < w * h * step and at < len(b):
            c = b[at]
            n = (c & 127) + 1
            out += b[at + 1 : at + 1 + step] * n if c & 128 else b[at + 1 : at + 1 + step * n]
            at += 1 + (step if c & 128 else step * n)
        raw = bytes(out[: w * h * step])
    if len(raw) < w * h * step:
        raise Malformed("the TGA is cut short")
    x = np.frombuffer(raw, np.uint8).reshape(h, w, step)
    if palette is not None:
        x = palette[x[..., 0]]
    if x.shape[2] > 1:
        x = x[..., [2, 1, 0, 3][: x.shape[2]]]
    x = x if flags & 32 else x[::-1]
    return np.ascontiguousarray(x[:, ::-1] if flags & 16 else x)


def write_tga(image: np.ndarray, report: Report) -> bytes:
    x = image if image.shape[2] == 1 else colour(image)
    h, w, n = x.shape
    if max(h, w) > 65535:
        raise Unsupported("the image is too large for TGA")
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * n, 32 | (8 if n == 4 else 0))
    return head + (x if n == 1 else x[..., [2, 1, 0, 3][:n]]).tobytes() + b"\0" * 8 + b"TRUEVISION-XFILE.\0"


def write_tiff(image: np.ndarray, report: Report) -> bytes:
    h, w, n = image.shape
    entries, extra, after = [], b"", 8
    body = image.tobytes()

    def tag(number: int, kind: int, values: list[int]) -> None:
        entries.append((number, kind, values))

    tag(256, 4, [w])
    tag(257, 4, [h])
    tag(258, 3, [8] * n)
    tag(259, 3, [1])
    tag(262, 3, [1 if n < 3 else 2])
    tag(273, 4, [0])
    tag(277, 3, [n])
    tag(278, 4, [h])
    tag(279, 4, [len(body)])
    if n in (2, 4):
        tag(338, 3, [2])
    at = after + 2 + 12 * len(entries) + 4
    fields = b""
    for number, kind, values in entries:
        packed = b"".join(struct.pack("<H" if kind == 3 else "<I", v) for v in values)
        if len(packed) > 4:
            fields += struct.pack("<HHII", number, kind, len(values), at + len(extra))
            extra += packed
        else:
            fields += struct.pack("<HHI", number, kind, len(values)) + packed.ljust(4, b"\0")
    start = at + len(extra)
    fields = fields.replace(struct.pack("<HHII", 273, 4, 1, 0), struct.pack("<HHII", 273, 4, 1, start))
    return b"II*\0" + struct.pack("<I", after) + struct.pack("<H", len(entries)) + fields + b"\0" * 4 + extra + body


def _unpackbits(b: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(b):
        n, at = b[at], at + 1
        if n < 128:
            out += b[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += b[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def _unlzw(b: bytes) -> bytes:
    """LZW with codes from the high bit on, of which each width ends one code early."""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    words, out, held, n, width, before = list(start), [], 0, 0, 9, b""
    for byte in b:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            words, width, before = list(start), 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and before:
            word = before + before[:1]
        else:
            raise Malformed("a damaged LZW stream")
        out.append(word)
        if before and len(words) < 4096:
            words.append(before + word[:1])
        before = word
        width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return b"".join(out)


_TIFF_PACKINGS = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32773: _unpackbits, 32946: zlib.decompress}


def read_tiff(b: bytes, report: Report) -> np.ndarray:
    """The first picture: strips or tiles of 1, 8 or 16 bits a sample, 16 bits made 8."""
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    if order is None or len(b) < 8:
        raise Malformed("no TIFF header")
    tags = {}
    try:
        at = struct.unpack_from(order + "I", b, 4)[0]
        for k in range(struct.unpack_from(order + "H", b, at)[0]):
            number, kind, count = struct.unpack_from(order + "HHI", b, at + 2 + 12 * k)
            size = {1: 1, 3: 2, 4: 4}.get(kind)
            if size:
                where = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", b, at + 10 + 12 * k)[0]
                if where + size * count > len(b):
                    raise Malformed("the TIFF is cut short")
                tags[number] = struct.unpack_from(f"{order}{count}{ {1: 'B', 2: 'H', 4: 'I'}[size] }", b, where)
        w, h, n = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    except (struct.error, KeyError):
        raise Malformed("the TIFF is cut short") from None
    _guard(w, h, n)
    packing, depth = tags.get(259, (1,))[0], tags.get(258, (1,))
    starts, sizes = (tags.get(324), tags.get(325)) if 324 in tags else (tags.get(273), tags.get(279))
    if len(set(depth)) > 1 or depth[0] not in (1, 8, 16) or depth[0] == 1 and n > 1 or packing not in _TIFF_PACKINGS or tags.get(284, (1,))[0] != 1 or not starts or not sizes:
        raise Unsupported("a TIFF of this kind")
    tile_w, tile_h = (tags[322][0], tags[323][0]) if 324 in tags and 322 in tags and 323 in tags else (w, min(h, tags.get(278, (h,))[0]))
    if not tile_w or not tile_h or 324 not in tags and len(starts) < -(-h // tile_h):
        raise Malformed("the TIFF is cut short")
    _guard(tile_w, tile_h, n)
    stride, across = -(-tile_w * n * depth[0] // 8), -(-w // tile_w)
    x = np.zeros((-(-h // tile_h) * tile_h, across * tile_w, n), np.uint8)
    for k, (s, c) in enumerate(zip(starts, sizes, strict=False)):
        top, left = k // across * tile_h, k % across * tile_w
        if top >= x.shape[0]:
            break
        rows = tile_h if 324 in tags else min(tile_h, h - top)
        try:
            raw = _TIFF_PACKINGS[packing](b[s : s + c])
        except zlib.error:
            raise Malformed("a damaged TIFF strip") from None
        if len(raw) < rows * stride:
            raise Malformed("the TIFF is cut short")
        part = np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride)
        if depth[0] == 1:
            part = np.unpackbits(part, axis=1)[:, :tile_w, None] * np.uint8(255 if tags.get(262, (1,))[0] != 3 else 1)
        elif depth[0] == 16:
            wide = part.reshape(rows, -1).view(order + "u2").reshape(rows, tile_w, n)
            part = ((np.cumsum(wide, axis=1, dtype=np.uint16) if tags.get(317, (1,))[0] == 2 else wide) >> 8).astype(np.uint8)
        else:
            part = part.reshape(rows, tile_w, n)
            part = np.cumsum(part, axis=1, dtype=np.uint8) if tags.get(317, (1,))[0] == 2 else part
        x[top : top + rows, left : left + tile_w] = part
    if depth[0] == 16:
        report.loss("16-bit samples become 8-bit")
    x, kind = x[:h, :w], tags.get(262, (1,))[0]
    if kind == 3:
        if 320 not in tags or len(tags[320]) % 3 or x[..., 0].max(initial=0) >= len(tags[320]) // 3:
            raise Malformed("a pixel is outside the palette")
        x = (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8)[x[..., 0]]
    elif kind == 0:
        x = 255 - x
    elif kind not in (1, 2):
        raise Unsupported("a TIFF of this colour space")
    return oriented(x, tags.get(274, (1,))[0])


def read_ico(b: bytes, report: Report) -> np.ndarray:
    """The largest picture of an icon or cursor, the deepest of equal ones."""
    if len(b) < 6 or b[:2] != b"\0\0" or b[2:4] not in (b"\1\0", b"\2\0"):
        raise Malformed("no icon header")
    count = struct.unpack_from("<H", b, 4)[0]
    if not count or len(b) < 6 + 16 * count:
        raise Malformed("the icon holds no picture")
    entries = []
    for k in range(count):
        w, h, _, _, _, bits, size, at = struct.unpack_from("<BBBBHHII", b, 6 + 16 * k)
        part = b[at : at + size]
        depth = 32 if part[:4] == b"\x89PNG" else struct.unpack_from("<H", part, 14)[0] if len(part) >= 16 else 0
        entries.append(((w or 256) * (h or 256), depth, -k, part))
    if count > 1:
        report.loss(f"{count - 1} smaller pictures are dropped")
    part = max(entries)[3]
    if part[:4] == b"\x89PNG":
        return read_png(part, report)
    if len(part) < 40:
        raise Malformed("the icon is cut short")
    size, width, double, _, bits, packing = struct.unpack_from("<IiiHHI", part)
    height = double // 2
    if packing or bits not in (1, 4, 8, 24, 32):
        raise Unsupported("a compressed picture in an icon")
    _guard(width, height, 4)
    colours = (struct.unpack_from("<I", part, 32)[0] or 1 << bits) if bits <= 8 else 0
    offset, stride = size + 4 * colours, (width * bits + 31) // 32 * 4
    head = struct.pack("<IHHI", 14 + len(part), 0, 0, 14 + offset)
    x = read_bmp(b"BM" + head + part[:8] + struct.pack("<i", height) + part[12:], report)
    if bits == 32:
        raw = np.frombuffer(part, np.uint8, height * stride, offset).reshape(height, width, 4)[::-1]
        if raw[..., 3].any():
            return np.dstack([x[..., :3], raw[..., 3]])
    line = (width + 31) // 32 * 4
    masked = part[offset + height * stride : offset + height * stride + height * line]
    if len(masked) < height * line:
        return x
    mask = np.unpackbits(np.frombuffer(masked, np.uint8).reshape(height, line), axis=1)[::-1, :width]
    return np.dstack([x[..., :3], np.where(mask == 1, 0, 255).astype(np.uint8)]) if mask.any() else x


def write_ico(image: np.ndarray, report: Report) -> bytes:
    """One picture, as a PNG of at most 256 x 256."""
    h, w, _ = image.shape
    if max(h, w) > 256:
        report.loss("the picture is scaled down to 256")
        scale = 256 / max(h, w)
        image = downscale(image, max(1, round(w * scale)), max(1, round(h * scale)))
        h, w, _ = image.shape
    body = write_png(image, report)
    return struct.pack("<HHHBBBBHHII", 0, 1, 1, w % 256, h % 256, 0, 0, 1, 8 * image.shape[2], len(body), 22) + body


READERS = {"bmp": read_bmp, "qoi": read_qoi, "png": read_png, "pbm": read_netpbm, "pgm": read_netpbm, "ppm": read_netpbm, "pam": read_netpbm, "tga": read_tga, "tiff": read_tiff, "ico": read_ico, "cur": read_ico}
WRITERS = {"bmp": write_bmp, "qoi": write_qoi, "png": write_png, "pbm": writer_netpbm("pbm"), "pgm": writer_netpbm("pgm"), "ppm": writer_netpbm("ppm"), "pam": writer_netpbm("pam"), "tga": write_tga, "tiff": write_tiff, "ico": write_ico}
