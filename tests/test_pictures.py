"""Pictures that other software writes, pictures on their side, WebP streams, and files damaged at random."""

import random
import struct

import numpy as np
import pytest

from quern.operators.convert import CONVERTERS, attempt
from quern.sources import images, jpeg, webp
from quern.sources.rows import Malformed, Report, Unsupported

Y, X = np.mgrid[0:37, 0:45]
GRAY = ((np.sin(X / 5) + np.cos(Y / 4)) * 50 + 128 + np.random.default_rng(1).integers(-9, 9, X.shape)).clip(0, 255).astype(np.uint8)
COLOUR = np.dstack([GRAY, GRAY[::-1], 255 - GRAY])


@pytest.fixture(scope="module")
def java(spark):
    """What the JVM's own image library writes and reads."""
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    io = jvm.javax.imageio

    class Java:
        @staticmethod
        def image(a):
            out = jvm.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 10 if a.ndim == 2 else 1)
            for y in range(a.shape[0]):
                for x in range(a.shape[1]):
                    if a.ndim == 2:
                        out.getRaster().setSample(x, y, 0, int(a[y, x]))
                    else:
                        out.setRGB(x, y, int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2]))
            return out

        @classmethod
        def write(cls, a, kind, progressive=None, packing=None):
            writer, out = io.ImageIO.getImageWritersByFormatName(kind).next(), jvm.java.io.ByteArrayOutputStream()
            stream = io.ImageIO.createImageOutputStream(out)
            writer.setOutput(stream)
            wish = writer.getDefaultWriteParam()
            if progressive is not None:
                wish.setProgressiveMode(progressive)
            if packing:
                wish.setCompressionMode(2)
                wish.setCompressionType(packing)
            writer.write(None, io.IIOImage(cls.image(a), None, None), wish)
            stream.flush()
            return bytes(out.toByteArray())

    return Java


@pytest.mark.parametrize("progressive", [0, 1])
def test_jpeg_of_another_writer(java, progressive):
    gray = jpeg.read(java.write(GRAY, "jpeg", progressive), Report())
    assert gray.shape == (37, 45, 1) and np.abs(gray[..., 0].astype(int) - GRAY).mean() < 4
    colour = jpeg.read(java.write(COLOUR, "jpeg", progressive), Report())
    assert colour.shape == (37, 45, 3) and np.abs(colour.astype(int) - COLOUR).mean() < 9
    assert (colour == jpeg.read(java.write(COLOUR, "jpeg", 1 - progressive), Report())).all()


@pytest.mark.parametrize("packing", ["LZW", "PackBits", "Deflate", "ZLib"])
def test_tiff_of_another_writer(java, packing):
    assert (images.read_tiff(java.write(GRAY, "tiff", None, packing), Report())[..., 0] == GRAY).all()
    assert (images.read_tiff(java.write(COLOUR, "tiff", None, packing), Report()) == COLOUR).all()


def test_lzw_over_all_widths():
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, 9000).astype(np.uint8).tobytes() + b"ab" * 3000
    codes, words, width, held, n, out = [256], {bytes([k]): k for k in range(256)}, 9, 0, 0, bytearray()
    word = b""
    for c in raw:
        longer = word + bytes([c])
        if longer in words:
            word = longer
            continue
        codes.append(words[word])
        words[longer] = len(words) + 2
        word = bytes([c])
        if len(words) + 2 == 4094:
            codes += [words[word], 256]
            words, word = {bytes([k]): k for k in range(256)}, b""
    codes += [words[word]] * bool(word) + [257]
    size = 258
    for code in codes:
        held, n = held << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(held >> n & 255)
        size = 257 if code == 256 else size + 1
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    out.append(held << (8 - n) & 255)
    assert images._unlzw(bytes(out)) == raw


def test_pictures_on_their_side():
    upright = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    # how the stored rows and columns lie for each orientation
    stored = {1: upright, 2: upright[:, ::-1], 3: upright[::-1, ::-1], 4: upright[::-1], 5: upright.transpose(1, 0, 2), 6: np.rot90(upright, 1), 7: np.rot90(upright, 2).transpose(1, 0, 2), 8: np.rot90(upright, -1)}
    for how, image in stored.items():
        assert (images.oriented(image, how) == upright).all(), how
        for order in "<>":
            exif = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHH", 8, 1, 0x112, 3, 1, how, 0) + b"\0" * 4
            assert images.orientation(exif) == how
    plain = jpeg.write(COLOUR, Report())
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x112, 3, 1, 6, 0) + b"\0" * 4
    turned = plain[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + plain[2:]
    assert (jpeg.read(turned, Report()) == np.rot90(jpeg.read(plain, Report()), -1)).all()
    assert images.orientation(b"") == images.orientation(b"II*\0\xff\xff\xff\x7f\0\0") == 1


def test_webp_there_and_back():
    rng = np.random.default_rng(3)
    for k in range(40):
        h, w, n = int(rng.integers(1, 40)), int(rng.integers(1, 40)), int(rng.integers(1, 5))
        image = rng.integers(0, 256 if k % 2 else 3, (h, w, n)).astype(np.uint8)
        if n in (2, 4):
            image[0, 0, -1] = 7
        back = webp.read(webp.write(image, Report()), Report())
        assert (back == images.colour(image)).all()
    wide = np.zeros((2, 1300, 3), np.uint8) + np.arange(1300, dtype=np.uint8)[None, :, None]
    assert (webp.read(webp.write(wide, Report()), Report()) == wide).all()


class Stream:
    """Bits of a WebP stream, put together by hand."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]
        return self

    def simple(self, *symbols):
        self.put(1, 1).put(len(symbols) - 1, 1).put(1, 1)
        for s in symbols:
            self.put(s, 8)
        return self

    def webp(self):
        body = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
        return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def head(w, h):
    return Stream().put(0x2F, 8).put(w - 1, 14).put(h - 1, 14).put(0, 1).put(0, 3)


def test_webp_references_and_cache():
    # 5 pixels of one row: a literal, then it again from the cache, then three by a reference to the pixel before
    s = head(5, 1).put(0, 1).put(1, 1).put(1, 4).put(0, 1)
    lengths = {9: 2, 258: 2, 280: 2, 281: 2}  # a literal green, length symbol for 3 pixels, and the cache's two entries
    s.put(0, 1).put(15, 4)
    own = {0: 1, 2: 2, 18: 2}
    for k in webp._LENGTH_ORDER:
        s.put(own.get(k, 0), 3)
    s.put(0, 1)
    words = webp._canonical([own.get(k, 0) for k in range(19)])
    at = 0
    while at < 282:
        gap = next((k for k in range(at, 282) if k in lengths), 282) - at
        while gap >= 11:
            n = min(gap, 138)
            s.put(*words[18]).put(n - 11, 7)
            at, gap = at + n, gap - n
        for _ in range(gap):
            s.put(*words[0])
            at += 1
        if at in lengths:
            s.put(*words[2])
            at += 1
    s.simple(200).simple(30).simple(255).simple(1)  # red, blue, alpha; distances: 1 is the pixel on the left
    pixel = 0xFF000000 | 200 << 16 | 9 << 8 | 30
    slot = (pixel * 0x1E35A7BD & 0xFFFFFFFF) >> 31
    green = webp._canonical([lengths.get(k, 0) for k in range(282)])
    for symbol in (9, 280 + slot, 258):
        s.put(*green[symbol])
    assert webp.read(s.webp(), Report()).tolist() == [[[200, 9, 30]] * 5]


def test_webp_palette_and_predictions():
    # two colours, eight to a byte: the table's second entry is a difference to the first
    s = head(8, 1).put(1, 1).put(3, 2).put(1, 8)
    s.put(0, 1).simple(10, 5).simple(20).simple(30).simple(255, 0).simple(0)
    s.put(0, 1).put(0, 1).put(1, 1).put(1, 1)
    s.put(0, 1).put(0, 1).put(0, 1).simple(0b10110001).simple(0).simple(0).simple(0).simple(0)
    got = webp.read(s.webp(), Report())
    first, second = [20, got[0, 1, 1], 30], [40, got[0, 0, 1], 60]
    assert [p.tolist() in (first, second) for p in got[0, :, :3]] == [True] * 8 and len({tuple(p) for p in got[0].tolist()}) == 2
    left, top, corner, right = (1, 10, 20, 30), (5, 50, 60, 70), (3, 30, 40, 50), (7, 90, 100, 110)
    want = {0: (255, 0, 0, 0), 1: left, 2: top, 3: right, 4: corner, 6: (2, 20, 30, 40), 7: (3, 30, 40, 50), 8: (4, 40, 50, 60), 9: (6, 70, 80, 90), 12: (3, 30, 40, 50), 13: (3, 30, 40, 50), 11: top}
    for mode, value in want.items():
        assert webp._predicted(mode, left, top, corner, right) == value, mode


def test_webp_that_is_refused():
    for content in (b"RIFF\0\0\0\0WEBPVP8 \4\0\0\0abcd", b"RIFF\0\0\0\0WEBPANIM\0\0\0\0"):
        with pytest.raises(Unsupported):
            webp.read(content, Report())
    with pytest.raises(Malformed):
        webp.read(b"RIFF\0\0\0\0WEBP", Report())


def made():
    """A small file of each format that a converter reads."""
    csv = b"a,b\n1,x\n2,\"y\nz\"\n"
    text = b"Title\n\nOne two three.\n\n- item\n"
    picture = images.WRITERS["png"](COLOUR[:9, :11], Report())
    out = {"csv": csv, "json": b'{"a":[1,{"b":null}],"c":"x"}', "text": text, "png": picture, "z64": b"\x80\x37\x12\x40abcd", "jsonl": b'{"a":1}\n{"b":2}\n'}
    for (source, target), f in sorted(CONVERTERS.items()):
        if source in ("csv", "text", "png", "json", "z64") and target not in out:
            try:
                out[target] = f(out[source], {}, Report())[0][1]
            except (Malformed, Unsupported):
                continue
    out["markdown-json"] = CONVERTERS["markdown", "markdown-json"](out["markdown"], {}, Report())[0][1]
    out["cur"] = out["ico"][:2] + b"\2" + out["ico"][3:]
    return out


def test_damaged_files_give_errors_and_end_nothing():
    rng, files, tried = random.Random(6), made(), 0
    edges = {}
    for source, target in CONVERTERS:
        edges.setdefault(source, []).append(target)
    assert set(edges) - set(files) <= {"heic", "numbers", "pages"}
    for source, content in sorted(files.items()):
        for k in range(330):
            b = bytearray(content)
            if k % 3 == 0:
                b = b[: rng.randint(0, len(b))]
            for _ in range(rng.randint(0, 6) if k % 3 == 0 else rng.randint(1, 8)):
                if b:
                    b[rng.randrange(len(b))] = rng.randrange(256)
            if k % 7 == 0:
                b = b + bytes(rng.randrange(256) for _ in range(rng.randint(1, 30)))
            parts, _, error = attempt(bytes(b), [(source, rng.choice(sorted(edges[source])))], {})
            assert (error is None) == bool(parts) or not parts
            tried += 1
    assert tried >= 9000
    for source, target, content in (("json", "yaml", b"[" * 200_000), ("yaml", "json", b"- " * 50_000), ("toml", "json", b"a=" + b"[" * 50_000), ("xml", "json", b"<a>" * 50_000), ("markdown", "html", b"> " * 20_000), ("html", "text", b"<ul><li>" * 20_000), ("json", "csv", b"")):
        parts, _, error = attempt(content, [(source, target)], {})
        assert error or parts
    assert attempt(None, [("csv", "json")], {})[2][0] == "malformed"
