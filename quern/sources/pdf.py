"""PDF: text pages with the built-in fonts and image pages out, text lines and page images in.

The reader follows the cross-reference by scanning for objects, inflates streams, object streams included, and reads text
operators with simple encodings and ToUnicode maps. Encrypted files and other filters are refused.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from quern.sources import events, jpeg
from quern.sources.rows import Malformed, Report, Unsupported

_WIDTH, _HEIGHT, _MARGIN = 595, 842, 64


class _Name(str):
    pass


class _Ref(int):
    pass


_TOKEN = re.compile(rb"%[^\r\n]*|[\x00\t\n\f\r ]+|(?P<ref>\d+[ \t\r\n]+\d+[ \t\r\n]+R(?![A-Za-z]))|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+))|/(?P<name>[^\x00\t\n\f\r ()<>\[\]{}/%]*)|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<string>\()|(?P<word>[A-Za-z'\"*0-9]+)|.", re.S)


def _string(b: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(b):
        c = b[at]
        at += 1
        if c == 0x5C and at < len(b):
            c = b[at]
            at += 1
            if m := re.compile(rb"[0-7]{1,3}").match(b, at - 1):
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif c in b"nrtbf":
                out.append(b"\n\r\t\b\f"[b"nrtbf".index(c)])
            elif c in b"\r\n":
                at += c == 13 and b[at : at + 1] == b"\n"
            else:
                out.append(c)
        elif c == 0x28:
            depth += 1
            out.append(c)
        elif c == 0x29:
            depth -= 1
            if not depth:
                return bytes(out), at
            out.append(c)
        else:
            out.append(c)
    raise Malformed("a string is not closed")


def _tokens(b: bytes, at: int = 0):
    while at < len(b) and (m := _TOKEN.match(b, at)):
        at = m.end()
        kind = m.lastgroup
        if kind == "string":
            value, at = _string(b, at)
            yield "string", value, at
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif kind == "ref":
            yield "value", _Ref(m["ref"].split()[0]), at
        elif kind == "number":
            yield "value", float(m["number"]), at
        elif kind == "name":
            yield "value", _Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), m["name"]).decode("latin-1")), at
        elif kind:
            yield kind, m[0], at


def _value(b: bytes, at: int):
    """An object and where it ends."""
    stack: list[list] = [[]]
    for kind, token, end in _tokens(b, at):
        if kind == "open":
            stack.append([token])
            continue
        if kind == "close":
            if len(stack) < 2:
                raise Malformed("an object closes what isn't open")
            opened, *items = stack.pop()
            value = items if opened == b"[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, _Name)}
        elif kind == "word":
            if token in (b"endobj", b"stream"):
                return stack[0][0] if stack[0] else None, end - len(token)
            value = {b"true": True, b"false": False}.get(token)
        else:
            value = token
        stack[-1].append(value)
        if len(stack) == 1:
            return value, end
    raise Malformed("an object is cut short")


class Pdf:
    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise Malformed("no PDF header")
        self.content, self.objects, self.streams = content, {}, {}
        for m in re.finditer(rb"(?<!\d)(\d+)[ \t\r\n]+\d+[ \t\r\n]+obj\b", content):
            try:
                value, end = _value(content, m.end())
            except Malformed:
                continue
            self.objects[int(m[1])] = value
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(content, end)):
                self.streams[int(m[1])] = s.end()
        if re.search(rb"/Encrypt\b", content):
            raise Unsupported("the PDF is encrypted")
        for i, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                body, first = self.stream(i), int(self.get(value["First"]))
                numbers = list(map(int, body[:first].split()))
                for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
                    self.objects.setdefault(number, _value(body, first + offset)[0])

    def get(self, x):
        seen = 0
        while isinstance(x, _Ref) and seen < 32:
            x, seen = self.objects.get(int(x)), seen + 1
        return x

    def raw(self, number: int) -> bytes:
        """A stream's bytes as they stand in the file."""
        info, at = self.objects.get(number), self.streams.get(number)
        if at is None:
            return b""
        length = self.get(info.get("Length"))
        end = at + int(length) if isinstance(length, float) and self.content[at + int(length) : at + int(length) + 12].lstrip().startswith(b"endstream") else self.content.find(b"endstream", at)
        return self.content[at:end]

    def stream(self, number: int) -> bytes:
        info = self.objects.get(number) or {}
        data, filters = self.raw(number), self.get(info.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise Unsupported(f"streams packed by {f}")
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                raise Malformed("a stream is damaged") from None
        parms = self.get(info.get("DecodeParms")) or {}
        if isinstance(parms, dict) and (parms.get("Predictor") or 1) >= 10:
            from quern.sources.images import _unfilter

            colours, bits, columns = (int(self.get(parms.get(k)) or d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
            stride = (colours * bits * columns + 7) // 8
            data = _unfilter(data, len(data) // (stride + 1), stride, max(1, colours * bits // 8)).tobytes()
        return data

    def pages(self) -> list[dict]:
        roots = [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(x, inherited: dict, depth: int) -> None:
            node = self.get(x)
            if not isinstance(node, dict) or depth > 50:
                return
            inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                for k in self.get(node["Kids"]) or []:
                    walk(k, inherited, depth + 1)
            else:
                out.append(inherited | node)

        if not roots:
            raise Malformed("the PDF has no catalogue of pages")
        walk(roots[-1].get("Pages"), {}, 0)
        return out

    def _maps(self, page: dict) -> dict[str, dict[int, str] | None]:
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        out = {}
        for name, ref in fonts.items():
            font, table = self.get(ref) or {}, None
            if isinstance(font.get("ToUnicode"), _Ref):
                table, body = {}, self.stream(int(font["ToUnicode"]))
                text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
                for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
                    table |= {int(a, 16): text(z) for a, z in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
                for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
                    for a, z, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                        base = text(to)
                        table |= {int(a, 16) + k: base[:-1] + chr(ord(base[-1]) + k) for k in range(int(z, 16) - int(a, 16) + 1) if base}
            out[name] = (table, font.get("Subtype") == "Type0")
        return out

    def lines(self, page: dict) -> list[tuple[float, float, float, str]]:
        """(y, x, size, text) of each line, top down."""
        contents = page.get("Contents")
        refs = self.get(contents) if isinstance(self.get(contents), list) else [contents]
        body = b"\n".join(self.stream(int(r)) for r in refs if isinstance(r, _Ref))
        maps, args, size, spans = self._maps(page), [], 12.0, []
        matrix = line = np.eye(3)
        table, wide, leading, nested = None, False, 0.0, []

        def show(s: bytes) -> str:
            codes = [int.from_bytes(s[k : k + 2], "big") for k in range(0, len(s), 2)] if wide else list(s)
            return "".join(table.get(c, "") if table is not None else bytes([c & 255]).decode("cp1252", "replace") for c in codes)

        def put(text: str) -> None:
            nonlocal matrix
            spans.append((round(float(matrix[2, 1]), 1), float(matrix[2, 0]), size * abs(float(matrix[1, 1]) or 1), text))
            matrix = np.array([[1, 0, 0], [0, 1, 0], [len(text) * size * 0.5, 0, 1]]) @ matrix

        for kind, token, _ in _tokens(body):
            if kind in ("value", "string"):
                (nested[-1] if nested else args).append(token)
                continue
            if kind == "open":
                nested.append([])
                continue
            if kind == "close":
                if nested:
                    done = nested.pop()
                    (nested[-1] if nested else args).append(done)
                continue
            if token == b"BT":
                matrix = line = np.eye(3)
            elif token == b"Tf" and len(args) > 1:
                table, wide = maps.get(args[-2], (None, False))
                size = args[-1]
            elif token in (b"Td", b"TD") and len(args) > 1:
                line = np.array([[1, 0, 0], [0, 1, 0], [args[-2], args[-1], 1]]) @ line
                matrix, leading = line, -args[-1] if token == b"TD" else leading
            elif token == b"Tm" and len(args) > 5:
                a, b, c, d, e, f = args[-6:]
                matrix = line = np.array([[a, b, 0], [c, d, 0], [e, f, 1]])
            elif token == b"TL" and args:
                leading = args[-1]
            elif token in (b"T*", b"'", b'"'):
                line = np.array([[1, 0, 0], [0, 1, 0], [0, -leading, 1]]) @ line
                matrix = line
                if token != b"T*" and args and isinstance(args[-1], bytes):
                    put(show(args[-1]))
            elif token == b"Tj" and args and isinstance(args[-1], bytes):
                put(show(args[-1]))
            elif token == b"TJ" and args and isinstance(args[-1], list):
                put("".join(show(x) if isinstance(x, bytes) else " " if isinstance(x, float) and x < -180 else "" for x in args[-1]))
            args = []
        out: list[tuple[float, float, float, str]] = []
        for y, x, s, text in sorted(spans, key=lambda v: (-v[0], v[1])):
            if out and abs(out[-1][0] - y) < 1:
                gap = "" if out[-1][3].endswith(" ") or text.startswith(" ") else " "
                out[-1] = (y, out[-1][1], max(s, out[-1][2]), out[-1][3] + gap + text)
            else:
                out.append((y, x, s, text))
        return [v for v in out if v[3].strip()]


def _chosen(pdf: Pdf, page: str | None) -> list[dict]:
    pages = pdf.pages()
    if page is None:
        return pages
    if not str(page).isdigit() or not 1 <= int(page) <= len(pages):
        raise Unsupported(f"no page {page}; there are {len(pages)}")
    return [pages[int(page) - 1]]


_BROKEN = re.compile(r"[^\W\d_]-$")


def _goes_on(before: str, line: str) -> bool:
    """Whether a line begins with the rest of a word that the one before it broke."""
    return bool(_BROKEN.search(before)) and line[:1].islower()


def _paragraphs(lines: list[tuple[float, float, float, str]]) -> list[list[tuple[float, str]]]:
    """(size, text) of lines that stand close to each other, broken words made whole."""
    out: list[list[tuple[float, str]]] = []
    last = None
    for y, _, s, t in lines:
        t = t.strip()
        if last is None or last[0] - y >= 1.6 * s or abs(last[1] - s) > 0.1 * s:
            out.append([(s, t)])
        elif _goes_on(out[-1][-1][1], t):
            out[-1][-1] = (s, out[-1][-1][1][:-1] + t)
        else:
            out[-1].append((s, t))
        last = (y, s)
    return out


def read_text(content: bytes, report: Report, page: str | None = None) -> str:
    """A line a line, a blank one after each block, a form feed after each page."""
    pdf = Pdf(content)
    pages = [_paragraphs(pdf.lines(p)) for p in _chosen(pdf, page)]
    return "".join("".join("\n".join(t for _, t in block) + "\n\n" for block in blocks) + "\f" for blocks in pages)


_BULLET = re.compile(r"[•◦▪‣●○■]\s+")
_NUMBER = re.compile(r"(\d{1,4})[.)]\s+")


def _items(blocks: list[tuple]) -> list[tuple]:
    """Paragraphs that begin with bullets, or with numbers that count up, as lists."""
    out: list[tuple] = []
    for b in blocks:
        first = b[1][0][1] if b[0] == "p" and b[1] and b[1][0][0] == "text" else ""
        m = _BULLET.match(first) or _NUMBER.match(first)
        number = int(m[1]) if m and m.re is _NUMBER else None
        before = out[-1] if out and out[-1][0] == "list" else None
        goes_on = before is not None and m is not None and (before[1] is None if number is None else before[1] is not None and before[1] + len(before[3]) == number)
        if m is None or number is not None and not goes_on and number != 1:
            out.append(b)
            continue
        item = (None, [("p", [x for x in [("text", first[m.end() :]), *b[1][1:]] if x != ("text", "")])])
        if goes_on:
            before[3].append(item)
        else:
            out.append(("list", number, True, [item]))
    return out


def read_blocks(content: bytes, report: Report, page: str | None = None) -> list[tuple]:
    """Paragraphs by the gaps between lines; lines in a larger size than most are headings, marked ones lists."""
    pdf = Pdf(content)
    pages = [_paragraphs(pdf.lines(p)) for p in _chosen(pdf, page)]
    weight: dict[float, int] = {}
    for s, t in (line for blocks in pages for block in blocks for line in block):
        weight[round(s, 1)] = weight.get(round(s, 1), 0) + len(t)
    usual = max(weight, key=weight.get, default=12.0)
    larger = sorted((s for s in weight if s > usual * 1.1), reverse=True)[:6]
    out: list[tuple] = []
    for block in (b for blocks in pages for b in blocks):
        size = round(block[0][0], 1)
        inlines = [x for k, (_, t) in enumerate(block) for x in [("soft",)] * (k > 0) + [("text", t)]]
        if size in larger:
            out += [("h", larger.index(size) + 1, [("text", t)]) for _, t in block]
            continue
        start = 0
        for k in range(1, len(inlines) + 1):  # a mark begins an item, wherever its line stands
            if k == len(inlines) or inlines[k][0] == "soft" and (_BULLET.match(inlines[k + 1][1])):
                out.append(("p", inlines[start:k]))
                start = k + 1
    return _items(out)


def read_image(content: bytes, report: Report, page: str | None = None) -> np.ndarray:
    """The picture that fills a page; text and drawings aren't rendered."""
    pdf = Pdf(content)
    for p in _chosen(pdf, page)[:1]:
        for ref in (pdf.get((pdf.get(p.get("Resources")) or {}).get("XObject")) or {}).values():
            info = pdf.get(ref)
            if isinstance(info, dict) and info.get("Subtype") == "Image" and isinstance(ref, _Ref):
                if pdf.get(info.get("Filter")) == "DCTDecode":
                    return jpeg.read(pdf.raw(int(ref)), report)
                n = {"DeviceGray": 1, "DeviceRGB": 3}.get(pdf.get(info.get("ColorSpace")))
                w, h = int(pdf.get(info["Width"])), int(pdf.get(info["Height"]))
                if n is None or pdf.get(info.get("BitsPerComponent")) != 8:
                    break
                data = pdf.stream(int(ref))
                if len(data) < w * h * n:
                    raise Malformed("the picture is cut short")
                x = np.frombuffer(data, np.uint8, w * h * n).reshape(h, w, n)
                if isinstance(info.get("SMask"), _Ref):
                    mask = np.frombuffer(pdf.stream(int(info["SMask"])), np.uint8)
                    return np.dstack([x, mask[: w * h].reshape(h, w)])
                return x.copy()
    raise Unsupported("the page is not a picture of a kind that can be read")


def _file(objects: list[bytes]) -> bytes:
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n" % (k + 1) + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def _stream(data: bytes, extra: bytes = b"") -> bytes:
    packed = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode%s >>\nstream\n" % (len(packed), extra) + packed + b"\nendstream"


def write_images(images: list[np.ndarray]) -> bytes:
    """A page of its picture's size for each picture."""
    objects, kids = [b"<< /Type /Catalog /Pages 2 0 R >>", b""], []
    for image in images:
        h, w, n = image.shape
        colours = image if n in (1, 3) else image[..., :-1]
        space = b"/DeviceGray" if colours.shape[2] == 1 else b"/DeviceRGB"
        head = b" /Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace " % (w, h)
        first = len(objects) + 1
        kids.append(first)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (w, h, first + 2, first + 1))
        objects.append(_stream(b"q %d 0 0 %d 0 0 cm /I Do Q" % (w, h)))
        objects.append(_stream(np.ascontiguousarray(colours).tobytes(), head + space + (b" /SMask %d 0 R" % (first + 3) if n in (2, 4) else b"")))
        if n in (2, 4):
            objects.append(_stream(np.ascontiguousarray(image[..., -1]).tobytes(), head + b"/DeviceGray"))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    return _file(objects)


def write_image(image: np.ndarray, report: Report) -> bytes:
    return write_images([image])


def write_jpeg(content: bytes, report: Report) -> bytes:
    """One page that holds the JPEG file as it is."""
    m = re.compile(rb"\xff[\xc0-\xc2]..\x08(..)(..)(.)", re.S).search(content)
    if content[:2] != b"\xff\xd8" or not m or m[3][0] not in (1, 3):
        raise Unsupported("a JPEG that a PDF can't hold as it is")
    h, w, space = int.from_bytes(m[1], "big"), int.from_bytes(m[2], "big"), b"/DeviceGray" if m[3] == b"\1" else b"/DeviceRGB"
    picture = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace %s /Filter /DCTDecode /Length %d >>\nstream\n" % (w, h, space, len(content))
    return _file([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /XObject << /I 5 0 R >> >> /Contents 4 0 R >>" % (w, h), _stream(b"q %d 0 0 %d 0 0 cm /I Do Q" % (w, h)), picture + content + b"\nendstream"])


#: Advance widths of Helvetica's letters, in thousandths of the size, from the blank to the tilde.
_WIDTHS = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"


def write_text(blocks: list[tuple], report: Report) -> bytes:
    """Pages of wrapped lines in Helvetica, code in Courier; letters outside Windows-1252 become question marks."""
    widths = list(map(int, _WIDTHS.split()))
    pages: list[list[bytes]] = [[]]
    y = float(_HEIGHT - _MARGIN)

    def width(s: str, size: float, mono: bool) -> float:
        return sum(600 if mono else widths[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in s) * size / 1000

    def line(s: str, size: float, font: str, x: float) -> None:
        nonlocal y
        if y < _MARGIN:
            pages.append([])
            y = _HEIGHT - _MARGIN
        raw = s.encode("cp1252", "replace")
        if b"?" in raw and raw.count(b"?") > s.count("?"):
            if not any("letters" in t for _, _, t in report.losses):
                report.loss("letters that the built-in fonts lack become question marks")
        raw = re.sub(rb"([\\()])", rb"\\\1", raw)
        pages[-1].append(b"BT /%s %g Tf %g %g Td (%s) Tj ET" % (font.encode(), size, x, y, raw))
        y -= size * 1.3

    def paragraph(text: str, size: float = 11, font: str = "F1", indent: float = 0, mark: str = "") -> None:
        nonlocal y
        room = _WIDTH - 2 * _MARGIN - indent
        for part in text.split("\n"):
            if font == "F3":
                line(part, size, font, _MARGIN + indent)
                continue
            held = ""
            for word in part.split():
                if held and width(f"{held} {word}", size, False) > room:
                    line(mark + held, size, font, _MARGIN + indent)
                    held, mark = "", " " * len(mark)
                held = f"{held} {word}" if held else word
            if held:
                line(mark + held, size, font, _MARGIN + indent)
        y -= size * 0.6

    def walk(bs: list[tuple], indent: float = 0) -> None:
        for b in bs:
            kind = b[0]
            if kind == "p":
                paragraph(events._text_inline(b[1]), indent=indent)
            elif kind == "h":
                paragraph(events._text_inline(b[2]), 24 - 2 * b[1], "F2", indent)
            elif kind == "code":
                paragraph(b[2].rstrip("\n"), 10, "F3", indent)
            elif kind == "quote":
                walk(b[1], indent + 24)
            elif kind == "list":
                for k, (task, inner) in enumerate(b[3]):
                    mark = "• " if b[1] is None else f"{b[1] + k}. "
                    for j, x in enumerate(inner):
                        if x[0] == "p":
                            paragraph(("" if task is None else "[x] " if task else "[ ] ") * (j == 0) + events._text_inline(x[1]), indent=indent + 18, mark=mark if j == 0 else "")
                        else:
                            walk([x], indent + 18)
            elif kind == "table":
                paragraph(events.write_text([b]).rstrip("\n"), 9, "F3", indent)
            elif kind == "hr":
                paragraph("* * *", indent=indent)

    walk(blocks)
    fonts = b"<< /F1 3 0 R /F2 4 0 R /F3 5 0 R >>"
    kids = [6 + 2 * k for k in range(len(pages))]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % f for f in (b"Helvetica", b"Helvetica-Bold", b"Courier")]
    for k, lines in zip(kids, pages, strict=True):
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font %s >> /Contents %d 0 R >>" % (_WIDTH, _HEIGHT, fonts, k + 1))
        objects.append(_stream(b"\n".join(lines)))
    return _file(objects)
