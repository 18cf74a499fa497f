"""Word, OpenDocument text, EPUB and RTF documents to the blocks of `events` and back.

What the blocks hold is kept: headings, paragraphs, lists, tables, quotes, code, links, notes and character formatting, as
styles and those that they build on give it. Text boxes follow their paragraph, formulas are their text, endnotes are
footnotes. Page layout, headers and footers, pictures' bytes and comments are reported and dropped; the readers take the text
as it stands after insertions and moves.
"""

from __future__ import annotations

import re
from xml.sax.saxutils import escape, quoteattr

from quern.sources import events
from quern.sources.rows import Malformed, Report
from quern.sources.workbooks import _HEAD, _open, _xml, _zip

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_STYLE = "{urn:oasis:names:tc:opendocument:xmlns:style:1.0}"
_FO = "{urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0}"
_XLINK = "{http://www.w3.org/1999/xlink}"


def _clean(s: str) -> str:
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s)


def _wrapped(inlines: list[tuple], kinds: list[str]) -> list[tuple]:
    for k in kinds:
        inlines = [(k, inlines)] if inlines else []
    return inlines


def _merged(nodes: list[tuple]) -> list[tuple]:
    """Neighbours of one kind become one."""
    out: list[tuple] = []
    for n in nodes:
        if out and n[0] == out[-1][0] and n[0] in ("em", "strong", "del"):
            out[-1] = (n[0], _merged(out[-1][1] + n[1]))
        elif out and n[0] == out[-1][0] == "code":
            out[-1] = ("code", out[-1][1] + n[1])
        else:
            out.append(n)
    return events._joined(out)


class _Lists:
    """Paragraphs at list levels, gathered into nested lists."""

    def __init__(self) -> None:
        self.blocks: list[tuple] = []
        self.open: list[tuple[bool, list]] = []

    def add(self, level: int, ordered: bool, block: tuple) -> None:
        while len(self.open) > level + 1:
            self._close()
        if len(self.open) == level + 1 and self.open[-1][0] != ordered:
            self._close()
        while len(self.open) < level + 1:
            self.open.append((ordered, []))
        self.open[-1][1].append((None, [block]))

    def _close(self) -> None:
        ordered, items = self.open.pop()
        done = ("list", 1 if ordered else None, True, items)
        if self.open:
            if not self.open[-1][1]:
                self.open[-1][1].append((None, []))
            self.open[-1][1][-1][1].append(done)
        else:
            self.blocks.append(done)

    def put(self, block: tuple) -> None:
        while self.open:
            self._close()
        self.blocks.append(block)

    def result(self) -> list[tuple]:
        while self.open:
            self._close()
        return self.blocks


# Word


_MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
#: Elements of a Word paragraph that only hold others.
_HOLDERS = {"ins", "moveTo", "smartTag", "sdt", "sdtContent", "bdo", "dir", "customXml"}


def _link_of(instruction: str) -> str | None:
    """The address of a HYPERLINK field, with # before a place in the document."""
    m = re.match(r'\s*HYPERLINK\s+(?:(\\l)\s+)?"([^"]*)"', instruction)
    return None if not m else ("#" if m[1] else "") + m[2]


class _Word:
    """A Word package: its parts, styles, lists and notes."""

    def __init__(self, z, report: Report):
        self.z, self.report, self.names = z, report, set(z.namelist())
        self.links = self._links("word/_rels/document.xml.rels")
        self.styles: dict[str, tuple[str, int | None]] = {}
        self.own: dict[str, dict[str, bool]] = {}
        self.parent: dict[str, str] = {}
        for e in self._part("word/styles.xml").iter(_W + "style") if "word/styles.xml" in self.names else ():
            i, name, outline, base = e.get(_W + "styleId"), e.find(_W + "name"), e.find(f"{_W}pPr/{_W}outlineLvl"), e.find(_W + "basedOn")
            self.styles[i] = ((name.get(_W + "val") if name is not None else "") or "", None if outline is None else int(outline.get(_W + "val")))
            self.own[i] = self._marks(e.find(_W + "rPr"))
            if base is not None:
                self.parent[i] = base.get(_W + "val", "")
        self.lists: dict[str, dict[str, bool]] = {}
        if "word/numbering.xml" in self.names:
            numbering = self._part("word/numbering.xml")
            shapes = {a.get(_W + "abstractNumId"): {v.get(_W + "ilvl"): v.find(_W + "numFmt").get(_W + "val") not in ("bullet", "none") for v in a.iter(_W + "lvl") if v.find(_W + "numFmt") is not None} for a in numbering.iter(_W + "abstractNum")}
            self.lists = {n.get(_W + "numId"): shapes.get(n.find(_W + "abstractNumId").get(_W + "val"), {}) for n in numbering.iter(_W + "num") if n.find(_W + "abstractNumId") is not None}
        self.texts = {kind: {e.get(_W + "id"): e for e in self._part(f"word/{kind}s.xml").iter(_W + kind)} if f"word/{kind}s.xml" in self.names else {} for kind in ("footnote", "endnote")}
        self.notes: dict[tuple[str, str], tuple[str, object]] = {}

    def _part(self, name: str):
        root = _xml(self.z, name)
        if root is None:
            raise Malformed(f"{name} is missing")
        return root

    def _links(self, name: str) -> dict[str, str]:
        return {r.get("Id"): r.get("Target", "") for r in self._part(name)} if name in self.names else {}

    @staticmethod
    def _marks(p) -> dict[str, bool]:
        """What run properties switch on or off."""
        out = {}
        for kind, tag in (("del", "strike"), ("em", "i"), ("strong", "b")):
            e = p.find(_W + tag) if p is not None else None
            if e is not None:
                out[kind] = e.get(_W + "val", "1") not in ("0", "false", "none")
        return out

    def inherited(self, style: str) -> dict[str, bool]:
        """What a style and those that it builds on switch on or off; the nearest counts."""
        out: dict[str, bool] = {}
        for _ in range(20):
            out = self.own.get(style, {}) | out
            if style not in self.parent:
                break
            style = self.parent[style]
        return out

    def _note(self, kind: str, i: str) -> list[tuple]:
        if i not in self.texts[kind]:
            return []
        label = self.notes.setdefault((kind, i), (str(len(self.notes) + 1), self.texts[kind][i]))[0]
        return [("ref", label)]

    def _run(self, x, base: dict[str, bool], boxes: list) -> list[tuple]:
        p, inner = x.find(_W + "rPr"), []
        for t in x:
            if t.tag == _W + "t":
                inner.append(("text", t.text or ""))
            elif t.tag in (_W + "br", _W + "cr"):
                inner.append(("br",))
            elif t.tag == _W + "tab":
                inner.append(("text", "\t"))
            elif t.tag == _W + "noBreakHyphen":
                inner.append(("text", "\u2011"))
            elif t.tag in (_W + "footnoteReference", _W + "endnoteReference"):
                inner += self._note("footnote" if "foot" in t.tag else "endnote", t.get(_W + "id"))
            elif t.tag == _W + "commentReference":
                self.report.loss("comments are dropped")
            elif t.tag in (_W + "drawing", _W + "pict", _W + "object") or t.tag.endswith("}AlternateContent"):
                found = next(t.iter(_W + "txbxContent"), None)
                if found is not None:
                    boxes.append(found)
                    continue
                name = next((d.get("descr") or "" for d in t.iter() if d.tag.endswith("}docPr")), "")
                self.report.loss("pictures are dropped")
                inner += [("text", name)] if name else []
        style = p.find(_W + "rStyle").get(_W + "val", "") if p is not None and p.find(_W + "rStyle") is not None else ""
        if inner and ("code" in self.styles.get(style, (style, None))[0].lower() or style == "Code"):
            return [("code", "".join(n[1] for n in inner if n[0] == "text"))]
        on = base | self.inherited(style) | self._marks(p)
        return _wrapped(inner, [k for k in ("del", "em", "strong") if on.get(k)])

    def inlines(self, e, base: dict[str, bool], boxes: list) -> list[tuple]:
        out: list[tuple] = []
        #: open fields: instruction, whether its result has begun, and what stands before it
        fields: list[list] = []
        for x in e:
            tag = x.tag.removeprefix(_W)
            if tag == "r":
                mark = x.find(_W + "fldChar")
                if mark is not None:
                    kind = mark.get(_W + "fldCharType")
                    if kind == "begin":
                        fields.append(["", False, out])
                        out = []
                    elif fields and kind == "separate":
                        fields[-1][1], out = True, []
                    elif fields and kind == "end":
                        instruction, begun, before = fields.pop()
                        address, inner = _link_of(instruction), out if begun else []
                        out = before + ([("link", address, "", _merged(inner))] if address is not None and inner else inner)
                    continue
                if fields and not fields[-1][1]:
                    fields[-1][0] += "".join(t.text or "" for t in x.iter(_W + "instrText"))
                    continue
                out += self._run(x, base, boxes)
            elif tag == "hyperlink":
                address = self.links.get(x.get(_R + "id"), "") or ("#" + x.get(_W + "anchor") if x.get(_W + "anchor") else "")
                out.append(("link", address, "", _merged(self.inlines(x, base, boxes))))
            elif tag == "fldSimple":
                address, inner = _link_of(x.get(_W + "instr", "")), self.inlines(x, base, boxes)
                out += [("link", address, "", _merged(inner))] if address is not None and inner else inner
            elif tag in _HOLDERS:
                out += self.inlines(x, base, boxes)
            elif tag in ("del", "moveFrom"):
                self.report.loss("deleted text is dropped")
            elif x.tag.startswith(_MATH):
                text = "".join(t.text or "" for t in x.iter(_MATH + "t"))
                if text:
                    self.report.loss("formulas become their text")
                    out.append(("text", text))
        for _, _, before in reversed(fields):  # fields that never end
            out = before + out
        return out

    def _paragraph(self, x, lists: _Lists) -> None:
        p, boxes = x.find(_W + "pPr"), []
        style = p.find(_W + "pStyle").get(_W + "val", "") if p is not None and p.find(_W + "pStyle") is not None else ""
        name, outline = self.styles.get(style, (style, None))
        m = re.fullmatch(r"(?:heading|Heading)\s*([1-9])", name)
        heading = m or outline is not None and outline < 9 or name.lower() == "title"
        # a heading's own look is no emphasis
        inlines = _merged(self.inlines(x, {} if heading else self.inherited(style), boxes))
        number = p.find(_W + "numPr") if p is not None else None
        if p is not None and p.find(_W + "sectPr") is not None:
            self._section(p.find(_W + "sectPr"))
        if not inlines:
            if p is not None and p.find(_W + "pBdr") is not None:
                lists.put(("hr",))
        elif heading:
            lists.put(("h", min(6, int(m[1]) if m else outline + 1 if outline is not None else 1), inlines))
        elif number is not None and number.find(_W + "numId") is not None and number.find(_W + "numId").get(_W + "val") != "0":
            level = number.find(_W + "ilvl")
            level = level.get(_W + "val", "0") if level is not None else "0"
            lists.add(int(level), self.lists.get(number.find(_W + "numId").get(_W + "val"), {}).get(level, False), ("p", inlines))
        elif "code" in name.lower():
            lists.put(("code", "", events._plain(inlines) + "\n"))
        elif "quote" in name.lower():
            lists.put(("quote", [("p", inlines)]))
        else:
            lists.put(("p", inlines))
        for box in boxes:
            for b in self.blocks(box):
                lists.put(b)

    def _section(self, e) -> None:
        if e.find(_W + "headerReference") is not None or e.find(_W + "footerReference") is not None:
            self.report.loss("headers and footers are dropped")

    def _table(self, x) -> tuple | None:
        table = []
        for tr in x.findall(_W + "tr"):
            row = []
            for tc in tr.findall(_W + "tc"):
                span, merge = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
                inner = self.blocks(tc) if merge is None or merge.get(_W + "val") == "restart" else []
                cell = [n for k, b in enumerate(inner) for n in ([("text", " ")] * (k > 0) + (b[-1] if b[0] in ("p", "h") else [("text", events.write_text([b]).replace("\n", " ").strip())]))]
                row += [events._joined(cell)] + [[]] * (min(1000, int(span.get(_W + "val", "1"))) - 1 if span is not None else 0)
            table.append(row)
        if not table or not (width := max(map(len, table))):
            return None
        table = [r + [[]] * (width - len(r)) for r in table]
        return ("table", [""] * width, table[0], table[1:])

    def blocks(self, e) -> list[tuple]:
        lists = _Lists()
        for x in e:
            if x.tag in (_W + "sdt", _W + "customXml", _W + "ins"):
                inner = x.find(_W + "sdtContent") if x.tag == _W + "sdt" else x
                for b in self.blocks(inner) if inner is not None else ():
                    lists.put(b)
            elif x.tag == _W + "p":
                self._paragraph(x, lists)
            elif x.tag == _W + "tbl":
                if table := self._table(x):
                    lists.put(table)
            elif x.tag == _W + "sectPr":
                self._section(x)
        return _quotes(lists.result())


def read_docx(content: bytes, report: Report) -> list[tuple]:
    z = _open(content)
    root = _xml(z, "word/document.xml")
    if root is None:
        raise Malformed("the package has no document")
    word, e = _Word(z, report), root.find(_W + "body")
    out = word.blocks(e) if e is not None else []
    done: list[tuple] = []
    while len(done) < len(word.notes):  # notes may refer to notes
        label, note = list(word.notes.values())[len(done)]
        done.append(("note", label, word.blocks(note)))
    return out + done


def _quotes(blocks: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for b in blocks:
        if out and b[0] == out[-1][0] == "quote":
            out[-1] = ("quote", out[-1][1] + b[1])
        elif out and b[0] == out[-1][0] == "code" and not b[1] and not out[-1][1]:
            out[-1] = ("code", "", out[-1][2] + b[2])
        else:
            out.append(b)
    return out


def write_docx(blocks: list[tuple], report: Report) -> bytes:
    out, links = [], []
    numbered = {b[1]: k for k, b in enumerate((b for b in blocks if b[0] == "note"), 1)}

    def run(text: str, marks: tuple = ()) -> str:
        pieces = re.split(r"([\t\n])", _clean(text))
        body = "".join("<w:tab/>" if p == "\t" else "<w:br/>" if p == "\n" else f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in pieces if p)
        props = "".join({"strong": "<w:b/>", "em": "<w:i/>", "del": "<w:strike/>", "code": '<w:rStyle w:val="Code"/>'}[m] for m in ("code", "strong", "em", "del") if m in marks)
        return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{body}</w:r>"

    def inline(ns: list[tuple], marks: tuple = ()) -> str:
        s = ""
        for n in ns:
            if n[0] == "text":
                s += run(n[1], marks)
            elif n[0] == "code":
                s += run(n[1], (*marks, "code"))
            elif n[0] in ("em", "strong", "del"):
                s += inline(n[1], (*marks, n[0]))
            elif n[0] == "link":
                links.append(n[1])
                s += f'<w:hyperlink r:id="rId{len(links) + 10}">{inline(n[3], marks)}</w:hyperlink>'
            elif n[0] == "img":
                report.loss("pictures become their descriptions")
                s += inline(n[3], marks)
            elif n[0] == "br":
                s += "<w:r><w:br/></w:r>"
            elif n[0] == "soft":
                s += run(" ", marks)
            elif n[0] == "ref":
                s += f'<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:footnoteReference w:id="{numbered[n[1]]}"/></w:r>' if n[1] in numbered else run(f"[{n[1]}]", marks)
            else:
                report.loss("raw HTML is dropped")
        return s

    def paragraph(body: str, props: str = "") -> None:
        out.append(f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>")

    numbers: list[bool] = []

    def walk(bs: list[tuple], style: str = "", level: int = 0) -> None:
        for b in bs:
            kind = b[0]
            if kind == "p":
                paragraph(inline(b[1]), style)
            elif kind == "h":
                paragraph(inline(b[2]), f'<w:pStyle w:val="Heading{b[1]}"/>')
            elif kind == "code":
                for line in b[2].removesuffix("\n").split("\n"):
                    paragraph(run(line) if line else run(" "), '<w:pStyle w:val="CodeBlock"/>')
            elif kind == "quote":
                walk(b[1], '<w:pStyle w:val="Quote"/>', level)
            elif kind == "hr":
                paragraph("", '<w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr>')
            elif kind == "html":
                report.loss("raw HTML is dropped")
            elif kind == "list":
                numbers.append(b[1] is not None)
                n = len(numbers)
                for task, inner in b[3]:
                    if task is not None and inner and inner[0][0] == "p":
                        inner = [("p", [("text", "☒ " if task else "☐ "), *inner[0][1]]), *inner[1:]]
                    for x in inner:
                        if x[0] == "p":
                            paragraph(inline(x[1]), f'<w:numPr><w:ilvl w:val="{min(8, level)}"/><w:numId w:val="{n}"/></w:numPr>')
                        else:
                            walk([x], style, level + 1)
            elif kind == "table":
                rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{inline(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in [b[2], *b[3]])
                out.append('<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/></w:tblPr><w:tblGrid>' + "<w:gridCol/>" * len(b[2]) + f"</w:tblGrid>{rows}</w:tbl>")

    walk([b for b in blocks if b[0] != "note"])
    document, notes = "".join(out), []
    for _, label, inner in (b for b in blocks if b[0] == "note"):
        out.clear()
        walk(inner or [("p", [])])
        notes.append(f'<w:footnote w:id="{numbered[label]}">{"".join(out)}</w:footnote>')
    spaces = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    style = lambda i, name, extra="", kind="paragraph": f'<w:style w:type="{kind}" w:styleId="{i}"><w:name w:val="{name}"/>{extra}</w:style>'
    levels = lambda fmt: "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{"•" if fmt == "bullet" else f"%{k + 1}."}"/><w:pPr><w:ind w:left="{720 * (k + 1)}" w:hanging="360"/></w:pPr></w:lvl>' for k in range(9))
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    types = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    linked = "".join(f'<Relationship Id="rId{k + 11}" Type="{base}/hyperlink" Target={quoteattr(_clean(a))} TargetMode="External"/>' for k, a in enumerate(links))
    return _zip(
        [
            ("[Content_Types].xml", _HEAD + f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{types}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{types}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{types}.numbering+xml"/><Override PartName="/word/footnotes.xml" ContentType="{types}.footnotes+xml"/></Types>'),
            ("_rels/.rels", _HEAD + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{base}/officeDocument" Target="word/document.xml"/></Relationships>'),
            ("word/document.xml", _HEAD + f"<w:document {spaces}><w:body>{document}<w:sectPr/></w:body></w:document>"),
            ("word/footnotes.xml", _HEAD + f"<w:footnotes {spaces}>{''.join(notes)}</w:footnotes>"),
            ("word/_rels/footnotes.xml.rels", _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + linked + "</Relationships>"),
            ("word/_rels/document.xml.rels", _HEAD + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{base}/styles" Target="styles.xml"/><Relationship Id="rId2" Type="{base}/numbering" Target="numbering.xml"/><Relationship Id="rId3" Type="{base}/footnotes" Target="footnotes.xml"/>' + linked + "</Relationships>"),
            ("word/styles.xml", _HEAD + f"<w:styles {spaces}>" + style("Normal", "Normal") + "".join(style(f"Heading{k}", f"heading {k}", f'<w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{40 - 4 * k}"/></w:rPr>') for k in range(1, 7)) + style("CodeBlock", "Code Block", '<w:rPr><w:rFonts w:ascii="Courier New"/></w:rPr>') + style("Quote", "Quote", '<w:pPr><w:ind w:left="720"/></w:pPr>') + style("Code", "Code", '<w:rPr><w:rFonts w:ascii="Courier New"/></w:rPr>', "character") + "</w:styles>"),
            ("word/numbering.xml", _HEAD + f'<w:numbering {spaces}><w:abstractNum w:abstractNumId="0">{levels("bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels("decimal")}</w:abstractNum>' + "".join(f'<w:num w:numId="{k + 1}"><w:abstractNumId w:val="{int(o)}"/></w:num>' for k, o in enumerate(numbers)) + "</w:numbering>"),
        ]
    )


# OpenDocument text


def read_odt(content: bytes, report: Report) -> list[tuple]:
    z = _open(content)
    root = _xml(z, "content.xml")
    if root is None:
        raise Malformed("the package has no content")
    marks, parents, ordered = {}, {}, {}
    for part in [_xml(z, "styles.xml") if "styles.xml" in z.namelist() else None, root]:
        for s in part.iter(_STYLE + "style") if part is not None else ():
            p = s.find(_STYLE + "text-properties")
            own = {}
            for kind, name, plain in (("del", _STYLE + "text-line-through-style", ("none",)), ("em", _FO + "font-style", ("normal",)), ("strong", _FO + "font-weight", ("normal", "100", "200", "300", "400", "500"))):
                if p is not None and p.get(name) is not None:
                    own[kind] = p.get(name) not in plain
            marks[s.get(_STYLE + "name")] = own
            parents[s.get(_STYLE + "name")] = s.get(_STYLE + "parent-style-name", "")
        for s in part.iter(_T + "list-style") if part is not None else ():
            ordered[s.get(_STYLE + "name")] = any(x.tag == _T + "list-level-style-number" for x in s)

    notes: list[tuple] = []

    def looks(name: str) -> list[str]:
        """What a style and those that it builds on switch on; the nearest counts."""
        on: dict[str, bool] = {}
        for _ in range(20):
            on = marks.get(name, {}) | on
            if not parents.get(name):
                break
            name = parents[name]
        return [k for k in ("del", "em", "strong") if on.get(k)]

    def inline(e) -> list[tuple]:
        out = [("text", re.sub(r"\s+", " ", e.text))] if e.text else []
        for x in e:
            if x.tag == _T + "span":
                name = x.get(_T + "style-name", "")
                inner = inline(x)
                out += [("code", events._plain(inner))] if "code" in (name + parents.get(name, "")).lower() or "Source" in name + parents.get(name, "") else _wrapped(inner, looks(name))
            elif x.tag == _T + "a":
                out.append(("link", x.get(_XLINK + "href", ""), "", _merged(inline(x))))
            elif x.tag == _T + "s":
                out.append(("text", " " * int(x.get(_T + "c", "1"))))
            elif x.tag == _T + "tab":
                out.append(("text", "\t"))
            elif x.tag == _T + "line-break":
                out.append(("br",))
            elif x.tag == _T + "note":
                inside = x.find(_T + "note-body")
                notes.append(("note", str(len(notes) + 1), []))
                k = len(notes) - 1
                notes[k] = ("note", notes[k][1], body(inside) if inside is not None else [])
                out.append(("ref", notes[k][1]))
            elif x.tag.endswith("}annotation"):
                report.loss("comments are dropped")
            elif x.tag.endswith("}frame"):
                boxes = [b for b in x if b.tag.endswith("}text-box")]
                if boxes:
                    inside = [b for box in boxes for b in body(box)]
                    out.append(("text", " " + events.write_text(inside).strip().replace("\n", " ")))
                else:
                    report.loss("pictures are dropped")
                    title = next((t.text for t in x if t.tag.endswith(("}title", "}desc")) and t.text), None)
                    out += [("text", title)] if title else []
            elif not x.tag.endswith(("}annotation-end", "}tracked-changes")):
                out += inline(x)
            if x.tail:
                out.append(("text", re.sub(r"\s+", " ", x.tail)))
        return out

    def body(e) -> list[tuple]:
        out: list[tuple] = []
        for x in e:
            if x.tag == _T + "h":
                out.append(("h", min(6, int(x.get(_T + "outline-level", "1"))), _merged(inline(x))))
            elif x.tag == _T + "p":
                name = x.get(_T + "style-name", "")
                kind = f"{name} {parents.get(name, '')}".lower()
                inlines = _merged(inline(x))
                if "horizontal" in kind:
                    out.append(("hr",))
                elif inlines and ("quotation" in kind or "quote" in kind):
                    out.append(("quote", [("p", inlines)]))
                elif "preformatted" in kind or "code" in kind:
                    out.append(("code", "", events._plain(inlines) + "\n"))
                elif inlines:
                    out.append(("p", inlines))
            elif x.tag == _T + "list":
                items = [(None, body(i)) for i in x if i.tag in (_T + "list-item", _T + "list-header")]
                out.append(("list", 1 if ordered.get(x.get(_T + "style-name", ""), False) else None, True, items))
            elif x.tag == _TABLE + "table":
                rows = []
                for tr in x.iter(_TABLE + "table-row"):
                    row = []
                    for c in tr:
                        times = int(c.get(_TABLE + "number-columns-repeated", "1"))
                        inner = body(c)
                        row += [events._joined([n for k, b in enumerate(inner) for n in ([("text", " ")] * (k > 0) + (b[-1] if b[0] in ("p", "h") else []))])] * min(times, 1000)
                    rows.append(row)
                if rows and (width := max(map(len, rows))):
                    rows = [r + [[]] * (width - len(r)) for r in rows]
                    out.append(("table", [""] * width, rows[0], rows[1:]))
            elif x.tag == _T + "section":
                out += body(x)
        return _quotes(out)

    text = next((x for x in root.iter() if x.tag == "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}text"), None)
    out = body(text) if text is not None else []
    return out + notes


def write_odt(blocks: list[tuple], report: Report) -> bytes:
    combos: dict[tuple, str] = {}
    texts = {b[1]: (k, b[2]) for k, b in enumerate((b for b in blocks if b[0] == "note"), 1)}
    cited: set[str] = set()

    def note(label: str) -> str:
        """The first reference holds the note; others repeat its number."""
        if label not in texts or label in cited:
            return escape(f"[{texts[label][0] if label in texts else label}]")
        cited.add(label)
        k, inner = texts[label]
        return f'<text:note text:id="ftn{k}" text:note-class="footnote"><text:note-citation>{k}</text:note-citation><text:note-body>{walk(inner) or "<text:p/>"}</text:note-body></text:note>'

    def spaced(s: str) -> str:
        s = re.sub(r" {2,}|^ ", lambda m: f'<text:s text:c="{len(m[0])}"/>', escape(_clean(s)))
        return s.replace("\t", "<text:tab/>").replace("\n", "<text:line-break/>")

    def text(s: str, marks: tuple) -> str:
        if not marks:
            return spaced(s)
        name = "SourceText" if "code" in marks else combos.setdefault(tuple(sorted(set(marks))), f"T{len(combos) + 1}")
        return f'<text:span text:style-name="{name}">{spaced(s)}</text:span>'

    def inline(ns: list[tuple], marks: tuple = ()) -> str:
        s = ""
        for n in ns:
            if n[0] in ("text", "code"):
                s += text(n[1], marks if n[0] == "text" else (*marks, "code"))
            elif n[0] in ("em", "strong", "del"):
                s += inline(n[1], (*marks, n[0]))
            elif n[0] == "link":
                s += f'<text:a xlink:type="simple" xlink:href={quoteattr(_clean(n[1]))}>{inline(n[3], marks)}</text:a>'
            elif n[0] == "img":
                report.loss("pictures become their descriptions")
                s += inline(n[3], marks)
            elif n[0] == "br":
                s += "<text:line-break/>"
            elif n[0] == "soft":
                s += " "
            elif n[0] == "ref":
                s += note(n[1])
            else:
                report.loss("raw HTML is dropped")
        return s

    def walk(bs: list[tuple], style: str = "Standard") -> str:
        s = ""
        for b in bs:
            kind = b[0]
            if kind == "p":
                s += f'<text:p text:style-name="{style}">{inline(b[1])}</text:p>'
            elif kind == "h":
                s += f'<text:h text:outline-level="{b[1]}">{inline(b[2])}</text:h>'
            elif kind == "code":
                s += "".join(f'<text:p text:style-name="Preformatted">{spaced(x)}</text:p>' for x in b[2].removesuffix("\n").split("\n"))
            elif kind == "quote":
                s += walk(b[1], "Quotations")
            elif kind == "hr":
                s += '<text:p text:style-name="HorizontalLine"/>'
            elif kind == "html":
                report.loss("raw HTML is dropped")
            elif kind == "list":
                items = "".join(f"<text:list-item>{walk(([('p', [('text', '☒ ' if task else '☐ '), *inner[0][1]]), *inner[1:]] if task is not None and inner and inner[0][0] == 'p' else inner), style)}</text:list-item>" for task, inner in b[3])
                s += f'<text:list text:style-name="{"L1" if b[1] is None else "L2"}">{items}</text:list>'
            elif kind == "table":
                rows = "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{inline(c)}</text:p></table:table-cell>" for c in r) + "</table:table-row>" for r in [b[2], *b[3]])
                s += f'<table:table><table:table-column table:number-columns-repeated="{len(b[2])}"/>{rows}</table:table>'
        return s

    body = walk(blocks)
    props = {"strong": 'fo:font-weight="bold"', "em": 'fo:font-style="italic"', "del": 'style:text-line-through-style="solid"'}
    styles = "".join(f'<style:style style:name="{name}" style:family="text"><style:text-properties {" ".join(props[m] for m in marks)}/></style:style>' for marks, name in combos.items())
    levels = lambda tag, extra: "".join(f'<text:{tag} text:level="{k}" {extra}/>' for k in range(1, 10))
    styles += f'<text:list-style style:name="L1">{levels("list-level-style-bullet", "text:bullet-char=" + chr(34) + "•" + chr(34))}</text:list-style><text:list-style style:name="L2">{levels("list-level-style-number", "style:num-format=" + chr(34) + "1" + chr(34) + " style:num-suffix=" + chr(34) + "." + chr(34))}</text:list-style>'
    spaces = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("text", "text"), ("table", "table"), ("style", "style"), ("fo", "xsl-fo-compatible"))) + ' xmlns:xlink="http://www.w3.org/1999/xlink"'
    mime = "application/vnd.oasis.opendocument.text"
    return _zip(
        [
            ("mimetype", mime),
            ("META-INF/manifest.xml", _HEAD + f'<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.3"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'),
            ("content.xml", _HEAD + f'<office:document-content {spaces} office:version="1.3"><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>'),
        ],
        stored=1,
    )


# EPUB


def read_epub(content: bytes, report: Report) -> list[tuple]:
    z = _open(content)
    container = _xml(z, "META-INF/container.xml") if "META-INF/container.xml" in z.namelist() else None
    path = next((e.get("full-path") for e in container.iter() if e.tag.endswith("}rootfile")), None) if container is not None else None
    package = _xml(z, path) if path else None
    if package is None:
        raise Malformed("the book has no package document")
    folder = path.rpartition("/")[0]
    items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
    out: list[tuple] = []
    for ref in (e for e in package.iter() if e.tag.endswith("}itemref")):
        href = items.get(ref.get("idref"))
        name = f"{folder}/{href}" if folder else href
        if href and name in z.namelist():
            out += events.read_html(z.read(name).decode("utf-8", "replace"))
        else:
            report.warn(f"the chapter {href} is missing")
    return out


def write_epub(blocks: list[tuple], report: Report) -> bytes:
    chapters: list[list[tuple]] = [[]]
    for b in blocks:
        if b[0] == "h" and b[1] == 1 and chapters[-1]:
            chapters.append([])
        chapters[-1].append(b)
    title = next((events._plain(b[2]) for b in blocks if b[0] == "h"), "Untitled")

    def page(bs: list[tuple]) -> str:
        return _HEAD + f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body>\n{events.write_html([b for b in bs if b[0] != "html"])}</body></html>\n'.replace('checked=""', 'checked="checked"').replace('disabled=""', 'disabled="disabled"')

    names = [f"c{k + 1}.xhtml" for k in range(len(chapters))]
    heads = [next((events._plain(b[2]) for b in c if b[0] == "h"), f"Chapter {k + 1}") for k, c in enumerate(chapters)]
    nav = _HEAD + '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>' + "".join(f'<li><a href="{n}">{escape(h)}</a></li>' for n, h in zip(names, heads, strict=True)) + "</ol></nav></body></html>\n"
    package = _HEAD + f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:none</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>und</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' + "".join(f'<item id="c{k + 1}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names)) + "</manifest><spine>" + "".join(f'<itemref idref="c{k + 1}"/>' for k in range(len(names))) + "</spine></package>\n"
    files = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", _HEAD + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'), ("OEBPS/package.opf", package), ("OEBPS/nav.xhtml", nav)]
    return _zip([*files, *((f"OEBPS/{n}", page(c)) for n, c in zip(names, chapters, strict=True))], stored=1)


# RTF

_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
#: Destinations whose text is not the document's.
_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "headerl", "headerr", "headerf", "footerl", "footerr", "footerf", "listtable", "listoverridetable", "generator", "themedata", "datastore", "latentstyles", "xmlnstbl", "rsidtbl", "annotation", "atnid", "atnauthor", "ftnsep", "ftnsepc", "aftnsep", "aftnsepc", "listtext", "pntext", "bkmkstart", "bkmkend", "nonshppict", "shpinst", "mmathPr"}
_SYMBOLS = {"tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " "}


def read_rtf(content: bytes, report: Report) -> list[tuple]:
    text = content.decode("latin-1")
    if not text.startswith("{\\rtf"):
        raise Malformed("no RTF header")
    headings = {m[1]: int(m[2]) for m in re.finditer(r"\{\\s(\d+)[^{}]*?heading (\d);?\}", text, re.I)}
    page = re.search(r"\\ansicpg(\d+)", text)
    codec = f"cp{page[1]}" if page else "cp1252"
    stack: list[dict] = []
    now = {"skip": False, "b": False, "i": False, "strike": False, "uc": 1}
    para = {"level": None, "list": None, "ordered": False, "table": False}
    lists, inlines, row, table = _Lists(), [], [], []
    fresh, hop, raw = False, 0, bytearray()
    notes: list[tuple] = []
    outer: list[tuple] = []  # what stands around the notes that are open
    instruction, results = "", []  # of the last field, and the results that are open: depth, place, address

    def end_note() -> None:
        nonlocal lists, inlines, row, table, para
        end_paragraph()
        end_table()
        k, inner = outer[-1][1], lists.result()
        _, _, lists, inlines, row, table, para = outer.pop()
        notes[k] = ("note", notes[k][1], inner)
        inlines.append(("ref", notes[k][1]))

    def put(s: str) -> None:
        if s and not now["skip"]:
            inlines.extend(_wrapped([("text", s)], [k for k, m in (("del", "strike"), ("em", "i"), ("strong", "b")) if now[m]]))

    def flush() -> None:
        nonlocal instruction
        if raw and now.get("field"):
            instruction += raw.decode(codec, "replace")
            raw.clear()
        if raw:
            try:
                put(raw.decode(codec, "replace"))
            except LookupError:
                put(raw.decode("cp1252", "replace"))
            raw.clear()

    def end_table() -> None:
        if table:
            width = max(map(len, table))
            rows = [r + [[]] * (width - len(r)) for r in table]
            lists.put(("table", [""] * width, rows[0], rows[1:]))
            table.clear()

    def end_paragraph() -> None:
        nonlocal inlines
        done, inlines = _merged(inlines), []
        if not done:
            return
        end_table()
        if para["level"]:
            lists.put(("h", min(6, para["level"]), done))
        elif para["list"] is not None:
            lists.add(para["list"], para["ordered"], ("p", done))
        else:
            lists.put(("p", done))

    for m in _RTF.finditer(text):
        word, number, byte, symbol, brace, plain = m.groups()
        if byte is None:
            flush()
        if brace == "{":
            stack.append((dict(now), len(inlines)))
            fresh = True
            continue
        if brace == "}":
            if stack:
                saved, _ = stack.pop()
                now.clear()
                now.update(saved)
            if results and len(stack) < results[-1][0]:
                _, at, address = results.pop()
                if at < len(inlines):
                    inlines[at:] = [("link", address, "", _merged(inlines[at:]))]
            if outer and len(stack) < outer[-1][0]:
                end_note()
            fresh = False
            continue
        if word:
            if word in _SKIPPED:
                now["skip"] = True
            elif word == "fldinst":
                now["skip"], now["field"], instruction = True, True, ""
            elif word == "fldrslt":
                if (address := _link_of(instruction)) is not None and not now["skip"]:
                    results.append((len(stack), len(inlines), address))
            elif word == "footnote" and not now["skip"]:
                notes.append(("note", str(len(notes) + 1), []))
                outer.append((len(stack), len(notes) - 1, lists, inlines, row, table, para))
                lists, inlines, row, table = _Lists(), [], [], []
                para = {"level": None, "list": None, "ordered": False, "table": False}
            elif word == "u" and number:
                put(chr(int(number) & 0xFFFF) if not 0xD800 <= (int(number) & 0xFFFF) < 0xE000 else "\ufffd")
                hop = now["uc"]
            elif word == "uc":
                now["uc"] = int(number or 1)
            elif word in ("b", "i", "strike"):
                now[word] = number != "0"
            elif word == "plain":
                now.update(b=False, i=False, strike=False)
            elif word == "pard":
                para.update(level=None, list=None, ordered=False, table=False)
            elif word == "s" and number in headings:
                para["level"] = headings[number]
            elif word == "outlinelevel" and number and int(number) < 9:
                para["level"] = int(number) + 1
            elif word == "ls" and number != "0":
                para["list"] = para["list"] or 0
                para["ordered"] = number == "2"
            elif word == "ilvl":
                para["list"] = int(number or 0)
            elif word in ("par", "sect", "page"):
                end_paragraph()
            elif word == "line":
                if not now["skip"]:
                    inlines.append(("br",))
            elif word == "cell" or word == "nestcell":
                row.append(_merged(inlines))
                inlines = []
            elif word in ("row", "nestrow"):
                if row:
                    table.append(row)
                row = []
            elif word in _SYMBOLS:
                put(_SYMBOLS[word])
        elif byte:
            if hop:
                hop -= 1
            elif not now["skip"] or now.get("field"):
                raw.append(int(byte, 16))
        elif symbol:
            if symbol == "*" and fresh:
                now["skip"] = True
            elif now.get("field"):
                instruction += symbol if symbol in "\\{}" else ""
            elif symbol in "\\{}":
                put(symbol)
            elif symbol == "~":
                put("\u00a0")
            elif symbol == "_":
                put("\u2011")
        elif plain:
            if hop:
                plain, hop = plain[hop:], max(0, hop - len(plain))
            if now.get("field"):
                instruction += plain
            put(plain)
        fresh = False
    flush()
    while outer:
        end_note()
    end_paragraph()
    end_table()
    return lists.result() + notes


def write_rtf(blocks: list[tuple], report: Report) -> bytes:
    texts = {b[1]: b[2] for b in blocks if b[0] == "note"}

    def text(s: str) -> str:
        out = []
        for c in _clean(s):
            n = ord(c)
            if c in "\\{}":
                out.append("\\" + c)
            elif c == "\t":
                out.append("\\tab ")
            elif c == "\n":
                out.append("\\line ")
            elif n < 128:
                out.append(c)
            else:
                for k in range(0, len(c.encode("utf-16-le")), 2):
                    unit = int.from_bytes(c.encode("utf-16-le")[k : k + 2], "little")
                    out.append(f"\\u{unit - 65536 if unit > 32767 else unit}?")
        return "".join(out)

    def inline(ns: list[tuple]) -> str:
        s = ""
        for n in ns:
            if n[0] == "text":
                s += text(n[1])
            elif n[0] == "code":
                s += "{\\f1 " + text(n[1]) + "}"
            elif n[0] in ("em", "strong", "del"):
                s += "{\\" + {"em": "i", "strong": "b", "del": "strike"}[n[0]] + " " + inline(n[1]) + "}"
            elif n[0] == "link":
                s += '{\\field{\\*\\fldinst HYPERLINK "' + text(n[1]) + '"}{\\fldrslt ' + inline(n[3]) + "}}"
            elif n[0] == "img":
                report.loss("pictures become their descriptions")
                s += inline(n[3])
            elif n[0] == "br":
                s += "\\line "
            elif n[0] == "soft":
                s += " "
            elif n[0] == "ref":
                s += "{\\super\\chftn}{\\footnote " + walk(texts.pop(n[1])) + "}" if n[1] in texts else text(f"[{n[1]}]")
            else:
                report.loss("raw HTML is dropped")
        return s

    def walk(bs: list[tuple], props: str = "", level: int = 0) -> str:
        s = ""
        for b in bs:
            kind = b[0]
            if kind == "p":
                s += f"\\pard{props} {inline(b[1])}\\par\n"
            elif kind == "h":
                s += f"\\pard\\s{b[1]}\\outlinelevel{b[1] - 1} {inline(b[2])}\\par\n"
            elif kind == "code":
                s += "\\pard{\\f1 " + text(b[2].removesuffix("\n")) + "}\\par\n"
            elif kind == "quote":
                s += walk(b[1], props + "\\li720", level)
            elif kind == "hr":
                s += "\\pard\\brdrb\\brdrs\\par\n"
            elif kind == "list":
                for task, inner in b[3]:
                    for x in inner:
                        if x[0] == "p":
                            box = "" if task is None else "\\u9746? " if task else "\\u9744? "
                            s += f"\\pard\\ls{1 if b[1] is None else 2}\\ilvl{level} {box}{inline(x[1])}\\par\n"
                        else:
                            s += walk([x], props, level + 1)
            elif kind == "table":
                for r in [b[2], *b[3]]:
                    s += "\\trowd" + "".join(f"\\cellx{2000 * (k + 1)}" for k in range(len(r))) + "".join(f"\\pard\\intbl {inline(c)}\\cell" for c in r) + "\\row\n"
            else:
                report.loss("raw HTML is dropped")
        return s

    styles = "{\\stylesheet{\\s0 Normal;}" + "".join(f"{{\\s{k}\\b heading {k};}}" for k in range(1, 7)) + "}"
    return ("{\\rtf1\\ansi\\ansicpg1252\\uc1\\deff0{\\fonttbl{\\f0 Times New Roman;}{\\f1\\fmodern Courier New;}}\n" + styles + "\n" + walk([b for b in blocks if b[0] != "note"]) + "}\n").encode("ascii")


READERS = {"docx": read_docx, "odt": read_odt, "epub": read_epub, "rtf": read_rtf}
WRITERS = {"docx": write_docx, "odt": write_odt, "epub": write_epub, "rtf": write_rtf}
