"""Documents as nested blocks: text, Markdown and HTML to blocks, and blocks to Markdown, HTML, text and JSON.

Blocks: ("p", inlines), ("h", level, inlines), ("code", info, text), ("quote", blocks), ("list", start or None, tight,
[(task, blocks)]), ("table", aligns, head, rows) with cells of inlines, ("hr",), ("html", text), and at the document's end ("note", label, blocks). Inlines: ("text", s),
("code", s), ("em" | "strong" | "del", inlines), ("link" | "img", address, title, inlines), ("br",), ("soft",), ("html", s), ("ref", label).
"""

from __future__ import annotations

import html as entities
import json
import re
from html.entities import html5
from urllib.parse import quote

# text


def read_text(text: str) -> list[tuple]:
    """A paragraph for each run of lines that aren't blank."""
    out, lines = [], []
    for line in [*text.split("\n"), ""]:
        line = line.removesuffix("\r")
        if line.strip(" \t\r\n\f\v"):
            lines.append(line)
        elif lines:
            inlines: list[tuple] = []
            for k, s in enumerate(lines):
                inlines += [("soft",)] * (k > 0) + [("text", s)]
            out.append(("p", inlines))
            lines = []
    return out


# Markdown blocks

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( {1,4}(?! )| (?= {4}))|[ \t]*$)")
_REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
_NOTE = re.compile(r" {0,3}\[\^([^\]\[\s]+)\]:[ \t]*")
_IS_NOTE = "\0note"
_HTML_BLOCK = re.compile(r" {0,3}<(?:(?:script|pre|style|textarea)(?:[\s>]|$)|!--|\?|![A-Za-z]|!\[CDATA\[|/?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$))", re.I)
_HTML_ENDS = [(re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r" {0,3}<!--"), re.compile("-->")), (re.compile(r" {0,3}<\?"), re.compile(r"\?>")), (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")), (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">"))]
_LONE_TAG = re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$")
_DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    parts = re.split(r"(?<!\\)\|", line)
    if parts and not parts[-1].strip():
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


class _Blocks:
    def __init__(self) -> None:
        self.references: dict[str, tuple[str, str]] = {}
        self.notes: dict[str, tuple[str, list[tuple]]] = {}

    def parse(self, lines: list[str]) -> list[tuple]:
        return self._parse(lines)[0]

    def _parse(self, lines: list[str]) -> tuple[list[tuple], bool]:
        """Blocks, and whether a blank line stands between any two of them."""
        out: list[tuple] = []
        paragraph: list[str] = []
        k, first, gapped = 0, next((k for k, s in enumerate(lines) if s.strip()), 0), False

        def close() -> None:
            if not paragraph:
                return
            text = "\n".join(s.lstrip(" \t") for s in paragraph)
            while m := _REFERENCE.match(text):
                address = m[2][1:-1] if m[2].startswith("<") else m[2]
                self.references.setdefault(_label(m[1]), (_unescape(address), _unescape(m[3][1:-1]) if m[3] else ""))
                text = text[m.end() :]
            if text.strip():
                out.append(("p", text.rstrip(" \t")))
            paragraph.clear()

        while k < len(lines):
            line = lines[k]
            blank = not line.strip()
            gapped |= not blank and k > first and not lines[k - 1].strip()
            if blank:
                close()
                k += 1
            elif _indent(line) >= 4 and not paragraph:
                code = []
                while k < len(lines) and (_indent(lines[k]) >= 4 or not lines[k].strip()):
                    code.append(lines[k][4:])
                    k += 1
                while code and not code[-1].strip():
                    code.pop()
                out.append(("code", "", "\n".join(code) + "\n"))
            elif m := _NOTE.match(line):
                close()
                inner, k = [line[m.end() :]], k + 1
                while k < len(lines) and (not lines[k].strip() or _indent(lines[k]) >= 4 or inner[-1].strip() and not self._starts(lines[k]) and not _NOTE.match(lines[k])):
                    inner.append(lines[k][min(4, _indent(lines[k])) :])
                    k += 1
                if _label(m[1]) not in self.notes:
                    self.references["^" + _label(m[1])] = ("", _IS_NOTE)
                    self.notes[_label(m[1])] = (m[1], [])
                    self.notes[_label(m[1])] = (m[1], self.parse(inner))
            elif (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
                close()
                code, k = [], k + 1
                while k < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", lines[k]):
                    code.append(lines[k][min(_indent(lines[k]), len(m[1])) :])
                    k += 1
                k += 1
                out.append(("code", _unescape(m[3]), "".join(s + "\n" for s in code)))
            elif m := _ATX.match(line):
                close()
                out.append(("h", len(m[1]), (m[2] or "").strip().rstrip("#").strip() if set(m[2] or "#") == {"#"} else m[2].strip()))
                k += 1
            elif paragraph and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)):
                before = len(out)
                close()
                if len(out) > before and out[-1][0] == "p":
                    out[-1] = ("h", 1 if m[1][0] == "=" else 2, out[-1][1])
                elif m[1][0] == "=" or len(m[1]) < 3:
                    paragraph.append(line)
                else:
                    out.append(("hr",))
                k += 1
            elif _RULE.match(line):
                close()
                out.append(("hr",))
                k += 1
            elif re.match(r" {0,3}>", line):
                close()
                inner, goes_on = [], None
                while k < len(lines):
                    if m := re.match(r" {0,3}> ?", lines[k]):
                        inner.append(lines[k][m.end() :])
                        goes_on = None
                    elif not lines[k].strip() or self._starts(lines[k]) or not (self._in_paragraph(inner) if goes_on is None else goes_on):
                        break
                    else:
                        inner.append(self._lazy(lines[k]))
                        goes_on = True
                    k += 1
                out.append(("quote", self.parse(inner)))
            elif (m := _ITEM.match(line)) and (not paragraph or (line[m.end() :].strip() and (m[2] in "-+*" or m[2][:-1] == "1"))):
                close()
                k = self._list(lines, k, out)
            elif _HTML_BLOCK.match(line) or (not paragraph and _LONE_TAG.match(line)):
                close()
                end = next((e for s, e in _HTML_ENDS if s.match(line)), None)
                raw = []
                while k < len(lines):
                    if end is None and not lines[k].strip():
                        break
                    raw.append(lines[k])
                    k += 1
                    if end is not None and end.search(raw[-1]):
                        break
                out.append(("html", "".join(s + "\n" for s in raw)))
            elif k + 1 < len(lines) and "|" in line + lines[k + 1] and _DELIMITERS.match(lines[k + 1]) and len(_cells(line)) == len(_cells(lines[k + 1])):
                close()
                aligns = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":")), "") for c in _cells(lines[k + 1])]
                head, rows, k = _cells(line), [], k + 2
                while k < len(lines) and lines[k].strip() and not self._starts(lines[k]):
                    row = _cells(lines[k])
                    rows.append((row + [""] * len(head))[: len(head)])
                    k += 1
                out.append(("table", aligns, head, rows))
            else:
                paragraph.append(line)
                k += 1
        close()
        return out, gapped

    @staticmethod
    def _in_paragraph(lines: list[str]) -> bool:
        """Whether the lines end inside a paragraph, which a line without marks may continue."""
        fence, inside = None, False
        for line in lines:
            if fence:
                if re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line):
                    fence = None
                continue
            while m := re.match(r" {0,3}> ?", line) or (not inside or line[:1] != " ") and _ITEM.match(line):
                line, inside = line[m.end() :], False
            if m := _FENCE.match(line):
                fence, inside = m[2], False
            elif not line.strip() or _ATX.match(line) or _RULE.match(line):
                inside = False
            elif not inside:
                inside = _indent(line) < 4
        return inside and not fence

    def _starts(self, line: str) -> bool:
        return bool(_ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or re.match(r" {0,3}>", line) or _ITEM.match(line) or _HTML_BLOCK.match(line))

    @staticmethod
    def _lazy(line: str) -> str:
        """A line that only continues a paragraph, as it must stand to do no more than that."""
        if _indent(line) >= 4:
            return line
        line = line.lstrip()
        return "\\" + line if re.match(r"=+[ \t]*$", line) else line

    def _list(self, lines: list[str], k: int, out: list[tuple]) -> int:
        first = _ITEM.match(lines[k])
        kind = first[2] if first[2] in "-+*" else first[2][-1]
        items, loose = [], False
        while k < len(lines):
            m = _ITEM.match(lines[k])
            if not m or (m[2] if m[2] in "-+*" else m[2][-1]) != kind or _RULE.match(lines[k]):
                break
            width = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] else 1)
            inner, k = [lines[k][width:]], k + 1
            empty, goes_on = not inner[0].strip(), None
            while k < len(lines):
                if not lines[k].strip():
                    if empty and len(inner) == 1:
                        break
                    inner.append("")
                    goes_on = None
                elif _indent(lines[k]) >= width:
                    inner.append(lines[k][width:])
                    goes_on = None
                elif inner[-1].strip() and not self._starts(lines[k]) and (self._in_paragraph(inner) if goes_on is None else goes_on):
                    inner.append(self._lazy(lines[k]))
                    goes_on = True
                else:
                    break
                k += 1
            gap = 0
            while inner and not inner[-1].strip():
                inner.pop()
                gap += bool(inner)  # the mark's own line is no blank one
            while k < len(lines) and not lines[k].strip():
                gap, k = gap + 1, k + 1
            task = re.match(r"\[([ xX])\][ \t]+(?=\S)", inner[0]) if inner else None
            if task:
                inner[0] = inner[0][task.end() :]
            blocks, gapped = self._parse(inner)
            items.append((None if not task else task[1] != " ", blocks))
            again = k < len(lines) and (n := _ITEM.match(lines[k])) and (n[2] if n[2] in "-+*" else n[2][-1]) == kind and not _RULE.match(lines[k])
            loose |= bool(gap and again) or gapped
        out.append(("list", None if kind in "-+*" else int(first[2][:-1]), not loose, items))
        return k


def _label(s: str) -> str:
    return re.sub(r"\s+", " ", s.strip()).casefold()


def _unescape(s: str) -> str:
    return entities.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: entities.escape(m[1], quote=False) if m[1] in "&<>" else m[1], s)) if "\\" in s or "&" in s else s


# Markdown inlines

_TOKEN = re.compile(
    r"""(?P<escape>\\[!-/:-@\[-`{-~])|(?P<hard>(?:\ {2,}|\\)\n\ *)|(?P<soft>\ ?\n\ *)|(?P<ticks>`+)|(?P<auto><(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>)
    |(?P<tag><(?:[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?|/[A-Za-z][\w-]*\s*|!--[\s\S]*?--|\?[\s\S]*?\?|![A-Za-z][^>]*|!\[CDATA\[[\s\S]*?\]\])>)
    |(?P<entity>&(?:\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)|(?P<run>\*+|_+|~+)|(?P<open>!?\[)|(?P<close>\])|(?P<url>(?<![\w/])(?:https?://|ftp://|www\.)[^\s<]+)|(?P<mail>(?<![\w.+-])(?:mailto:|xmpp:)?[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?:(?<=[\w])/[\w.@]*[\w@])?)""",
    re.X,
)
_BARE = r"(?:[^\s()\\]|\\.)*"
for _ in range(6):  # brackets in brackets
    _BARE = rf"(?:[^\s()\\]|\\.|\({_BARE}\))*"
_TARGET = re.compile(rf"""\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|({_BARE}))(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""")


def _inlines(text: str, references: dict[str, tuple[str, str]]) -> list[tuple]:
    nodes: list = []  # finished inlines, or lists: delimiter runs and brackets
    opened: list[int] = []  # places of the brackets that are open
    at = 0

    def put(s: str) -> None:
        if s:
            nodes.append(("text", s))

    while at < len(text):
        m = _TOKEN.search(text, at)
        if not m:
            put(text[at:])
            break
        put(text[at : m.start()])
        kind, s, at = m.lastgroup, m[0], m.end()
        if kind == "escape":
            put(s[1])
        elif kind == "hard":
            nodes.append(("br",))
        elif kind == "soft":
            nodes.append(("soft",))
        elif kind == "ticks":
            end = re.compile(rf"(?<!`){s}(?!`)").search(text, at)
            if end:
                code = text[at : end.start()].replace("\n", " ")
                nodes.append(("code", code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code))
                at = end.end()
            else:
                put(s)
        elif kind == "auto":
            nodes.append(("link", s[1:-1] if ":" in s.split("@")[0] else "mailto:" + s[1:-1], "", [("text", s[1:-1])]))
        elif kind == "url":
            if opened:  # a text in brackets ends with them
                s = s.split("]")[0]
            link = _bare(s)
            at = m.start() + len(link or s[:3])
            put(s[:3]) if not link else nodes.append(("link", ("http://" if link.startswith("www.") else "") + link, "", [("text", link)]))
        elif kind == "mail":
            if "/" in s and not s.startswith("xmpp:"):  # only these have a part behind a slash
                s = s[: s.index("/")]
                at = m.start() + len(s)
            if s[-1] in "-_":
                put(s)
            else:
                nodes.append(("link", s if s.startswith(("mailto:", "xmpp:")) else "mailto:" + s, "", [("text", s)]))
        elif kind == "tag":
            nodes.append(("html", s))
        elif kind == "entity":
            put(entities.unescape(s))
        elif kind == "run":
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
            right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
            if s[0] == "_":
                left, right = left and (not right or _punctuation(before)), right and (not left or _punctuation(after))
            nodes.append([s[0], len(s), left, right, len(s)])
        elif kind == "open":
            opened.append(len(nodes))
            nodes.append([s, at])
        else:
            if not opened:
                put("]")
                continue
            start = opened.pop()
            mark, inside = nodes[start][0], text[nodes[start][1] : m.start()]
            if references.get(_label(inside), ("", ""))[1] == _IS_NOTE:
                nodes[start:] = [("text", mark[:-1])] * (mark == "![") + [("ref", _label(inside[1:]))]
                continue
            target, end = None, at
            if t := _TARGET.match(text, at):
                target, end = (_unescape(t[1] if t[1] is not None else t[2]), _unescape(t[3][1:-1]) if t[3] else ""), t.end()
            elif (t := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, at)) and (_label(t[1]) or _label(inside)) in references:
                target, end = references[_label(t[1]) or _label(inside)], t.end()
            elif _label(inside) in references:
                target = references[_label(inside)]
            if target is None:
                nodes[start] = ("text", mark)
                put("]")
                continue
            inner = _emphasis(nodes[start + 1 :])
            if mark == "[":  # a link holds no links
                inner = _joined([x for n in inner for x in (n[3] if n[0] == "link" else [n])])
            nodes[start:] = [("img" if mark == "![" else "link", *target, inner)]
            if mark == "[":
                for k in opened:
                    if nodes[k][0] == "[":
                        nodes[k] = ("text", "[")
                opened = [k for k in opened if isinstance(nodes[k], list)]
            at = end
    return _emphasis(nodes)


def _bare(s: str) -> str | None:
    """The part of a bare address that is a link: no trailing marks, brackets in pairs, a host without underscores at its end."""
    while s:
        if s[-1] in "?!.,:*_~'\"":
            s = s[:-1]
        elif s[-1] == ")" and s.count(")") > s.count("("):
            s = s[:-1]
        elif s[-1] == ";" and (m := re.search(r"&[A-Za-z0-9]+;$", s)):
            s = s[: m.start()]
        else:
            break
    host = re.match(r"(?:https?://|ftp://)?([^/?#\s]*)", s)[1].split(".")
    return s if (len(host) > 1 or "://" in s) and host[-1] and not any("_" in x for x in host[-2:]) else None


def _punctuation(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] in "PS"


def _emphasis(nodes: list) -> list[tuple]:
    nodes = [("text", n[0]) if isinstance(n, list) and n[0] in ("[", "![") else n for n in nodes]
    k = 0
    while k < len(nodes):
        closer = nodes[k]
        if not isinstance(closer, list) or not closer[3]:
            k += 1
            continue
        for j in range(k - 1, -1, -1):
            opener = nodes[j]
            if isinstance(opener, list) and opener[0] == closer[0] and opener[2] and opener[1]:
                if closer[0] != "~" and (closer[2] or opener[3]) and (opener[4] + closer[4]) % 3 == 0 and not (opener[4] % 3 == 0 and closer[4] % 3 == 0):
                    continue
                if closer[0] == "~":
                    if opener[1] != closer[1] or closer[1] > 2:
                        continue
                    use, kind = closer[1], "del"
                else:
                    use = 2 if opener[1] >= 2 and closer[1] >= 2 else 1
                    kind = "strong" if use == 2 else "em"
                inner = [x if not isinstance(x, list) else ("text", x[0] * x[1]) for x in nodes[j + 1 : k]]
                opener[1] -= use
                closer[1] -= use
                nodes[j + 1 : k] = [(kind, _joined(inner))]
                k = j + 2
                if not opener[1]:
                    del nodes[j]
                    k -= 1
                if not closer[1]:
                    del nodes[k]
                break
        else:
            k += 1
    return _joined([("text", x[0] * x[1]) if isinstance(x, list) else x for x in nodes])


def _joined(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for n in nodes:
        if n[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
        elif n != ("text", ""):
            out.append(n)
    return out


_MARGIN = re.compile(r"[ \t]*(?:(?:[-+*>]|\d{1,9}[.)])[ \t]+)*")


def _untabbed(line: str) -> str:
    """Tabs before a line's text, marks of lists and quotes included, as blanks up to the next fourth column."""
    if "\t" not in line:
        return line
    margin = _MARGIN.match(line)[0]
    return margin.expandtabs(4) + line[len(margin) :]


def read_markdown(text: str) -> list[tuple]:
    parser = _Blocks()
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    blocks = parser.parse([_untabbed(line) for line in (lines[:-1] if not lines[-1] else lines)])

    def finish(block: tuple) -> tuple:
        kind = block[0]
        if kind == "p":
            return ("p", _inlines(block[1], parser.references))
        if kind == "h":
            return ("h", block[1], _inlines(block[2], parser.references))
        if kind == "quote":
            return ("quote", [finish(b) for b in block[1]])
        if kind == "list":
            return ("list", block[1], block[2], [(task, [finish(b) for b in inner]) for task, inner in block[3]])
        if kind == "table":
            line = lambda cells: [_inlines(c, parser.references) for c in cells]
            return ("table", block[1], line(block[2]), [line(r) for r in block[3]])
        return block

    out, order, k = [finish(b) for b in blocks], [], 0
    _refs(out, order)
    notes = []
    while k < len(order):  # notes refer to notes
        label, inner = parser.notes[order[k]]
        notes.append(("note", order[k], [finish(b) for b in inner]))
        _refs(notes[-1][2], order)
        k += 1
    return out + notes


def _refs(v, order: list[str]) -> None:
    """Labels of notes in the order of their first references."""
    if isinstance(v, tuple) and v and v[0] == "ref":
        if v[1] not in order:
            order.append(v[1])
    elif isinstance(v, tuple | list):
        for x in v:
            _refs(x, order)


# HTML

_SKIP = {"script", "style", "head", "title", "template", "svg", "math", "iframe", "noscript", "select", "textarea", "canvas", "video", "audio", "object"}
_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_BREAKING = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "address", "figure", "figcaption", "dl", "dt", "dd", "form", "fieldset", "body", "html", "center", "details", "summary", "hgroup"}
_FORMATS = {"b": "strong", "strong": "strong", "i": "em", "em": "em", "cite": "em", "var": "em", "dfn": "em", "del": "del", "s": "del", "strike": "del"}


#: A tag, a comment, a declaration or a processing instruction. A < that begins none of them is text.
_MARKUP = re.compile(r"""<(?:(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|!--(?:-?>|[\s\S]*?(?:--!?>|\Z))|[!?/][^>]*>)""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Tags whose attributes matter, and those whose content is not markup.
_WITH_ATTRIBUTES = {"a", "img", "ol", "td", "th"}
_RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
#: Runs of white space other than one blank.
_BLANKS = re.compile(r" *[\t\r\n\f][ \t\r\n\f]*| {2,}")


class _Html:
    """Tag soup to blocks. A frame is [tag, kind, content, data]."""

    def __init__(self) -> None:
        self.frames: list[list] = [["", "blocks", [], None]]
        self.skipping = ""

    def feed(self, text: str) -> None:
        at, find = 0, _MARKUP.search
        while m := find(text, at):
            if m.start() > at and not self.skipping:
                self.handle_data(_entities(text[at : m.start()]))
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self.handle_endtag(tag)
            elif self.skipping:
                continue
            elif m[3].endswith("/"):
                self.handle_startendtag(tag, _attributes(m[3]) if tag in _WITH_ATTRIBUTES else {})
            else:
                self.handle_starttag(tag, _attributes(m[3]) if tag in _WITH_ATTRIBUTES else {})
                if tag in _RAW:  # what it holds ends with its end tag only
                    end = _RAW_ENDS[tag].search(text, at)
                    at = end.start() if end else len(text)
        if at < len(text) and not self.skipping:
            self.handle_data(_entities(text[at:]))

    # text of the innermost open paragraph
    def _inline(self) -> list:
        top = self.frames[-1]
        if top[1] != "inline":
            if top[1] in ("list", "table", "rows"):
                return []
            self.frames.append(["", "inline", [], ("p",)])
            top = self.frames[-1]
        return top[2]

    def _close_inline(self) -> None:
        while self.frames[-1][1] == "inline":
            self._pop()

    def _pop(self) -> None:
        tag, kind, content, data = self.frames.pop()
        if not self.frames:
            self.frames.append([tag, kind, content, data])
            return
        parent = self.frames[-1]
        if kind == "inline":
            if data[0] in ("p", "h"):
                while content and content[-1][0] in ("br", "soft") or content and content[-1] == ("text", ""):
                    content.pop()
                if content and content[-1][0] == "text":
                    content[-1] = ("text", content[-1][1].rstrip(" "))
                content = _joined(content)
                if content:
                    (parent[2] if parent[1] in ("blocks", "item", "cell", "quote") else self.frames[0][2]).append((*data, content))
            else:
                inner = _joined(content)
                if inner and inner[-1][0] == "br":
                    inner.pop()
                if inner or data[0] == "img":
                    parent[2].append((*data, inner))
        elif kind == "list":
            if content:
                parent[2].append(("list", data, all(len(b) < 2 or all(x[0] in ("p", "list") for x in b) and sum(x[0] == "p" for x in b) < 2 for _, b in content), content))
        elif kind == "item":
            parent[2].append((None, content))
        elif kind == "quote":
            parent[2].append(("quote", content))
        elif kind == "cell":
            parent[2].append((self._flat(content), *data))
        elif kind == "rows":
            parent[2].append(content)
        elif kind == "table":
            if table := _spanned([r for r in content if isinstance(r, list)]):
                width = max(map(len, table))
                rows = [r + [[]] * (width - len(r)) for r in table]
                parent[2].append(("table", [""] * width, rows[0], rows[1:]))
        elif kind == "pre":
            parent[2].append(("code", data or "", "".join(content).removeprefix("\n").rstrip("\n") + "\n"))

    def _flat(self, blocks: list) -> list[tuple]:
        out: list[tuple] = []
        for b in blocks:
            inner = b[-1] if b[0] in ("p", "h") else [("text", " ".join(write_text([b]).split()))]
            out += [("text", " ")] * bool(out and inner) + inner
        return _joined(out)

    def _in(self, *kinds: str) -> bool:
        return any(f[1] in kinds for f in self.frames)

    def handle_starttag(self, tag, a):
        if self.skipping:
            return
        if self.frames[-1][1] == "pre":
            return
        if tag in _SKIP:
            self.skipping = tag
        elif tag in _HEADINGS:
            self._close_inline()
            self.frames.append([tag, "inline", [], ("h", _HEADINGS[tag])])
        elif tag in _BREAKING:
            self._close_inline()
        elif tag in ("ul", "ol", "menu"):
            self._close_inline()
            start = a.get("start", "1")
            self.frames.append([tag, "list", [], (int(start) if start.isdigit() else 1) if tag == "ol" else None])
        elif tag == "li":
            self._close_inline()
            if any(f[1] == "item" for f in self.frames):
                last = max(k for k, f in enumerate(self.frames) if f[1] in ("item", "list"))
                if self.frames[last][1] == "item":
                    while len(self.frames) > last:
                        self._pop()
            if self.frames[-1][1] != "list":
                self.frames.append(["ul", "list", [], None])
            self.frames.append([tag, "item", [], None])
        elif tag == "blockquote":
            self._close_inline()
            self.frames.append([tag, "quote", [], None])
        elif tag == "pre":
            self._close_inline()
            self.frames.append([tag, "pre", [], None])
        elif tag == "hr":
            self._close_inline()
            if self.frames[-1][1] in ("blocks", "item", "cell", "quote"):
                self.frames[-1][2].append(("hr",))
        elif tag == "br":
            inline = self._inline()
            if inline and inline[-1][0] == "text":
                inline[-1] = ("text", inline[-1][1].rstrip(" "))
            inline.append(("br",))
        elif tag == "table":
            self._close_inline()
            if not self._in("table"):
                self.frames.append([tag, "table", [], None])
        elif tag == "tr" and self._in("table"):
            self._to("table")
            self.frames.append([tag, "rows", [], None])
        elif tag in ("td", "th") and self._in("table"):
            last = max(k for k, f in enumerate(self.frames) if f[1] in ("table", "rows"))
            while len(self.frames) > last + 1:
                self._pop()
            if self.frames[-1][1] == "table":
                self.frames.append(["tr", "rows", [], None])
            span = lambda k: min(1000, max(1, int(a[k]))) if a.get(k, "").isdigit() else 1
            self.frames.append([tag, "cell", [], (span("colspan"), span("rowspan"))])
        elif tag == "a":
            self._inline()
            self.frames.append([tag, "inline", [], ("link", a.get("href", ""), a.get("title", ""))])
        elif tag == "img":
            self._inline().append(("img", a.get("src", ""), a.get("title", ""), [("text", a["alt"])] if a.get("alt") else []))
        elif tag in _FORMATS:
            self._inline()
            self.frames.append([tag, "inline", [], (_FORMATS[tag],)])
        elif tag in ("code", "kbd", "samp", "tt"):
            self._inline()
            self.frames.append([tag, "inline", [], ("span", tag)])
        elif tag == "q":
            self._inline().append(("text", '"'))

    def _to(self, kind: str) -> None:
        while self.frames[-1][1] != kind:
            self._pop()

    def handle_startendtag(self, tag, a):
        self.handle_starttag(tag, a)
        if self.skipping == tag:
            self.skipping = ""
        elif tag not in ("br", "hr", "img"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping:
                self.skipping = ""
            return
        if tag == "q":
            self._inline().append(("text", '"'))
            return
        if tag in _BREAKING or tag in _HEADINGS:
            if self.frames[-1][1] != "pre":
                self._close_inline()
            return
        if any(f[0] == tag for f in self.frames):
            while self.frames[-1][0] != tag:
                self._pop()
            top = self.frames[-1]
            if top[1] == "inline" and top[3][0] == "span":
                self.frames.pop()
                text = "".join(n[1] for n in top[2] if n[0] in ("text", "code"))
                if text:
                    self._inline().append(("code", text))
            else:
                self._pop()

    def handle_data(self, data):
        if self.skipping:
            return
        top = self.frames[-1]
        if top[1] == "pre":
            top[2].append(data)
            return
        if top[1] != "inline" and not data.strip() or top[1] in ("list", "table", "rows"):
            return
        inline = self._inline()
        text = _BLANKS.sub(" ", data)
        if text.startswith(" ") and self._at_blank():
            text = text[1:]
        if text:
            inline.append(("text", text))

    def _at_blank(self) -> bool:
        """Whether what stands before is the block's start, a break or a blank."""
        for f in reversed(self.frames):
            if f[1] != "inline":
                return True
            if f[2]:
                last = f[2][-1]
                while last[0] in ("em", "strong", "del", "link") and last[-1]:
                    last = last[-1][-1]
                return last[0] == "br" or last[0] == "text" and last[1].endswith(" ")
        return True

    def result(self) -> list[tuple]:
        while len(self.frames) > 1:
            self._pop()
        return self.frames[0][2]


_CHARACTER = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _entities(text: str) -> str:
    """Character references that end in a semicolon; others, and unknown names, stay as written."""
    known = lambda m: entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return _CHARACTER.sub(known, text) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a tag; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), _entities(m[2] or m[3] or m[4] or ""))
    return out


def _spanned(rows: list[list]) -> list[list]:
    """Cells laid out by their spans; the places that spans cover are empty."""
    out: list[list] = []
    held: dict[tuple[int, int], bool] = {}
    for r, row in enumerate(rows):
        line, c = [], 0
        for content, columns, lines in row:
            while held.get((r, c)):
                line.append([])
                c += 1
            for k in range(columns):
                line.append(content if not k else [])
                for d in range(1, lines):
                    held[r + d, c + k] = True
            c += columns
        out.append(line)
    return [r for r in out if r]


def read_html(text: str) -> list[tuple]:
    parser = _Html()
    parser.feed(text)
    return parser.result()


# writers


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def address(s: str) -> str:
    return quote(s, safe="-_.+!*'(),%#@?=;:/,+&$~[]").replace("&", "&amp;").replace("'", "&#x27;")


def _plain(inlines: list[tuple]) -> str:
    return "".join(n[1] if n[0] in ("text", "code") else " " if n[0] == "soft" else "\n" if n[0] == "br" else _plain(n[-1]) if isinstance(n[-1], list) else "" for n in inlines)


_FILTERED = re.compile(r"<(?=/?(?:title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext)[\s/>])", re.I)


class _Notes:
    """Numbers of notes and their references so far."""

    def __init__(self, blocks: list[tuple]):
        self.number = {b[1]: k for k, b in enumerate((b for b in blocks if b[0] == "note"), 1)}
        self.count = dict.fromkeys(self.number, 0)

    def ref(self, label: str) -> str:
        self.count[label] += 1
        to, again = address(label), f"-{self.count[label]}" if self.count[label] > 1 else ""
        return f'<sup class="footnote-ref"><a href="#fn-{to}" id="fnref-{to}{again}" data-footnote-ref>{self.number[label]}</a></sup>'

    def back(self, label: str) -> str:
        out, to = [], address(label)
        for k in range(1, self.count[label] + 1):
            again, mark = (f"-{k}", f'<sup class="footnote-ref">{k}</sup>') if k > 1 else ("", "")
            index = f"{self.number[label]}{again}"
            out.append(f'<a href="#fnref-{to}{again}" class="footnote-backref" data-footnote-backref data-footnote-backref-idx="{index}" aria-label="Back to reference {index}">↩{mark}</a>')
        return " ".join(out)


def _html_inline(inlines: list[tuple], notes: _Notes | None = None) -> str:
    out = []
    for n in inlines:
        kind = n[0]
        if kind == "ref":
            out.append(notes.ref(n[1]) if notes and n[1] in notes.number else escape(f"[^{n[1]}]"))
        elif kind == "text":
            out.append(escape(n[1]))
        elif kind == "code":
            out.append(f"<code>{escape(n[1])}</code>")
        elif kind in ("em", "strong", "del"):
            out.append(f"<{kind}>{_html_inline(n[1], notes)}</{kind}>")
        elif kind in ("link", "img"):
            title = f' title="{escape(n[2])}"' if n[2] else ""
            out.append(f'<a href="{address(n[1])}"{title}>{_html_inline(n[3], notes)}</a>' if kind == "link" else f'<img src="{address(n[1])}" alt="{escape(_plain(n[3]))}"{title} />')
        else:
            out.append({"br": "<br />\n", "soft": "\n"}.get(kind) or _FILTERED.sub("&lt;", n[1]))
    return "".join(out)


def write_html(blocks: list[tuple], tight: bool = False, notes: _Notes | None = None) -> str:
    out = []
    notes = notes or _Notes(blocks)
    texts = [b for b in blocks if b[0] == "note"]
    for k, b in enumerate(blocks):
        kind = b[0]
        if kind == "note":
            continue
        if kind == "p":
            out.append(_html_inline(b[1], notes) + ("\n" if k + 1 < len(blocks) else "") if tight else f"<p>{_html_inline(b[1], notes)}</p>\n")
        elif kind == "h":
            out.append(f"<h{b[1]}>{_html_inline(b[2], notes)}</h{b[1]}>\n")
        elif kind == "code":
            language = f' class="language-{escape(b[1].split()[0])}"' if b[1] else ""
            out.append(f"<pre><code{language}>{escape(b[2])}</code></pre>\n")
        elif kind == "quote":
            out.append(f"<blockquote>\n{write_html(b[1], False, notes)}</blockquote>\n")
        elif kind == "hr":
            out.append("<hr />\n")
        elif kind == "html":
            out.append(_FILTERED.sub("&lt;", b[1]))
        elif kind == "list":
            name = "ul" if b[1] is None else "ol"
            out.append(f"<{name}" + (f' start="{b[1]}"' if b[1] not in (None, 1) else "") + ">\n")
            for task, inner in b[3]:
                box = "" if task is None else f'<input type="checkbox"{" checked=" + chr(34) * 2 if task else ""} disabled="" /> '
                body = write_html(inner, b[2], notes)
                out.append(f"<li>{box}" + ("\n" if body and (not b[2] or inner[0][0] != "p") else "") + body + "</li>\n")
            out.append(f"</{name}>\n")
        elif kind == "table":
            cell = lambda tag, c, a: f"<{tag}" + (f' align="{a}"' if a else "") + f">{_html_inline(c, notes)}</{tag}>\n"
            out.append("<table>\n<thead>\n<tr>\n" + "".join(cell("th", c, a) for c, a in zip(b[2], b[1], strict=False)) + "</tr>\n</thead>\n")
            if b[3]:
                out.append("<tbody>\n" + "".join("<tr>\n" + "".join(cell("td", c, a) for c, a in zip(r, b[1], strict=False)) + "</tr>\n" for r in b[3]) + "</tbody>\n")
            out.append("</table>\n")
    if texts:
        items = []
        for _, label, inner in texts:
            body = write_html(inner, False, notes)
            back = notes.back(label)
            body = f"{body.removesuffix('</p>' + chr(10))} {back}</p>\n" if inner and inner[-1][0] == "p" else f"{body}{back}\n"
            items.append(f'<li id="fn-{address(label)}">\n{body}</li>\n')
        out.append('<section class="footnotes" data-footnotes>\n<ol>\n' + "".join(items) + "</ol>\n</section>\n")
    return "".join(out)


_MARKS = re.compile(r"[\\`*_\[\]<>~|]|&(?=#?\w+;)")
_LAST_HASHES = re.compile(r"(#+)$")


#: A bare address that would take in the escape of a mark, or a reference in place of a blank.
_ADDRESS = re.compile(r"(?<![\w/])(https?|ftp|www)(?=(?:://|\.)\S*(?:\\|[^\S\n]$))", re.M)


def _md_text(s: str) -> str:
    s = _MARKS.sub(lambda m: "\\" + m[0], s)
    if "://" in s or "www." in s:
        s = _ADDRESS.sub(r"\1\\", s)
    return s.replace("\r", "&#13;") if "\r" in s else s


def markdown_rows(header: list[str], rows: list[list[str]]) -> str:
    """A table of plain cells, without a line end."""

    def line(cells: list[str]) -> str:
        text = " | ".join([c if c.isalnum() else _md_text(" ".join(c.split("\n")).replace("\r", "").strip()) for c in cells])
        return f"| {text} |"

    return "\n".join([line(header), "| " + " | ".join(["---"] * len(header)) + " |", *map(line, rows)])


def markdown_heading(name: str) -> str:
    return write_markdown([("h", 1, [("text", name)])]).rstrip("\n")


_BLANK = r"[ \t\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space at the ends of lines, which readers drop.
_EDGE = re.compile(rf"^{_BLANK}|{_BLANK}$", re.M)


def _md_inline(inlines: list[tuple], cell: bool = False, lines: bool = False) -> str:
    """Inlines as Markdown; lines: they are a paragraph, whose lines keep the white space at their ends."""
    out = []
    for k, n in enumerate(inlines):
        kind = n[0]
        if kind == "text":
            s = _md_text(n[1])
            if lines:
                first, last = k == 0 or inlines[k - 1][0] in ("br", "soft"), k + 1 == len(inlines) or inlines[k + 1][0] in ("br", "soft")
                s = _EDGE.sub(lambda m: f"&#{ord(m[0])};" if (first or m.start()) and (last or m.end() < len(s)) else m[0], s)  # noqa: B023
            out.append(s)
        elif kind == "code":
            ticks = "`" * (max(map(len, re.findall("`+", n[1])), default=0) + 1)
            pad = " " if n[1][:1] == "`" or n[1][-1:] == "`" or n[1][:1] == n[1][-1:] == " " else ""
            out.append(f"{ticks}{pad}{n[1]}{pad}{ticks}")
        elif kind in ("em", "strong", "del"):
            mark = {"em": "*", "strong": "**", "del": "~~"}[kind]
            out.append(mark + _md_inline(n[1], cell) + mark)
        elif kind in ("link", "img"):
            to = f"<{n[1]}>" if re.search(r"[\s()]", n[1]) or not n[1] else n[1]
            title = ' "' + n[2].replace("\\", "\\\\").replace('"', '\\"') + '"' if n[2] else ""
            out.append(("!" if kind == "img" else "") + f"[{_md_inline(n[3], cell)}]({to}{title})")
        elif kind == "ref":
            out.append(f"[^{n[1]}]")
        elif kind == "br":
            out.append(" " if cell else "\\\n")
        elif kind == "soft":
            out.append(" " if cell else "\n")
        else:
            out.append(n[1])
    return "".join(out)


_LINE_START = re.compile(r"^(\s*)(#{1,6}(?=\s|$)|[-+](?=\s|$)|=+\s*$|:?-[- \t]*:?[ \t]*$|(\d{1,9})([.)])(?=\s|$))", re.M)


def _guarded(s: str) -> str:
    """Lines that would begin a block of another kind are escaped."""
    return _LINE_START.sub(lambda m: f"{m[1]}{m[3]}\\{m[4]}" if m[3] else f"{m[1]}\\{m[2]}", s)


def write_markdown(blocks: list[tuple]) -> str:
    def one(b: tuple) -> str:
        kind = b[0]
        if kind == "p":
            return _guarded(_md_inline(b[1], lines=True))
        if kind == "h":
            text = _md_inline(b[2]).replace("\\\n", " ").replace("\n", " ")
            return ("#" * b[1] + " " + _LAST_HASHES.sub(r"\\\1", text)).rstrip()
        if kind == "code":
            fence = "`" * max(3, max(map(len, re.findall("`+", b[2])), default=0) + 1)
            return f"{fence}{b[1]}\n{b[2]}{fence}"
        if kind == "quote":
            return "\n".join(("> " + s).rstrip() for s in many(b[1]).split("\n"))
        if kind == "note":
            return f"[^{b[1]}]: " + "\n".join(("    " + x if k and x else x) for k, x in enumerate(many(b[2]).split("\n")))
        if kind == "hr":
            return "---"
        if kind == "html":
            return b[1].rstrip("\n")
        if kind == "list":
            items = []
            for k, (task, inner) in enumerate(b[3]):
                mark = "- " if b[1] is None else f"{b[1] + k}. "
                body = ("" if task is None else "[x] " if task else "[ ] ") + (("\n" if b[2] else "\n\n").join(map(one, inner)))
                items.append((mark + ("\n" + " " * len(mark)).join(body.split("\n"))).rstrip())
            return re.sub(r"(?m)^[ ]+$", "", ("\n" if b[2] else "\n\n").join(items))
        line = lambda cells: "| " + " | ".join(_md_inline(c, True) for c in cells) + " |"
        marks = {"left": ":---", "right": "---:", "center": ":---:", "": "---"}
        return "\n".join([line(b[2]), "| " + " | ".join(marks[a] for a in b[1]) + " |", *map(line, b[3])])

    def many(bs: list[tuple]) -> str:
        out = ""
        for k, b in enumerate(bs):
            if k:
                out += "\n\n<!-- -->\n\n" if b[0] == "list" == bs[k - 1][0] and (b[1] is None) == (bs[k - 1][1] is None) else "\n\n"
            out += one(b)
        return out

    text = many(blocks)
    return text + "\n" if text else ""


def _text_inline(inlines: list[tuple], numbers: dict[str, int] | None = None) -> str:
    out = []
    for n in inlines:
        if n[0] == "ref":
            out.append(f"[{(numbers or {}).get(n[1], n[1])}]")
        if n[0] in ("text", "code"):
            out.append(n[1])
        elif n[0] in ("em", "strong", "del"):
            out.append(_text_inline(n[1], numbers))
        elif n[0] == "link":
            inner = _text_inline(n[3], numbers)
            out.append(inner if not n[1] or n[1] in (inner, "mailto:" + inner, "http://" + inner) or n[1].startswith("#") else f"{inner} ({n[1]})" if inner else n[1])
        elif n[0] == "img":
            out.append(_text_inline(n[3], numbers))
        elif n[0] in ("br", "soft"):
            out.append("\n")
    return "".join(out)


def write_text(blocks: list[tuple]) -> str:
    numbers = {b[1]: k for k, b in enumerate((b for b in blocks if b[0] == "note"), 1)}

    def one(b: tuple) -> str:
        kind = b[0]
        if kind == "p":
            return _text_inline(b[1], numbers)
        if kind == "h":
            return _text_inline(b[2], numbers)
        if kind == "code":
            return b[2].rstrip("\n")
        if kind == "quote":
            return "\n".join(("  " + s).rstrip() for s in many(b[1]).split("\n"))
        if kind == "note":
            return f"[{numbers[b[1]]}] " + "\n".join(("    " + x if k and x else x) for k, x in enumerate(many(b[2]).split("\n")))
        if kind == "hr":
            return "* * *"
        if kind == "html":
            return ""
        if kind == "list":
            items = []
            for k, (task, inner) in enumerate(b[3]):
                mark = "- " if b[1] is None else f"{b[1] + k}. "
                body = ("" if task is None else "[x] " if task else "[ ] ") + ("\n" if b[2] else "\n\n").join(filter(None, map(one, inner)))
                items.append((mark + ("\n" + " " * len(mark)).join(body.split("\n"))).rstrip())
            return re.sub(r"(?m)^[ ]+$", "", ("\n" if b[2] else "\n\n").join(items))
        rows = [[_text_inline(c, numbers).replace("\n", " ") for c in r] for r in [b[2], *b[3]]]
        widths = [max(len(r[k]) for r in rows) for k in range(len(b[2]))]
        lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows]
        return "\n".join([lines[0], "  ".join("-" * max(1, w) for w in widths), *lines[1:]])

    def many(bs: list[tuple]) -> str:
        return "\n\n".join(filter(None, map(one, bs)))

    text = many(blocks)
    return text + "\n" if text else ""


def flat_notes(blocks: list[tuple]) -> list[tuple]:
    """References to notes as [n], and the notes as paragraphs that begin so at the document's end."""
    numbers = {b[1]: k for k, b in enumerate((b for b in blocks if b[0] == "note"), 1)}

    def flat(v):
        if isinstance(v, tuple) and v and v[0] == "ref":
            return ("text", f"[{numbers.get(v[1], v[1])}]")
        if isinstance(v, tuple | list):
            return type(v)(flat(x) for x in v)
        return v

    out = [flat(b) for b in blocks if b[0] != "note"]
    for b in blocks:
        if b[0] == "note":
            inner, mark = flat(b[2]), ("text", f"[{numbers[b[1]]}] ")
            out += [("p", [mark, *inner[0][1]]), *inner[1:]] if inner and inner[0][0] == "p" else [("p", [mark]), *inner]
    return out


def to_json(blocks: list[tuple]) -> str:
    """Blocks as JSON arrays; a list's items as [task, blocks]."""
    return json.dumps(blocks, ensure_ascii=False, separators=(",", ":")) + "\n"


def from_json(text: str) -> list[tuple]:
    def inlines(v):
        return [tuple(inlines(x) if isinstance(x, list) else x for x in n) for n in v]

    def block(b):
        kind = b[0]
        if kind in ("p", "h"):
            return (*b[:-1], inlines(b[-1]))
        if kind == "note":
            return ("note", b[1], [block(x) for x in b[2]])
        if kind == "quote":
            return ("quote", [block(x) for x in b[1]])
        if kind == "list":
            return ("list", b[1], b[2], [(task, [block(x) for x in inner]) for task, inner in b[3]])
        if kind == "table":
            return ("table", b[1], [inlines(c) for c in b[2]], [[inlines(c) for c in r] for r in b[3]])
        return tuple(b)

    return [block(b) for b in json.loads(text)]


def first_heading(blocks: list[tuple], level: int = 1) -> str:
    """The plain text of the first heading of a level; empty if there is none."""
    return next((_plain(b[2]) for b in blocks if b[0] == "h" and b[1] == level), "")


def tables(blocks: list[tuple]) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of every table: the heading before it, used once, or Table N."""
    out, heading, n = [], "", 0

    def walk(bs):
        nonlocal heading, n
        for b in bs:
            if b[0] == "h":
                heading = _plain(b[2])
            elif b[0] == "table":
                n += 1
                out.append((heading or f"Table {n}", [[_plain(c).replace("\n", " ") for c in r] for r in [b[2], *b[3]]]))
                heading = ""
            elif b[0] == "quote":
                walk(b[1])
            elif b[0] == "list":
                for _, inner in b[3]:
                    walk(inner)

    walk(blocks)
    return out
