"""Trees: TOML, YAML and XML to values and back. Values are dicts, lists, strings, numbers, booleans and None."""

from __future__ import annotations

import datetime
import json
import math
import re
import tomllib
from xml.parsers import expat

from quern.sources.rows import Malformed, Number, Report, Unsupported, float_text


def number(x):
    """A JSON number as an int that fits 64 bits, else a float."""
    if isinstance(x, Number):
        if re.fullmatch(r"-?[0-9]+", x) and -(1 << 63) <= int(x) < 1 << 63:
            return int(x)
        return float(x)
    return x


# TOML


class _Dated(str):
    """A date or time, as text."""


_STRINGS_OR_DATES = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'[^\'\n]*\'|#[^\n]*')


def parse_toml(text: str, report: Report) -> dict:
    """Dates and times become text, as JSON has none; each key path with one is a loss."""
    try:
        value = tomllib.loads(text.replace("\r\n", "\n"))
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"line (\d+), column (\d+)", str(e))
        raise Malformed(str(e), *(map(int, m.groups()) if m else ())) from None

    def walk(v, path: str):
        if isinstance(v, dict):
            return {k: walk(x, f"{path}.{k}" if path else k) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x, path) for x in v]
        if isinstance(v, datetime.datetime | datetime.date | datetime.time):
            report.loss(f"{path}: a date becomes text")
            s = v.isoformat()
            return s[:-6] + "Z" if s.endswith("+00:00") else s
        if isinstance(v, float) and not math.isfinite(v):
            return _special(v, path, report)
        if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
            raise Malformed(f"{path}: the integer is too large")
        return v

    return walk(value, "")


def _special(v: float, path: str, report: Report) -> str:
    report.loss(f"{path}: a number that JSON lacks becomes text")
    return "nan" if v != v else "inf" if v > 0 else "-inf"


_BARE = re.compile(r"[A-Za-z0-9_-]+\Z")


_ESCAPED = re.compile(r'["\\\x00-\x1f\x7f]')


def _quoted(s: str) -> str:
    if not _ESCAPED.search(s):
        return f'"{s}"'
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}
    return '"' + "".join(named.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else c) for c in s) + '"'


def dump_toml(value, report: Report) -> str:
    if not isinstance(value, dict):
        raise Unsupported("TOML needs an object at its root")
    key = lambda k: k if _BARE.match(k) else _quoted(k)

    def scalar(v, path):
        v = number(v)
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return _quoted(v)
        if isinstance(v, int):
            return str(v)
        if isinstance(v, float):
            return float_text(v)
        if isinstance(v, list):
            if any(x is None for x in v):
                report.loss(f"{path}: nulls in an array are dropped")
            return "[" + ", ".join(scalar(x, path) for x in v if x is not None) + "]"
        return "{ " + ", ".join(f"{key(k)} = {scalar(x, path)}" for k, x in v.items() if x is not None) + " }" if v else "{}"

    out: list[str] = []

    def table(v: dict, path: list[str]) -> None:
        later = []
        for k, x in v.items():
            if x is None:
                report.loss(f"{'.'.join([*path, k])}: a null member is dropped")
            elif isinstance(x, dict) or isinstance(x, list) and x and all(isinstance(i, dict) for i in x):
                later.append((k, x))
            else:
                out.append(f"{key(k)} = {scalar(x, '.'.join([*path, k]))}\n")
        for k, x in later:
            name = ".".join(map(key, [*path, k]))
            for item in x if isinstance(x, list) else [x]:
                out.append(("\n" if out else "") + (f"[[{name}]]\n" if isinstance(x, list) else f"[{name}]\n"))
                table(item, [*path, k])

    table(value, [])
    return "".join(out)


# YAML


#: The core schema's words.
_CORE = dict.fromkeys(("", "~", "null", "Null", "NULL")) | dict.fromkeys(("true", "True", "TRUE"), True) | dict.fromkeys(("false", "False", "FALSE"), False)
_INFINITE = re.compile(r"([-+]?)\.(inf|Inf|INF)")
_BASED = {"0x": (16, re.compile("[0-9a-fA-F]+")), "0o": (8, re.compile("[0-7]+"))}
_INTEGER = re.compile(r"[-+]?[0-9]+")
_FLOAT = re.compile(r"[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?")


def resolve_plain(s: str):
    """A plain scalar's value under the YAML 1.2 core schema."""
    if s in _CORE:
        return _CORE[s]
    if s[0] not in "-+.0123456789":
        return s
    if m := _INFINITE.fullmatch(s):
        return -math.inf if m[1] == "-" else math.inf
    if s in (".nan", ".NaN", ".NAN"):
        return math.nan
    if s[:2] in _BASED:
        base, digits = _BASED[s[:2]]
        return int(s[2:], base) if digits.fullmatch(s[2:]) and int(s[2:], base) < 1 << 63 else s
    if _INTEGER.fullmatch(s):
        return int(s) if -(1 << 63) <= int(s) < 1 << 63 else float(s)
    if _FLOAT.fullmatch(s):
        return float(s)
    return s


_TAGS = {"int": int, "float": float, "bool": bool, "null": type(None)}


class _Unusual(Exception):
    """Left to the whole parser."""


_PLAIN_WORD = r"-?[A-Za-z0-9_./](?:[A-Za-z0-9_./+@ -]*[A-Za-z0-9_./+@-])?|~"
_QUOTED_TEXT = r'"(?:[^"\\]|\\["\\/bfnrt])*"'
_KEY_VALUE = re.compile(rf"({_PLAIN_WORD}|{_QUOTED_TEXT}):(?: +([^ ].*))?")
_SCALAR = re.compile(rf"({_PLAIN_WORD})|({_QUOTED_TEXT})")
_FLOW = re.compile(rf"\[ *(?:(?:{_PLAIN_WORD}|{_QUOTED_TEXT}) *(?:, *(?:{_PLAIN_WORD}|{_QUOTED_TEXT}) *)*)?\]")
_NOT_SIMPLE = re.compile(r"[^\n -~\u00a0-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd]|^(?:---|\.\.\.)|^.{1000}", re.M)
_INDENTED = re.compile(r"( *)(.*?) *\Z")


def _simple_yaml(text: str):
    """The value of a document of the plainest kind: block collections, words, strings in double quotes, flow sequences of
    them. All else, errors among it, raises _Unusual."""
    if _NOT_SIMPLE.search(text):
        raise _Unusual
    lines = [(len(m[1]), m[2]) for m in map(_INDENTED.match, text.split("\n")) if m[2]]
    if not lines:
        raise _Unusual
    count, at = len(lines), 0

    def scalar(s: str):
        m = _SCALAR.fullmatch(s)
        if not m:
            if s == "{}":
                return {}
            if _FLOW.fullmatch(s):
                return [scalar(x[0]) for x in _SCALAR.finditer(s[1:-1])]
            raise _Unusual
        if m[2]:
            return json.loads(s)
        v = resolve_plain(s)
        if isinstance(v, float) and not math.isfinite(v):
            raise _Unusual
        return v

    def block(indent: int):
        """The collection or scalar that begins on the line at hand."""
        nonlocal at
        s = lines[at][1]
        if s == "-" or s[:2] == "- ":
            out = []
            while at < count and lines[at][0] == indent and ((s := lines[at][1]) == "-" or s[:2] == "- "):
                inner = s[1:].lstrip(" ")
                if inner:
                    lines[at] = deeper, _ = indent + len(s) - len(inner), inner
                    out.append(block(deeper))
                else:
                    at += 1
                    out.append(block(lines[at][0]) if at < count and lines[at][0] > indent else None)
                if at < count and lines[at][0] > indent:
                    raise _Unusual
            return out
        m = _KEY_VALUE.fullmatch(s)
        if not m:
            at += 1
            return scalar(s)
        own = {}
        while at < count and lines[at][0] == indent:
            m = _KEY_VALUE.fullmatch(lines[at][1])
            if not m:
                break
            key = json.loads(m[1]) if m[1][0] == '"' else m[1]
            if key in own:
                raise _Unusual
            at += 1
            if m[2] is not None:
                own[key] = scalar(m[2])
            elif at < count and (lines[at][0] > indent or lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1][:2] == "- ")):
                own[key] = block(lines[at][0])
            else:
                own[key] = None
            if at < count and lines[at][0] > indent:
                raise _Unusual
        return own

    value = block(lines[0][0])
    if at < count:
        raise _Unusual
    return value


def parse_yaml(text: str, report: Report):
    """One document's value; several become an array. Aliases are copied, merge keys merged."""
    try:
        return _simple_yaml(text)
    except (_Unusual, RecursionError):
        return _whole_yaml(text, report)


def _whole_yaml(text: str, report: Report):
    import yaml

    class Loader(yaml.SafeLoader):
        def compose_node(self, parent, index):
            event = self.peek_event()
            node = super().compose_node(parent, index)
            if getattr(event, "tag", None) is not None and not isinstance(event, yaml.AliasEvent):
                tags[id(node)] = event.tag
                kept.append(node)
            return node

    tags: dict[int, str] = {}
    kept: list = []

    def value(node, path: str, open_: tuple):
        if id(node) in open_:
            raise Malformed(f"{path}: an alias holds itself", node.start_mark.line + 1)
        inside = (*open_, id(node))
        if isinstance(node, yaml.ScalarNode):
            tag = tags.get(id(node))
            if tag is None and node.style is None:
                v = resolve_plain(node.value)
            elif tag in (None, "!", "tag:yaml.org,2002:str", "tag:yaml.org,2002:binary"):
                return node.value
            else:
                v = resolve_plain(node.value)
                kind = tag.rpartition(":")[2]
                if kind == "float" and isinstance(v, int) and not isinstance(v, bool):
                    v = float(v)
                if kind in _TAGS and not (isinstance(v, _TAGS[kind]) and isinstance(v, bool) == (kind == "bool")):
                    raise Malformed(f"{path}: {node.value!r} is no {kind}", node.start_mark.line + 1)
                if kind not in _TAGS:
                    return node.value
            return _special(v, path, report) if isinstance(v, float) and not math.isfinite(v) else v
        if isinstance(node, yaml.SequenceNode):
            return [value(n, path, inside) for n in node.value]
        own, merged = {}, []
        for k, v in node.value:
            if not isinstance(k, yaml.ScalarNode):
                raise Unsupported(f"{path}: a key that is not a scalar")
            if k.value == "<<" and k.style is None:
                for m in v.value if isinstance(v, yaml.SequenceNode) else [v]:
                    merged.append((len(own), value(m, path, inside)))
                continue
            if k.value in own:
                raise Malformed(f"{path}: the key {k.value} comes twice", k.start_mark.line + 1)
            own[k.value] = value(v, f"{path}.{k.value}" if path else k.value, inside)
        if not merged:
            return own
        out, items = {}, list(own.items())
        for at in range(len(items) + 1):
            for place, m in merged:
                if place == at:
                    for k, v in m.items():
                        if k not in own:
                            out.setdefault(k, v)
            if at < len(items):
                out[items[at][0]] = items[at][1]
        return out

    try:
        documents = [value(n, "", ()) for n in yaml.compose_all(text, Loader) if n is not None]
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise Malformed(str(getattr(e, "problem", e)), mark and mark.line + 1, mark and mark.column + 1) from None
    if len(documents) > 1:
        report.warn(f"{len(documents)} documents become an array")
        return documents
    return documents[0] if documents else None


#: Words that other YAML readers take for booleans.
_WORDS = {"yes", "no", "on", "off"}


_PLAIN = re.compile(r"[A-Za-z0-9_./][^\x00-\x1f\x7f\n:#,\[\]{}&*!|>'\"%@`]*")


def _plain(s: str) -> bool:
    return s.lower() not in _WORDS and bool(_PLAIN.fullmatch(s)) and resolve_plain(s) == s and s == s.strip() and not s.startswith(("---", "..."))


def _lines(s: str) -> bool:
    """Whether a string goes into a literal block: several lines, the first not indented, nothing to escape."""
    return "\n" in s and s.strip("\n") != "" and s[0] not in " \n\t" and not re.search(r"[^\n\t -~\u00a0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]|[ \t]\n", s)


def dump_yaml(value) -> str:
    def scalar(v) -> str:
        v = number(v)
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return float_text(v)
        if isinstance(v, int):
            return str(v)
        return v if _plain(v) else _quoted(v)

    def lines(s: str, depth: int) -> str:
        chomp = "" if s.endswith("\n") and not s.endswith("\n\n") else "+" if s.endswith("\n") else "-"
        return f"|{chomp}\n" + "".join("  " * depth + x + "\n" if x else "\n" for x in s.removesuffix("\n").split("\n"))

    def block(v, depth: int) -> str:
        pad = "  " * depth
        if isinstance(v, dict) and v:
            out = ""
            for k, x in v.items():
                if isinstance(x, str) and _lines(x):
                    out += pad + scalar(str(k)) + ": " + lines(x, depth + 1)
                    continue
                out += pad + scalar(str(k)) + ":" + (f" {scalar(x)}\n" if not isinstance(x, dict | list) else " " + ("{}" if isinstance(x, dict) else "[]") + "\n" if not x else "\n" + block(x, depth + 1))
            return out
        if isinstance(v, list) and v:
            out = ""
            for x in v:
                if isinstance(x, str) and _lines(x):
                    out += pad + "- " + lines(x, depth + 1)
                elif isinstance(x, dict | list) and x:
                    out += pad + "- " + block(x, depth + 1)[2 * depth + 2 :]
                else:
                    out += pad + "- " + ("{}" if x == {} else "[]" if x == [] else scalar(x)) + "\n"
            return out
        return pad + ("{}" if v == {} else "[]" if v == [] else scalar(v)) + "\n"

    return block(value, 0)


# XML


def parse_xml(text: str, report: Report) -> dict:
    """{root: value}: attributes as @name, text as #text, repeated children as arrays at the first one's place; all strings."""
    root: dict = {}
    stack: list[tuple[str, dict, list[str]]] = [("", root, [])]

    def start(name, attributes):
        stack[-1][2].append("\0")  # what stands before and after an element are texts of their own
        members = {f"@{attributes[k]}": attributes[k + 1] for k in range(0, len(attributes), 2)}
        stack.append((name, members, []))

    def end(name):
        _, members, texts = stack.pop()
        text = " ".join(filter(None, (t.strip(" \t\r\n") for t in "".join(texts).split("\0"))))
        if text and any(not k.startswith("@") for k in members):
            report.loss(f"{name}: the order of text and elements is lost")
        if not members:
            value = text or None
        else:
            value = members
            if text:
                value["#text"] = text
        parent = stack[-1][1]
        if name in parent:
            if not isinstance(parent[name], list):
                parent[name] = [parent[name]]
            parent[name].append(value)
        else:
            parent[name] = value

    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: stack[-1][2].append(data)

    def refuse(*_):
        raise Unsupported("document type declarations with entities are refused")

    parser.EntityDeclHandler = refuse
    try:
        parser.Parse(re.sub(r"^(<\?xml[^>]*?)\s+encoding=(\"[^\"]*\"|'[^']*')", r"\1", text), True)
    except expat.ExpatError as e:
        raise Malformed(expat.errors.messages[e.code], e.lineno, e.offset + 1) from None
    return root


_NAME = re.compile(r"[A-Za-z_:À-\U000effff][\w:.·-]*\Z")


def dump_xml(value, report: Report) -> str:
    def text(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def scalar(v) -> str:
        v = v if isinstance(v, Number) else number(v)
        return "" if v is None else "true" if v is True else "false" if v is False else float_text(v) if isinstance(v, float) else str(v)

    def element(name: str, v, depth: int) -> str:
        if not _NAME.match(name):
            raise Unsupported(f"{name!r} is no XML name")
        pad = "  " * depth
        if isinstance(v, list):
            return "".join(element(name, x if not isinstance(x, list) else {"item": x}, depth) for x in v)
        if not isinstance(v, dict):
            s = text(scalar(v))
            return f"{pad}<{name}>{s}</{name}>\n" if s else f"{pad}<{name}/>\n"
        attributes, inner, body = "", "", ""
        for k, x in v.items():
            if k.startswith("@"):
                if isinstance(x, dict | list):
                    raise Unsupported(f"{k}: an attribute holds one value only")
                attributes += f' {k[1:]}="{text(scalar(x)).replace(chr(34), "&quot;").replace(chr(10), "&#10;").replace(chr(9), "&#9;")}"'
            elif k == "#text":
                body += text(scalar(x))
            else:
                inner += element(k, x, depth + 1)
        if inner:
            return f"{pad}<{name}{attributes}>\n" + (f"{pad}  {body}\n" if body else "") + f"{inner}{pad}</{name}>\n"
        return f"{pad}<{name}{attributes}>{body}</{name}>\n" if body else f"{pad}<{name}{attributes}/>\n"

    if isinstance(value, dict) and len(value) == 1 and not next(iter(value)).startswith(("@", "#")) and not isinstance(next(iter(value.values())), list):
        name, v = next(iter(value.items()))
        body = element(name, v, 0)
    else:
        report.warn("the value is wrapped in an element named root")
        body = element("root", {"item": value} if isinstance(value, list) else value, 0)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + body
