"""Rows: delimited text, JSON and JSON Lines, with their losses and warnings.

A row set is a header and records of strings. Delimited text keeps every cell as written: nothing is trimmed or typed, an
empty cell is an empty string.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from json.encoder import encode_basestring

csv.field_size_limit(1 << 31)


class Malformed(ValueError):
    """The input breaks its format's rules."""

    def __init__(self, message: str, line: int | None = None, column: int | None = None):
        super().__init__(message)
        self.line, self.column = line, column


class Unsupported(ValueError):
    """The input or the pair of formats is valid but can't be converted."""


@dataclass
class Report:
    losses: list[tuple[int | None, int | None, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    #: What was made of a file so far, for paths that share steps.
    seen: dict | None = None

    def loss(self, text: str, line: int | None = None, column: int | None = None) -> None:
        self.losses.append((line, column, text))

    def warn(self, text: str) -> None:
        self.warnings.append(text)


_DECLARED = re.compile(rb"""(?:charset\s*=\s*["']?|encoding\s*=\s*["'])(shift_jis|euc-jp|iso-2022-jp|utf-8)""", re.I)


def japanese(content: bytes) -> str | None:
    """Text in the Japanese charset that it declares in its first kilobyte, or else reads best as; null if in none."""
    declared = _DECLARED.search(content[:1024])
    if declared and declared[1].lower() != b"utf-8":
        names = [{b"shift_jis": "cp932", b"euc-jp": "euc_jp", b"iso-2022-jp": "iso2022_jp"}[declared[1].lower()]]
    else:
        names = ["iso2022_jp"] if b"\x1b$" in content else ["euc_jp", "cp932"]
    best, most = None, 0
    for name in names:
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        # full-width kana and common ideographs speak for a charset, half-width kana against it
        score = sum("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in text) - 2 * sum("\uff61" <= c <= "\uff9f" for c in text)
        if score > most:
            best, most = text, score
    return best


def decode(content: bytes) -> str:
    """UTF-8 with or without a mark, UTF-16 with one, or a Japanese charset; NUL becomes U+FFFD."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            content = content[len(mark) :]
            break
    else:
        codec = "utf-8"
        if b"\x1b$" in content and (text := japanese(content)) is not None:
            return text
    try:
        return content.decode(codec).replace("\0", "\ufffd")
    except UnicodeDecodeError as e:
        if codec == "utf-8" and (text := japanese(content)) is not None:
            return text.replace("\0", "\ufffd")
        raise Malformed("the text is not valid " + codec.upper(), content[: e.start].count(b"\n") + 1) from None


_IN_QUOTES = re.compile(r'(^|[,;\t|\r\n])"(?:[^"]|"")*"')


def delimiter_of(text: str, given: str | None = None) -> str:
    """The delimiter that the first records agree on, outside quotes: comma, semicolon, tab or bar; else a comma."""
    if given:
        return given
    best, most = ",", 0
    # a field in quotes, line breaks and all, counts for nothing
    lines = _IN_QUOTES.sub(r"\1", text[:65536]).split("\n", 20)[:20]
    for d in ",;\t|":
        counts = {line.count(d) for line in lines[:-1] or lines if line.strip()}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = d, n
    return best


def parse_delimited(text: str, delimiter: str = ",") -> Iterator[tuple[int, list[str]]]:
    """(line, fields) of each record that isn't blank. A quote inside a bare field stays; text after a closed quote is added to it."""
    end = "\x00end"

    reader, start = csv.reader(_joined(text, end), delimiter=delimiter, doublequote=True, strict=False), 1
    for record in reader:
        if record == [end]:
            return
        if record and record[-1].endswith(end):
            raise Malformed("a quoted field is not closed", start)
        if record:
            yield start, record
        start = reader.line_num + 1


def _joined(text: str, end: str) -> Iterator[str]:
    if text and text[-1] not in "\r\n":
        text += "\n"
    yield from io.StringIO(text, newline="")
    yield end


def write_delimited(records, delimiter: str = ",") -> str:
    odd = re.compile(rf'["\n\r{re.escape(delimiter)}]').search

    def line(record: list[str]) -> str:
        text = delimiter.join(record)
        if text.count(delimiter) != len(record) - 1 or odd(text.replace(delimiter, "")):
            text = delimiter.join(['"' + cell.replace('"', '""') + '"' if odd(cell) else cell for cell in record])
        return text + "\n"

    return "".join(map(line, records))


class Number(str):
    """A JSON number as it was written."""


def _pairs(pairs: list[tuple]) -> dict:
    return dict(pairs)


def _constant(name: str):
    raise Malformed(f"{name} is not JSON")


_decoder = json.JSONDecoder(object_pairs_hook=_pairs, parse_float=Number, parse_int=Number, parse_constant=_constant)


def _checked(text: str) -> str:
    try:
        text.encode()
    except UnicodeEncodeError:
        raise Malformed("a string holds half a surrogate pair") from None
    return text


def parse_json(text: str):
    """A JSON value whose numbers keep their text. Of equal keys the last counts."""
    try:
        value, end = _decoder.raw_decode(text, len(text) - len(text.lstrip(" \t\r\n")))
    except json.JSONDecodeError as e:
        raise Malformed(e.msg, e.lineno, e.colno) from None
    if text[end:].strip(" \t\r\n"):
        raise Malformed("input goes on after the value", text.count("\n", 0, end) + 1)
    if "\\u" in text or text.count("[") + text.count("{") > 100:  # half a surrogate pair can only be escaped
        dump_json(value)
    return value


def parse_jsonl(text: str) -> list:
    """Values one after the other, white space between them."""
    out, at = [], 0
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at >= len(text):
            return out
        try:
            value, at = _decoder.raw_decode(text, at)
        except json.JSONDecodeError as e:
            raise Malformed(e.msg, e.lineno, e.colno) from None
        out.append(value)


def json_text(s: str) -> str:
    return encode_basestring(s if s.isascii() else _checked(s))


def dump_json(value) -> str:
    """Compact JSON; numbers as written."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return json_text(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return float_text(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json_text(k)}:{dump_json(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(dump_json, value)) + "]"


def float_text(x: float) -> str:
    """The shortest text that reads back, always with a fraction or an exponent; an exponent from 1e21 on and below 1e-6."""
    if x != x or x in (float("inf"), float("-inf")):
        raise Unsupported("JSON has no infinities")
    digits = repr(x)
    if x and not 1e-6 <= abs(x) < 1e21:
        mantissa, _, exponent = f"{Decimal(digits).normalize():e}".partition("e")
        return f"{mantissa}e{int(exponent)}"
    if "e" in digits:
        digits = format(Decimal(digits), "f")
    return digits if "." in digits else digits + ".0"


def objects_of(records: Iterator[tuple[int, list[str]]], report: Report) -> Iterator[dict]:
    """Records as objects under the first one's cells. Short records leave their last keys out, long ones lose cells."""
    header = next(records, (0, None))[1]
    if header is None:
        return
    for line, cells in records:
        if len(cells) < len(header):
            report.warn(f"line {line}: {len(header) - len(cells)} fields are missing")
        for k in range(len(header), len(cells)):
            report.loss("a field without a heading is dropped", line, k + 1)
            break
        yield dict(zip(header, cells, strict=False))


def object_texts(records: Iterator[tuple[int, list[str]]], report: Report) -> Iterator[str]:
    """objects_of as JSON texts."""
    records = iter(records)
    first = next(records, None)
    if first is None:
        return
    header = first[1]
    if len(set(header)) < len(header):
        yield from map(dump_json, objects_of(iter([first, *records]), report))
        return
    whole = "{" + ",".join(json_text(k).replace("%", "%%") + ":%s" for k in header) + "}"
    width = len(header)
    for line, cells in records:
        if len(cells) == width:
            yield whole % tuple(map(json_text, cells))
        else:
            yield from map(dump_json, objects_of(iter([first, (line, cells)]), report))


def table_of(values: list, report: Report) -> tuple[list[str], Iterator[list[str]]]:
    """Header and records of objects: their keys in the order in which they first come up."""
    header: dict[str, int] = {}
    for n, v in enumerate(values):
        if not isinstance(v, dict):
            raise Unsupported(f"value {n + 1} is not an object")
        for k in v:
            header.setdefault(k, len(header))
    said: set[tuple[str, str]] = set()

    def once(key: str, what: str) -> None:
        if (key, what) not in said:
            said.add((key, what))
            report.loss(f"{key}: {what}")

    def records():
        for v in values:
            row = [""] * len(header)
            for k, x in v.items():
                if x is None:
                    once(k, "nulls become empty")
                elif isinstance(x, bool | Number):
                    once(k, "types become text")
                    row[header[k]] = dump_json(x)
                elif isinstance(x, dict | list):
                    once(k, "nested values become JSON text")
                    row[header[k]] = dump_json(x)
                else:
                    row[header[k]] = x
            if len(v) < len(header):
                once("", "missing keys become empty")
            yield row

    return list(header), records()
