"""Scalar functions of text formats as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_quote(field: Column, delimiter: str = ",") -> Column:
    """A field in quotes if it holds the delimiter, a quote or a line break; inner quotes are doubled."""
    special = F.contains(field, F.lit(delimiter)) | F.contains(field, F.lit('"')) | F.contains(field, F.lit("\n")) | F.contains(field, F.lit("\r"))
    return F.when(special, F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def csv_record(fields: list[Column], delimiter: str = ",") -> Column:
    """One record without its line end; nulls are empty."""
    return F.concat_ws(delimiter, *[csv_quote(F.coalesce(f.cast("string"), F.lit("")), delimiter) for f in fields])


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    named = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    others = [(chr(c), f"\\u{c:04x}") for c in range(32) if chr(c) not in "\n\r\t\b\f"]
    escaped = F.when(text.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), _replaced(_replaced(text, named), others)).otherwise(_replaced(text, named))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def json_object(names: list[str], fields: list[Column]) -> Column:
    """A JSON object of strings; members that are null are left out."""
    import json

    members = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), json_string(f.cast("string"))) for n, f in zip(names, fields, strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def html_escape(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def xml_text(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def xml_attribute(text: Column) -> Column:
    return _replaced(xml_text(text), [('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")])


def is_number_literal(text: Column) -> Column:
    """A decimal that a spreadsheet stores as written: no leading or trailing zeros, at most 15 significant digits."""
    digits = F.length(F.regexp_replace(F.regexp_extract(text, r"^-?([0-9]+(?:\.[0-9]+)?)", 1), r"\.", ""))
    return text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?([eE][+-]?[0-9]+)?\z") & (digits <= 15) & F.coalesce(F.abs(F.expr("try_cast(1 as double)") * text.try_cast("double")) < float("inf"), F.lit(False))


def iso_serial(text: Column) -> Column:
    """Days since 1899-12-30 of an ISO date from 1900-03-01 on, else null."""
    day = text.try_cast("date")
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (day >= F.lit("1900-03-01").cast("date")), F.datediff(day, F.lit("1899-12-30").cast("date")))


def serial_iso(days: Column) -> Column:
    """ISO date of a day serial."""
    return F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int")), "yyyy-MM-dd")


def yaml_kind(text: Column) -> Column:
    """What a plain YAML scalar is under the core schema: null, bool, int, float or str."""
    whole = text.rlike(r"^[-+]?[0-9]+\z")
    hexadecimal, octal = text.rlike(r"^0x[0-9a-fA-F]+\z"), text.rlike(r"^0o[0-7]+\z")
    return (
        F.when(text.isin("", "~", "null", "Null", "NULL"), "null")
        .when(text.isin("true", "True", "TRUE", "false", "False", "FALSE"), "bool")
        .when(text.rlike(r"^([-+]?(\.inf|\.Inf|\.INF)|\.nan|\.NaN|\.NAN)\z"), "float")
        .when(hexadecimal | octal, "int")
        .when(whole, F.when(text.try_cast("bigint").isNotNull(), "int").otherwise("float"))
        .when(text.rlike(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\z"), "float")
        .otherwise("str")
    )


def json_number_kind(text: Column) -> Column:
    """int if a JSON number has neither fraction nor exponent and fits 64 bits, float otherwise, null if it is none."""
    number = text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z")
    return F.when(number, F.when(text.rlike(r"^-?[0-9]+\z") & text.try_cast("bigint").isNotNull(), "int").otherwise("float"))


def fold_breaks(text: Column) -> Column:
    """Line breaks as single blanks; none at the ends or beside another blank."""
    inner = F.regexp_replace(text, r"^[\r\n]+|[\r\n]+\z", "")
    return F.regexp_replace(F.regexp_replace(inner, r"(?<= )[\r\n]+|[\r\n]+(?= )", ""), r"[\r\n]+", " ")


def paragraphs(text: Column) -> Column:
    """Paragraphs as arrays of lines: lines between blank ones, without a final carriage return."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, "\r\\z", ""))
    done = F.concat(lines, F.array(F.lit("")))
    state = F.aggregate(
        done,
        F.struct(F.array().cast("array<array<string>>").alias("all"), F.array().cast("array<string>").alias("open")),
        lambda acc, s: F.when(F.trim(F.regexp_replace(s, r"\s+", " ")) != "", F.struct(acc["all"].alias("all"), F.array_append(acc["open"], s).alias("open"))).otherwise(
            F.struct(F.when(F.size(acc["open"]) > 0, F.array_append(acc["all"], acc["open"])).otherwise(acc["all"]).alias("all"), F.array().cast("array<string>").alias("open"))
        ),
    )
    return state["all"]


def markdown_heading(text: Column) -> Column:
    """A first-level heading line; what Markdown would read as markup is escaped."""
    return F.concat(F.lit("# "), F.regexp_replace(text, r"([\\`*_\[\]#<>|])", r"\\$1"))


def part_stem(name: Column, index: Column) -> Column:
    """A part's name made safe for file systems, `Part N` if nothing is left; clashes are numbered by `number_stems`."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|\p{Cc}]', "_"), r"^\s+|\s+\z", "")
    clean = F.regexp_replace(clean, r"^\.+|\.+\z", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.concat(F.lit("Part "), (index + 1).cast("string"))).otherwise(clean)


def n64_reorder(hexed: Column, source: str, target: str) -> Column:
    """Upper-case hex of a ROM image in another byte order; a multiple of four bytes is assumed."""
    orders = {"z64": "1234", "v64": "2143", "n64": "4321"}
    if source == target:
        return hexed
    place = {c: k for k, c in enumerate(orders[source])}
    return F.regexp_replace(hexed, r"(..)(..)(..)(..)", "".join(f"${place[c] + 1}" for c in orders[target]))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return F.shiftright(19595 * red + 38470 * green + 7471 * blue + 32768, 16)


def over_white(value: Column, alpha: Column) -> Column:
    """A channel flattened over white."""
    return F.floor((value * alpha + 255 * (255 - alpha) + 127) / 255)


def double_quoted(text: Column) -> Column:
    """A double-quoted string of TOML or YAML: named escapes, and upper-case hex for other control characters."""
    named = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
    others = [(chr(c), f"\\u{c:04X}") for c in (*range(32), 127) if chr(c) not in "\n\r\t\b\f"]
    escaped = F.when(text.rlike(r"[\x00-\x07\x0B\x0E-\x1F\x7F]"), _replaced(_replaced(text, named), others)).otherwise(_replaced(text, named))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def heading_number(style: Column) -> Column:
    """The level of a heading style by its name, 1 to 9, else null."""
    return F.regexp_extract(F.lower(F.trim(style)), r"^heading\s*\+?0*([1-9])\z", 1).try_cast("int")


def date_serial(text: Column) -> Column:
    """Days since 1899-12-30 of an ISO date or date and time, seconds with fractions; a zone is left out."""
    whole = F.regexp_replace(F.trim(text), r"(Z|\+[0-9:]+)\z", "")
    good = whole.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{1,2}(:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]+)?)?)?)?\z")
    part = lambda n: F.coalesce(F.regexp_extract(whole, r"T([0-9]+)(?::([0-9]+))?(?::([0-9.]+))?", n).try_cast("double"), F.lit(0.0))
    days = F.datediff(F.substring(whole, 1, 10).try_cast("date"), F.lit("1899-12-30").cast("date"))
    return F.when(good, days + (part(1) * 3600 + part(2) * 60 + part(3)) / 86400)


def duration_days(text: Column) -> Column:
    """Days of an ISO duration of days, hours, minutes and seconds; null with years, months or weeks."""
    form = r"^(-?)P(?:([0-9.]+)D)?(?:T(?:([0-9.]+)H)?(?:([0-9.]+)M)?(?:([0-9.]+)S)?)?\z"
    whole = F.trim(text)
    part = lambda n: F.coalesce(F.regexp_extract(whole, form, n).try_cast("double"), F.lit(0.0))
    days = (part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)) / 86400
    return F.when(whole.rlike(form), F.when(F.regexp_extract(whole, form, 1) == "-", -days).otherwise(days))


def duration_text(days: Column) -> Column:
    """HH:MM:SS of a number of days, hours past a day kept."""
    total = F.round(F.abs(days) * 86400).cast("long")
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    sign = F.when((days < 0) & (total > 0), "-").otherwise("")
    return F.concat(sign, two(F.floor(total / 3600)), F.lit(":"), two(F.floor(total / 60) % 60), F.lit(":"), two(total % 60))


def hyphen_break(before: Column, line: Column) -> Column:
    """Whether a line goes on with a word that the one before it broke."""
    return before.rlike(r"\p{L}-\z") & line.rlike(r"^\p{Ll}")


def is_cjk(text: Column) -> Column:
    """Whether all that is no white space belongs to scripts written without blanks, full-width forms included."""
    return text.rlike(r"^\s*(?:[　-ヿ㐀-䶿一-鿿豈-﫿︐-︟︰-﹏＀-￯\x{20000}-\x{3134F}]\s*)+\z")


def radicals() -> dict[str, str]:
    """The ideographs that radicals stand for, by Unicode's compatibility mappings."""
    import unicodedata

    found = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x2E80, 0x2FE0), *range(0x31C0, 0x31F0))}
    return {a: b for a, b in found.items() if a != b and len(b) == 1}


def unify_radicals(text: Column) -> Column:
    """Radicals as the ideographs that they stand for."""
    table = radicals()
    return F.translate(text, "".join(table), "".join(table.values()))


def list_number(n: Column, kind: str) -> Column:
    """A list item's number: decimal, lower or upper letters (z is followed by aa, bb), lower or upper Roman numerals."""
    if kind.endswith("Letter"):
        out = F.repeat(F.char(96 + F.pmod(n - 1, F.lit(26)) + 1), (F.floor((n - 1) / 26) + 1).cast("int"))
    elif kind.endswith("Roman"):
        place = lambda one, five, ten, k: F.element_at(F.array(*map(F.lit, ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))), (F.floor(n / 10**k) % 10 + 1).cast("int"))
        out = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), place("c", "d", "m", 2), place("x", "l", "c", 1), place("i", "v", "x", 0))
    else:
        out = n.cast("string")
    return F.upper(out) if kind.startswith("upper") else out
