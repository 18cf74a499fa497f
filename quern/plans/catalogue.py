"""Formats and conversion edges, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Id | name | extensions | category | read options | write options.
FORMATS = """
csv | Comma-Separated Values | csv | data | delimiter | delimiter
tsv | Tab-Separated Values | tsv, tab | data |  | 
jsonl | JSON Lines | jsonl, ndjson | data |  | 
xlsx | Excel Workbook | xlsx | data | sheet | sheet, effort
png | PNG image | png | image |  | effort
jpeg | JPEG image | jpg, jpeg, jpe | image |  | quality
webp | WebP image | webp | image |  | effort
heic | HEIC image | heic, heif, hif | image |  | quality, effort
pbm | Netpbm bitmap (PBM) | pbm | image |  | 
pgm | Netpbm graymap (PGM) | pgm | image |  | 
ppm | Netpbm pixmap (PPM) | ppm, pnm | image |  | 
pam | Netpbm arbitrary map (PAM) | pam | image |  | 
tga | Truevision TGA image | tga, icb, vda, vst | image |  | 
ico | Windows icon | ico | image |  | effort
cur | Windows cursor | cur | image |  | 
tiff | TIFF image | tif, tiff | image |  | effort
pdf | PDF document | pdf | document | page | font, effort
qoi | QOI image | qoi | image |  | 
bmp | Windows bitmap | bmp, dib | image |  | 
json | JSON | json | data |  | 
toml | TOML | toml | data |  | 
yaml | YAML | yaml, yml | data |  | 
xml | XML | xml | data |  | 
markdown | Markdown | md, markdown | document |  | 
html | HTML | html, htm | document |  | 
text | Plain text | txt | document |  | 
docx | Word document | docx | document |  | effort
odt | OpenDocument text | odt | document |  | effort
ods | OpenDocument spreadsheet | ods | data | sheet | sheet, effort
epub | EPUB e-book | epub | document |  | effort
rtf | Rich Text Format | rtf | document |  | 
pages | Apple Pages | pages | document |  | 
numbers | Apple Numbers | numbers | data | sheet | 
pages-json | Apple Pages package as JSON |  | document |  | 
markdown-json | Markdown events as JSON |  | document |  | 
z64 | N64 ROM, big-endian | z64 | game |  | 
v64 | N64 ROM, byte-swapped | v64 | game |  | 
n64 | N64 ROM, little-endian | n64 | game |  |
"""
#: Byte signatures; a ? stands for any byte.
MAGIC = {
    "png": b"\x89PNG\r\n\x1a\n",
    "jpeg": b"\xff\xd8\xff",
    "webp": b"RIFF????WEBP",
    "heic": b"????ftypheic",
    "pbm": b"P4",
    "pgm": b"P5",
    "ppm": b"P6",
    "pam": b"P7",
    "ico": b"\0\0\x01\0",
    "cur": b"\0\0\x02\0",
    "tiff": b"II*\0",
    "pdf": b"%PDF-",
    "qoi": b"qoif",
    "bmp": b"BM",
    "odt": b"PK\x03\x04" + b"?" * 26 + b"mimetypeapplication/vnd.oasis.opendocument.text",
    "ods": b"PK\x03\x04" + b"?" * 26 + b"mimetypeapplication/vnd.oasis.opendocument.spreadsheet",
    "epub": b"PK\x03\x04" + b"?" * 26 + b"mimetypeapplication/epub+zip",
    "rtf": b"{\\rtf",
    "z64": b"\x80\x37\x12\x40",
    "v64": b"\x37\x80\x40\x12",
    "n64": b"\x40\x12\x37\x80",
}
#: Source, fidelity: targets.
EDGES = """
csv lossless: json jsonl tsv
csv conditional: ods numbers xlsx markdown
json conditional: csv toml xml tsv jsonl ods numbers xlsx markdown
json lossless: yaml
markdown lossless: html markdown-json
markdown lossy: text pages epub odt rtf ods numbers xlsx json csv tsv
markdown conditional: docx pdf
markdown-json lossless: markdown
pages lossless: pages-json
pages conditional: docx pdf
pages lossy: markdown html text epub odt rtf
pages-json lossless: pages
docx lossy: markdown html text pages epub odt rtf
docx conditional: pdf
text lossy: pages epub odt rtf
text conditional: markdown html docx pdf
html lossy: pages markdown text epub odt rtf
html conditional: docx pdf
pdf lossy: text markdown html docx epub odt
rtf conditional: pdf
rtf lossy: epub odt docx pages markdown html text
epub lossy: docx pages rtf odt markdown html text
epub conditional: pdf
odt lossy: epub docx pages rtf markdown html text
odt conditional: pdf
toml conditional: json yaml xml
yaml conditional: json toml xml
xml conditional: json toml yaml
tsv lossless: json jsonl csv
tsv conditional: ods numbers xlsx markdown
jsonl conditional: csv tsv
jsonl lossless: json
xlsx conditional: csv tsv json markdown ods numbers
numbers conditional: csv tsv json markdown xlsx ods
ods conditional: csv tsv json markdown xlsx numbers
z64 lossless: v64 n64
v64 lossless: z64 n64
n64 lossless: z64 v64
"""
#: Edges with a name of their own.
NAMES = {("markdown", "markdown-json"): "markdown-to-json", ("pages", "pages-json"): "pages-to-json", ("pages-json", "pages"): "json-to-pages", ("markdown", "json"): "markdown-tables-to-json"}
#: Image format: fidelity of reading and of writing.
IMAGES = """
png: conditional lossless
bmp: lossless lossless
jpeg: conditional lossy
webp: conditional lossless
qoi: lossless lossless
pbm: lossless lossy
pgm: conditional conditional
ppm: conditional conditional
pam: conditional lossless
tga: conditional lossless
tiff: conditional lossless
ico: conditional conditional
cur: conditional -
pdf: conditional lossless
heic: conditional lossy
"""
COST = {"lossless": 1, "conditional": 10, "lossy": 100}
ONE_PART = {"csv", "tsv", "jsonl"}


def _lines(table: str) -> list[str]:
    return [x for x in table.strip().split("\n") if x]


def formats() -> list[dict]:
    out = []
    for line in _lines(FORMATS):
        i, name, extensions, category, reads, writes = (x.strip() for x in line.split("|"))
        split = lambda s: [x.strip() for x in s.split(",") if x.strip()]
        out.append({"id": i, "name": name, "extensions": split(extensions), "category": category, "read_options": split(reads), "write_options": split(writes), "magic": MAGIC.get(i)})
    return out


def listed_edges() -> list[tuple[str, str, str, str]]:
    """(name, from, to, fidelity) of the converters listed by hand."""
    out = []
    for line in _lines(EDGES):
        head, targets = line.split(":")
        source, fidelity = head.split()
        out += [(NAMES.get((source, t), f"{source}-to-{t}"), source, t, fidelity) for t in targets.split()]
    return out


def image_edges() -> list[tuple[str, str, str, str]]:
    """Every image reader with every other format's writer; the worse fidelity holds, a JPEG in a PDF is kept whole."""
    sides = {k: v.split() for k, v in (x.split(": ") for x in _lines(IMAGES))}
    out = []
    for source, (reading, _) in sides.items():
        for target, (_, writing) in sides.items():
            if source != target and writing != "-":
                worst = max(reading, writing, key=COST.get)
                out.append((f"{source}-to-{target}", source, target, "lossless" if (source, target) == ("jpeg", "pdf") else worst))
    return out


def edges() -> list[tuple[str, str, str, str]]:
    return listed_edges() + image_edges()


def formats_table(spark: SparkSession) -> DataFrame:
    rows = [(f["id"], f["name"], f["extensions"], f["category"], f["read_options"], f["write_options"], f["magic"], f["id"] in ONE_PART or f["category"] == "image") for f in formats()]
    return spark.createDataFrame(rows, "id string, name string, extensions array<string>, category string, read_options array<string>, write_options array<string>, magic binary, holds_one_part boolean")


def edges_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*e, COST[e[3]]) for e in edges()], "name string, source string, target string, fidelity string, cost int")
