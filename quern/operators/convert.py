"""Conversion of files in DataFrames: the planner's hops run one after the other inside one task for each file.

A converter takes bytes and gives parts, (name, bytes). If a target holds one part only and a hop gives several, the rest of
the path runs once for each part. Whatever was lost, reshaped or refused is reported in the result's rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans import planner
from quern.plans.catalogue import ONE_PART, listed_edges
from quern.sources import events, images, jpeg, office, pdf, rows, trees, webp, workbooks
from quern.sources.rows import Malformed, Report, Unsupported

Part = tuple[str, bytes]
Converter = Callable[[bytes, dict, Report], list[Part]]
CONVERTERS: dict[tuple[str, str], Converter] = {}


def remembered(key: tuple, report: Report, f: Callable[[Report], object]):
    """What f gives or raises, with its losses and warnings; made once for each key where several paths of a file share a report's memory."""
    if report.seen is None:
        return f(report)
    if key not in report.seen:
        own, value, error = Report(seen=report.seen), None, None
        try:
            value = f(own)
        except Exception as e:
            error = e
        report.seen[key] = value, own, error
    value, own, error = report.seen[key]
    report.losses += own.losses
    report.warnings += own.warnings
    if error is not None:
        raise error
    return value


def one(f: Callable[[bytes, dict, Report], bytes]) -> Converter:
    return lambda content, options, report: [("", f(content, options, report))]


def _delimited(kind: str, options: dict, text: str) -> str:
    return "\t" if kind == "tsv" else rows.delimiter_of(text, options.get("delimiter"))


def _records(kind: str, content: bytes, options: dict) -> list[tuple[int, list[str]]]:
    text = rows.decode(content)
    return list(rows.parse_delimited(text, _delimited(kind, options, text)))


def _out(kind: str, options: dict) -> str:
    return "\t" if kind == "tsv" else options.get("delimiter", ",")


def _array(objects) -> bytes:
    return _array_of([rows.dump_json(o) for o in objects])


def _array_of(lines: list[str]) -> bytes:
    return ("[\n  " + ",\n  ".join(lines) + "\n]\n" if lines else "[]\n").encode()


def _lines(values) -> bytes:
    return "".join(rows.dump_json(v) + "\n" for v in values).encode()


def _values(kind: str, content: bytes) -> list:
    if kind == "jsonl":
        return rows.parse_jsonl(rows.decode(content))
    value = rows.parse_json(rows.decode(content))
    if not isinstance(value, list):
        raise Unsupported("the JSON is not an array")
    return value


def _grid(kind: str, content: bytes, options: dict, report: Report) -> list[tuple[str, list[list[str]]]]:
    """Named sheets of rows."""
    if kind in ("csv", "tsv"):
        return [("", [r for _, r in _records(kind, content, options)])]
    if kind in ("json", "jsonl"):
        value = rows.parse_json(rows.decode(content)) if kind == "json" else _values(kind, content)
        named = value.items() if isinstance(value, dict) else [("", value)]
        out = []
        for name, part in named:
            if not isinstance(part, list):
                raise Unsupported("not an array of objects")
            header, body = rows.table_of(part, report)
            out.append((name, [header, *body] if header else []))
        return out
    if kind in ("xlsx", "ods"):
        sheets = (workbooks.read_xlsx if kind == "xlsx" else workbooks.read_ods)(content, report)
        return [workbooks.chosen(sheets, options["sheet"])] if options.get("sheet") else sheets
    report.loss("everything outside tables is dropped")
    return events.tables(events.read_markdown(rows.decode(content)))


def _from_grid(target: str, sheets: list[tuple[str, list[list[str]]]], options: dict, report: Report) -> list[Part]:
    if target in ("csv", "tsv"):
        return [(n, rows.write_delimited(r, _out(target, options)).encode()) for n, r in sheets] or [("", b"")]
    if target == "json":
        named = [(n, list(rows.objects_of(iter(list(enumerate(r, 1))), report))) for n, r in sheets]
        if len(named) <= 1:
            return [("", _array(named[0][1] if named else []))]
        return [("", (rows.dump_json(dict(named)) + "\n").encode())]
    if target == "jsonl":
        return [(n, _lines(rows.objects_of(iter(list(enumerate(r, 1))), report))) for n, r in sheets]
    if target == "markdown":
        blocks: list[str] = []
        for name, r in sheets:
            if name and len(sheets) > 1:
                blocks.append(events.markdown_heading(name))
            if r:
                width = len(r[0])
                if any(len(x) != width for x in r):
                    report.warn("rows are padded or cut to the header's width")
                    r = [(x + [""] * width)[:width] for x in r]
                blocks.append(events.markdown_rows(r[0], r[1:]))
        return [("", "".join(["\n\n".join(blocks), "\n"] if blocks else []).encode())]
    named = [(n or f"Sheet{k + 1}", r) for k, (n, r) in enumerate(sheets)] or [("Sheet1", [])]
    return [("", (workbooks.write_xlsx if target == "xlsx" else workbooks.write_ods)(named, report))]


def _grids(source: str, target: str, content: bytes, options: dict, report: Report) -> list[Part]:
    return _from_grid(target, _grid(source, content, options, report), options, report)


for _s in ("csv", "tsv", "json", "jsonl", "xlsx", "ods", "markdown"):
    for _t in ("csv", "tsv", "json", "xlsx", "ods", "markdown"):
        if _s != _t and (_s != "jsonl" or _t in ("csv", "tsv")):
            CONVERTERS[_s, _t] = partial(_grids, _s, _t)


def _objects(source: str, target: str, content: bytes, options: dict, report: Report) -> bytes:
    texts = list(rows.object_texts(_records(source, content, options), report))
    return _array_of(texts) if target == "json" else "".join([t + "\n" for t in texts]).encode()


for _s in ("csv", "tsv"):
    for _t in ("json", "jsonl"):
        CONVERTERS[_s, _t] = one(partial(_objects, _s, _t))
CONVERTERS["jsonl", "json"] = one(lambda c, o, r: _array(_values("jsonl", c)))
CONVERTERS["json", "jsonl"] = one(lambda c, o, r: _lines(_values("json", c)))

_TREE_READERS = {"json": lambda t, r: rows.parse_json(t), "toml": trees.parse_toml, "yaml": trees.parse_yaml, "xml": trees.parse_xml}
_TREE_WRITERS = {"json": lambda v, r: rows.dump_json(v) + "\n", "toml": trees.dump_toml, "yaml": lambda v, r: trees.dump_yaml(v), "xml": trees.dump_xml}


def _tree(source: str, target: str, content: bytes, options: dict, report: Report) -> bytes:
    value = remembered(("tree", source, content), report, lambda r: _TREE_READERS[source](rows.decode(content), r))
    if report.seen is None:
        return _TREE_WRITERS[target](value, report).encode()
    # equal values of equal types, whatever they were read from, are written once; pickled they are told apart by their types
    return remembered(("written", target, pickle.dumps(value)), report, lambda r: _TREE_WRITERS[target](value, r).encode())


for _s in _TREE_READERS:
    for _t in _TREE_WRITERS:
        if _s != _t:
            CONVERTERS[_s, _t] = one(partial(_tree, _s, _t))

_TEXT_READERS = {"text": events.read_text, "markdown": events.read_markdown, "html": events.read_html, "markdown-json": events.from_json}
_TEXT_WRITERS = {"text": events.write_text, "markdown": events.write_markdown, "html": events.write_html, "markdown-json": events.to_json}
_DOCUMENTS = ("text", "markdown", "html", "markdown-json", *office.READERS, "pdf")


def _document(source: str, target: str, content: bytes, options: dict, report: Report) -> bytes:
    if source == "pdf" and target == "text":
        return pdf.read_text(content, report, options.get("page")).encode()
    if source in _TEXT_READERS:
        blocks = _TEXT_READERS[source](rows.decode(content))
    else:
        blocks = pdf.read_blocks(content, report, options.get("page")) if source == "pdf" else office.READERS[source](content, report)
    if target in _TEXT_WRITERS:
        if target == "text" and source != "text":
            report.loss("formatting is dropped")
        return _TEXT_WRITERS[target](blocks).encode()
    if target == "pdf" and any(b[0] == "note" for b in blocks):
        report.loss("notes become paragraphs at the end")
        blocks = events.flat_notes(blocks)
    return pdf.write_text(blocks, report) if target == "pdf" else office.WRITERS[target](blocks, report)


for _, _s, _t, _ in listed_edges():
    if _s in _DOCUMENTS and _t in _DOCUMENTS:
        CONVERTERS[_s, _t] = one(partial(_document, _s, _t))

_IMAGE_READERS = images.READERS | {"jpeg": jpeg.read, "webp": webp.read, "pdf": pdf.read_image}
_IMAGE_WRITERS = images.WRITERS | {"jpeg": jpeg.write, "webp": webp.write, "pdf": pdf.write_image}


def _raster(source: str, target: str, content: bytes, options: dict, report: Report) -> bytes:
    if source == "jpeg" and target == "pdf":
        return pdf.write_jpeg(content, report)
    image = pdf.read_image(content, report, options.get("page")) if source == "pdf" else _IMAGE_READERS[source](content, report)
    if target == "jpeg":
        return jpeg.write(image, report, int(options.get("quality", 85)))
    return _IMAGE_WRITERS[target](image, report)


for _s in _IMAGE_READERS:
    for _t in _IMAGE_WRITERS:
        if _s != _t:
            CONVERTERS[_s, _t] = one(partial(_raster, _s, _t))

#: Byte orders of a four-byte word.
_ORDERS = {"z64": "0123", "v64": "1032", "n64": "3210"}


def _rom(source: str, target: str, content: bytes, options: dict, report: Report) -> bytes:
    import numpy as np

    if len(content) % 4:
        raise Malformed("the image is not a whole number of words")
    words = np.frombuffer(content, np.uint8).reshape(-1, 4)
    return words[:, [_ORDERS[source].index(c) for c in _ORDERS[target]]].tobytes()


for _s in _ORDERS:
    for _t in _ORDERS:
        if _s != _t:
            CONVERTERS[_s, _t] = one(partial(_rom, _s, _t))


def convert_bytes(content: bytes, hops: list[tuple[str, str]], options: dict, report: Report) -> list[Part]:
    """The parts that a path gives. Once a hop has given several, the others run for each."""
    parts = [("", content)]
    for source, target in hops:
        if (source, target) not in CONVERTERS:
            raise Unsupported(f"no converter for {source} to {target} is built in")
        new = []
        for name, body in parts:
            for inner, out in remembered((source, target, body), report, lambda r: CONVERTERS[source, target](body, options, r)):  # noqa: B023
                new.append((inner or name, out))
        if target in ONE_PART and options.get("sheet") is None and len(new) > 1 and source in ("xlsx", "ods") and not options.get("parts", True):
            new = new[:1]
        parts = new
    return parts


def attempt(content: bytes | None, hops: list[tuple[str, str]], options: dict, strict: bool = False, seen: dict | None = None) -> tuple[list[Part], Report, tuple | None]:
    """Parts, report and error (kind, line, column, message) of one file. Whatever the file holds, nothing is raised.
    seen: what paths of the same file and options share."""
    report = Report(seen=seen)
    try:
        if content is None:
            raise Malformed("the file has no content")
        parts = convert_bytes(bytes(content), hops, options, report)
    except Malformed as e:
        return [], report, ("malformed", e.line, e.column, str(e))
    except Unsupported as e:
        return [], report, ("unsupported", None, None, str(e))
    except RecursionError:
        return [], report, ("malformed", None, None, "the values are nested too deeply")
    except Exception as e:  # no file may end the job that converts the others
        return [], report, ("malformed", None, None, f"{type(e).__name__}: {e}"[:500])
    if strict and report.losses:
        return [], report, ("loss", None, None, report.losses[0][2])
    return parts, report, None


#: Bytes of results that are held back before they leave a task.
MOST_BYTES = 16 << 20
RESULT = "path string, source string, target string, part_index int, part_name string, content binary, losses array<struct<line int, column int, description string>>, warnings array<string>, error struct<kind string, line int, column int, message string>"
_LOSS = pa.struct([("line", pa.int32()), ("column", pa.int32()), ("description", pa.string())])
_ERROR = pa.struct([("kind", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("message", pa.string())])
_SCHEMA = pa.schema([("path", pa.string()), ("source", pa.string()), ("target", pa.string()), ("part_index", pa.int32()), ("part_name", pa.string()), ("content", pa.binary()), ("losses", pa.list_(_LOSS)), ("warnings", pa.list_(pa.string())), ("error", _ERROR)])


def _named(kind: pa.StructType, values: tuple | None) -> dict | None:
    return None if values is None else dict(zip([f.name for f in kind], values, strict=True))


def _batch(held: list[tuple]) -> pa.RecordBatch:
    *columns, losses, warnings, errors = map(list, zip(*held, strict=True))
    columns += [[[_named(_LOSS, x) for x in xs] for xs in losses], warnings, [_named(_ERROR, e) for e in errors]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def convert(files: DataFrame, source: str, target: str, via: str | None = None, strict: bool = False, path_col: str = "path", content_col: str = "content", **options) -> DataFrame:
    """One row for each part of each file, one with an error for each file that is refused. Files never leave their task."""
    hops = [(h[1], h[2]) for h in planner.plan(source, target, via, strict).hops]
    return convert_along(files, hops, strict, path_col, content_col, **options)


def convert_along(files: DataFrame, hops: list[tuple[str, str]], strict: bool = False, path_col: str = "path", content_col: str = "content", **options) -> DataFrame:
    """convert by the given hops, whatever the planner would choose."""
    source, target = hops[0][0], hops[-1][1]

    def one_file(path, content) -> list[tuple]:
        parts, report, error = attempt(content, hops, options, strict)
        head = (path, source, target)
        if error:
            return [(*head, None, None, None, report.losses, report.warnings, error)]
        return [(*head, k, name, body, report.losses, report.warnings, None) for k, (name, body) in enumerate(parts)]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in one_file(path, content.as_py()):
                    held.append(row)
                    size += len(row[5] or b"") + 200
                    if size >= MOST_BYTES:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    return files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, RESULT)


_EDGE_SCHEMA = pa.schema([("edge", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def convert_paths(files: DataFrame, paths: dict[str, list[tuple[str, str]]], **options) -> DataFrame:
    """(edge, path, content, error message): each file along several paths, named by their keys. A step that paths share, by
    source, target and bytes, is made once for a file."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _EDGE_SCHEMA, strict=True)], schema=_EDGE_SCHEMA)

    def run(batches):
        held, size = [], 0
        for got in batches:
            for path, content in zip(got.column(0).to_pylist(), got.column(1), strict=True):
                content, seen = content.as_py(), {}
                for edge, hops in paths.items():
                    parts, _, error = attempt(content, hops, options, seen=seen)
                    for body, message in [(None, error[3])] if error else [(body, None) for _, body in parts]:
                        held.append((edge, path, body, message))
                        size += len(body or b"") + 200
                    if size >= MOST_BYTES:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "edge string, path string, content binary, error string")


def summary(results: DataFrame) -> DataFrame:
    """Counts of files converted, converted with losses, and failed."""
    files = results.groupBy("path").agg(F.max(F.col("error").isNotNull()).alias("failed"), F.max(F.size("losses") > 0).alias("lossy"))
    return files.agg(F.count_if(~F.col("failed")).alias("converted"), F.count_if(F.col("lossy") & ~F.col("failed")).alias("lossy"), F.count_if("failed").alias("failed"))
