"""Batches: names of outputs and parts, clashes, merging of pictures, counts."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.convert import _IMAGE_READERS
from quern.plans.catalogue import formats
from quern.plans.detection import detect
from quern.sources import pdf
from quern.sources.rows import Malformed, Report, Unsupported

_UNSAFE = re.compile(r'[/\\:*?"<>|\x00-\x1f\x7f-\x9f]')


def part_stems(names: list[str]) -> list[str]:
    """File names for a document's parts, in order: made safe, `Part N` for empty ones, numbered where one is taken."""
    out: list[str] = []
    taken: set[str] = set()
    for k, name in enumerate(names):
        base = _UNSAFE.sub("_", name or "").strip().strip(".") or f"Part {k + 1}"
        stem, number = base, 2
        while stem.lower() in taken:
            stem, number = f"{base} ({number})", number + 1
        taken.add(stem.lower())
        out.append(stem)
    return out


def with_stems(results: DataFrame) -> DataFrame:
    """Results of convert with `stem`: a part's file name within its file. A file's parts are numbered in one task."""
    parts = results.where("error is null").select("path", "part_index", "part_name")

    def name(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part_index")
        return group.assign(stem=part_stems(list(group["part_name"])))[["path", "part_index", "stem"]]

    stems = parts.groupBy("path").applyInPandas(name, "path string, part_index int, stem string")
    return results.join(stems, ["path", "part_index"], "left")


def output_path(path: Column, target: str, root: str = "") -> Column:
    """Where a file's result goes: the target's first extension, below root if one is given."""
    extension = next(f["extensions"][0] if f["extensions"] else f["id"] for f in formats() if f["id"] == target)
    renamed = F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit("." + extension))
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(renamed, r"^/+", "")) if root else renamed


def clashes(files: DataFrame, target: str, path_col: str = "path") -> DataFrame:
    """Outputs that more than one file would have, with their number."""
    return files.groupBy(output_path(F.col(path_col), target).alias("output")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def plan_batch(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """files with `format`; those of no known format have null and count as skipped."""
    return detect(files, path_col, content_col)


def merge_images(files: DataFrame, group_col: str, order_col: str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One PDF for each group, its pictures as pages in order; a group's pages are gathered in one task, as one file is."""
    known = detect(files.select(F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.col(path_col).alias("path"), F.col(content_col).alias("content")))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        pages, error = [], None
        for row in group.sort_values("o").itertuples():
            try:
                if row.format not in _IMAGE_READERS:
                    raise Unsupported(f"{row.path} is not a picture that can be read")
                pages.append(_IMAGE_READERS[row.format](bytes(row.content), Report()))
            except (Malformed, Unsupported) as e:
                error = f"{row.path}: {e}"
                break
        return pd.DataFrame([(str(group["g"].iloc[0]), None if error else pdf.write_images(pages), len(pages), error)], columns=["group", "content", "pages", "error"])

    return known.groupBy("g").applyInPandas(merge, "group string, content binary, pages int, error string")


_PACKAGE = r"^(.*/[^/]+\.(?:pages|numbers|key))/(.+)$"


def package_folders(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """files with those inside a package folder (x.pages/Index/...) as one ZIP a folder; a folder is one task's, as a file is."""
    path = F.col(path_col)
    inside = path.rlike("(?i)" + _PACKAGE)
    parts = files.where(inside).select(F.regexp_extract(path, "(?i)" + _PACKAGE, 1).alias("path"), F.regexp_extract(path, "(?i)" + _PACKAGE, 2).alias("name"), F.col(content_col).alias("content"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in sorted(zip(group["name"], group["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), bytes(content))
        return pd.DataFrame([(group["path"].iloc[0], out.getvalue())], columns=["path", "content"])

    packed = parts.groupBy("path").applyInPandas(pack, "path string, content binary")
    return files.where(~inside).select(path.alias("path"), F.col(content_col).alias("content")).unionByName(packed)


def events(results: DataFrame) -> DataFrame:
    """(path, number, line): what happened to each file as JSON lines, in order: losses, warnings, then parts or an error."""
    file = results.groupBy("path").agg(F.first("losses").alias("losses"), F.first("warnings").alias("warnings"), F.first("error").alias("error"), F.count("part_index").alias("parts"), F.sum(F.octet_length("content")).alias("bytes"))
    line = lambda kind, *columns: F.to_json(F.struct(F.lit(kind).alias("event"), "path", *columns))
    losses = F.transform("losses", lambda x: F.to_json(F.struct(F.lit("loss").alias("event"), F.col("path"), x["line"].alias("line"), x["column"].alias("column"), x["description"].alias("message"))))
    warnings = F.transform("warnings", lambda x: F.to_json(F.struct(F.lit("warning").alias("event"), F.col("path"), x.alias("message"))))
    last = F.when(F.col("error").isNull(), line("done", "parts", "bytes")).otherwise(line("error", F.col("error.kind").alias("kind"), F.col("error.message").alias("message")))
    return file.select("path", F.posexplode(F.concat(losses, warnings, F.array(last))).alias("number", "line"))
