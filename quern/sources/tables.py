"""Rows of delimited, JSON Lines and workbook files: path STRING, part STRING, line BIGINT, fields ARRAY<STRING>, every cell
as written.

read_rows and read_workbooks go through Spark's own readers, hence any file system that Spark knows. read_lines splits large
files whose records are lines, so that a file of any size is read by many tasks. `quern-rows` and `quern-workbook` are the
same as Python data sources, for folders that are mounted on every machine.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.sources import rows, workbooks

SCHEMA = "path string, part string, line bigint, fields array<string>"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kinds: tuple[str, ...]):
        self.options, self.kinds = options, kinds

    def partitions(self):
        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path, recursive=True))
        return [_File(p) for p in found if p.rsplit(".", 1)[-1].lower() in self.kinds] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            content = f.read()
        for part, line, fields in self.records(partition.path, content):
            yield partition.path, part, line, fields


class _RowsReader(_Reader):
    def records(self, path: str, content: bytes):
        text = rows.decode(content)
        kind = path.rsplit(".", 1)[-1].lower()
        if kind in ("jsonl", "ndjson"):
            header, body = rows.table_of(rows.parse_jsonl(text), rows.Report())
            yield "", 0, header
            for k, r in enumerate(body, 1):
                yield "", k, r
            return
        delimiter = "\t" if kind in ("tsv", "tab") else rows.delimiter_of(text, self.options.get("delimiter"))
        for line, fields in rows.parse_delimited(text, delimiter):
            yield "", line, fields


class _WorkbookReader(_Reader):
    def records(self, path: str, content: bytes):
        read = workbooks.read_ods if path.lower().endswith(".ods") else workbooks.read_xlsx
        sheets = read(content, rows.Report())
        if self.options.get("sheet"):
            sheets = [workbooks.chosen(sheets, self.options["sheet"])]
        for name, body in sheets:
            for k, r in enumerate(body, 1):
                yield name, k, r


class RowsSource(DataSource):
    kinds, reading = ("csv", "tsv", "tab", "jsonl", "ndjson"), _RowsReader

    @classmethod
    def name(cls) -> str:
        return "quern-rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return self.reading(dict(self.options), self.kinds)


class WorkbookSource(RowsSource):
    kinds, reading = ("xlsx", "ods"), _WorkbookReader

    @classmethod
    def name(cls) -> str:
        return "quern-workbook"


def register(spark: SparkSession) -> None:
    for source in (RowsSource, WorkbookSource):
        spark.dataSource.register(source)


def _frames(rows_: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows_:
        held.append(row)
        size += 60 + sum(map(len, row[3]))
        if size > 4 << 20:
            yield pd.DataFrame(held, columns=["path", "part", "line", "fields"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["path", "part", "line", "fields"])


def _read(spark: SparkSession, path: str, kinds: tuple[str, ...], reader: _Reader) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(kinds)}}}").load(path)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield from _frames((name, part, line, fields) for part, line, fields in reader.records(name, bytes(content)))

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_rows(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Records of delimited and JSON Lines files, line breaks in quotes included. A file is read by one task."""
    return _read(spark, path, RowsSource.kinds, _RowsReader({"delimiter": delimiter}, RowsSource.kinds))


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows of XLSX and ODS sheets; all sheets, or one by name or number."""
    return _read(spark, path, WorkbookSource.kinds, _WorkbookReader({"sheet": sheet}, WorkbookSource.kinds))


def read_lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Records of UTF-8 delimited files whose fields hold no line breaks. Large files are split; line is null."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where("trim(value) != ''")

    def run(batches):
        for batch in batches:
            text = "\n".join(batch["value"])
            records = [fields for _, fields in rows.parse_delimited(text, delimiter)]
            if len(records) != len(batch):
                raise ValueError("a record goes over several lines; read_rows takes those")
            yield pd.DataFrame({"path": batch["path"], "part": "", "line": pd.array([None] * len(records), "Int64"), "fields": records})

    return lines.mapInPandas(run, SCHEMA)
