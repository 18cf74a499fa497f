"""The scalar functions that columns can't express, as SQL functions over Arrow batches."""

from __future__ import annotations

import html
import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.sources import events, rows, trees


def _over(f):
    def series(s: pd.Series) -> pd.Series:
        known: dict[str, object] = {}  # a batch's equal texts are worked out once

        def value(x):
            if type(x) is not str:
                return None if x is None or x != x else f(x)
            if x not in known:
                known[x] = f(x)
            return known[x]

        return pd.Series([value(x) for x in s], dtype=object)

    return series


def _float_text(s: pd.Series) -> pd.Series:
    return _over(lambda x: rows.float_text(x) if abs(x) != float("inf") else None)(s)


def entity_decode(text: str) -> str:
    """Character references that end in a semicolon; others stay."""
    return re.sub(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", lambda m: html.unescape(m[0]), text)


def percent_decode(text: str) -> str:
    """Percent escapes as UTF-8; a plus sign stays."""
    return unquote_to_bytes(text).decode("utf-8", "replace")


FUNCTIONS = {
    "float_text": (_float_text, "string"),
    "entity_decode": (_over(entity_decode), "string"),
    "percent_decode": (_over(percent_decode), "string"),
    "href_escape": (_over(events.address), "string"),
    "markdown_to_html": (_over(lambda t: events.write_html(events.read_markdown(t))), "string"),
    "html_to_markdown": (_over(lambda t: events.write_markdown(events.read_html(t))), "string"),
    "first_heading": (_over(lambda t: events.first_heading(events.from_json(t))), "string"),
    "html_to_text": (_over(lambda t: events.write_text(events.read_html(t))), "string"),
    "yaml_to_json": (_over(lambda t: rows.dump_json(trees.parse_yaml(t, rows.Report()))), "string"),
    "sniff_delimiter": (_over(rows.delimiter_of), "string"),
}


def function(name: str):
    """A column function by its name."""
    f, kind = FUNCTIONS[name]

    def series(s: pd.Series) -> pd.Series:
        return f(s)

    return F.pandas_udf(series, kind)


def register(spark: SparkSession) -> None:
    for name in FUNCTIONS:
        spark.udf.register(name, function(name))
