"""Format detection as joins with the small format table: extension first, unless another format's signature says else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.catalogue import formats

#: Bytes of a file's head that decide.
HEAD = 128


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def by_extension(path: Column) -> Column:
    """Format id of a path's extension, else null; the first format in id order counts."""
    out: dict[str, str] = {}
    for f in sorted(formats(), key=lambda f: f["id"]):
        for e in f["extensions"]:
            out.setdefault(e, f["id"])
    known = F.create_map(*[F.lit(x) for pair in out.items() for x in pair])
    return known[extension(path)]


def by_id(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for f in formats() for x in (f["id"], f["id"])])
    return known[F.lower(name)]


def _fits(head: Column, magic: bytes) -> Column:
    """Whether the head, as upper-case hex, begins with the signature."""
    like = "".join("__" if b == 0x3F else f"{b:02X}" for b in magic) + "%"
    return F.hex(F.substring(head, 1, HEAD)).like(like)


def by_magic(head: Column) -> Column:
    out = F.lit(None).cast("string")
    for f in sorted((f for f in formats() if f["magic"]), key=lambda f: f["id"], reverse=True):
        out = F.when(_fits(head, f["magic"]), f["id"]).otherwise(out)
    return out


def detect(files: DataFrame, path_col: str = "path", head_col: str = "content") -> DataFrame:
    """files with `format`. A signature overrules only an extension whose own signature the head is long enough for and lacks."""
    path, head = F.col(path_col), F.col(head_col)
    named, seen = by_extension(path), by_magic(head)
    own = F.lit(True)  # no signature: never overruled
    for f in formats():
        if f["magic"]:
            own = F.when(named == f["id"], _fits(head, f["magic"]) | (F.octet_length(head) < len(f["magic"]))).otherwise(own)
    return files.withColumn("format", F.when(named.isNull(), seen).when(own, named).otherwise(F.coalesce(seen, named)))
