"""Bounded, deterministic samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, id_text


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id's decimal text leaves that remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, unseen, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most `most` labelled rows of each class, those with the least hashes of their ids.

    unseen: condition on doc_id for rows that training must not see. Rows without a 0 or 1 are left out; of several labels
    of an id the least counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~unseen)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    # at most two times `most` ids
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    return cut(id_text(docs, id_col, text_col).join(picked, "doc_id").select("doc_id", "label", "text"))
