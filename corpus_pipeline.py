"""Training-data pipeline over documents: quality, near-duplicates, repeated passages, benchmark passages, tokens.

Every stage but the last returns the columns of documents. Nulls, empty texts and empty tables pass through as the stage's
operator defines. Near-duplicates have a Jaccard similarity of 0.8 or more on 5-word shingles; op2's query keeps its own contract.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, quality, simhash, substring_dedup
from quern.llm.common import fresh, scratch, table

KEEP_SCORE = 0.3


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with n_chars as its text now has it, in the columns of like."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(model)(F.col("text")) >= KEEP_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    (kept,) = fresh(docs, "kept")
    ids = simhash.similar(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(kept)), "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; what is left of a document stays."""
    return _counted(substring_dedup.dedup_texts(docs), docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark windows are cut out of the others."""
    return _counted(decontamination.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("bpe", tokens),
]
#: SQL can express neither the trained model nor the automaton's tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the folder that the executors share and read again."""
    docs = table(spark, sf_dir, "documents")
    to = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{k}")
        docs = spark.read.parquet(f"{to}/{k}")
    return docs
