"""The pipeline's stages against brute force on their own inputs."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import decontamination
from quern.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
    for d in seen:
        assert d.columns == columns
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] and counts[-1] > 0.5 * counts[0]
    bench = table(spark, SF, "benchmark")
    assert decontamination.scan(seen[-1], bench).where("size(items) > 0").count() == 0
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids for r in seen[-1].collect()}
    got = {r.doc_id: r.ids_sha256 for r in docs.collect()}
    assert got == {i: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for i, ids in want.items()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_empty(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
