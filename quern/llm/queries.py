"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, fingerprint, quality, sharding, simhash, substring_dedup, token_files, toxicity, url_filter
from quern.llm.common import scratch, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", decontamination.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256")
    ).withColumn("contaminated", decontamination.contaminated())


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read(spark, path)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_sharding, op4_url_filter, op5_toxicity, op6_decontamination, op7_fingerprint, op8_quality, op9_substring_dedup, op10_token_files)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op6_decontamination": rf"""
        with d as (select doc_id, {_WORDS} as w from documents),
        b as (select item_id, {_WORDS} as w from benchmark),
        bw as (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0),
        win as (select distinct item_id, len(w[i:i + 12]) as n, array_to_string(w[i:i + 12], ' ') as s from bw),
        lens as (select distinct n from win),
        dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n),
        ds as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from dw),
        hit as (select ds.doc_id, ds.i, ds.n, win.item_id from ds join win on ds.n = win.n and ds.s = win.s),
        covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hit) group by doc_id),
        found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from hit group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join covered using (doc_id) left join found using (doc_id)""",
    "op9_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
        s as (select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as h from p),
        f as (select h, min(doc_id) as first from s group by h),
        gone as (select distinct doc_id, unnest(range(i, i + 50)) as k from (select s.doc_id, s.i from s join f using (h) where first < s.doc_id)),
        each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
        kept as (select e.doc_id, count(*) as n, string_agg(word, ' ' order by k) as text from each e anti join gone g on e.doc_id = g.doc_id and e.k = g.k group by e.doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
        from d left join kept using (doc_id)""",
}
