"""Removal of word windows that an earlier document has, by a log-structured fingerprint index (operator 9).

A window is `size` consecutive words. The least hash among its half windows is its anchor, which neighbouring windows
share; a window's fingerprint is its anchor (64 bits) and 48 bits of its own rolling hash. Documents come in batches of
ascending doc_id. A batch's windows go to buckets of anchors; in a bucket, what is new and the sorted, immutable runs of all
earlier batches are merge-joined by anchor, and windows under anchors that both or several have are verified by their own
hashes: a window goes if the history or a document with a smaller id has it. What the history lacks becomes a new run, and
runs are compacted into one that holds each fingerprint once.

Before windows leave a task, equal ones of its documents meet: only those of the least doc_id go on, the others are known
to go, so that a passage, however often it is copied, reaches its bucket once from each 400,000 words or so.

Null texts have no words; texts shorter than a window are left as they are. A null doc_id counts as the smallest. Rows that
share a doc_id never remove each other's words. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow, cut, drop_files, fresh, id_bounds, id_text, in_batches, mix64, scratch, settle, shuffle_partitions, slices, text_bytes, tidy

LEAST_ID = -(1 << 63)
#: Text for a bucket, which is gathered in memory, and for a task, which holds one bucket after the other.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 256 << 20
PACK_WORDS = 400_000
#: Batches of a table that comes as a whole, and runs from which on they are compacted.
BATCHES, MOST_RUNS = 3, 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Of kind new: windows of a batch; old: of the history; done: windows that are known to go.
RUN = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("doc_ids", "tags", "starts", "counts", "anchors", "hashes"))])
RUN_SQL = "bucket int, kind string, doc_ids binary, tags binary, starts binary, counts binary, anchors binary, hashes binary"
SPAN = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
OUT = pa.schema([*SPAN, *RUN])
OUT_SQL = f"doc_id long, tag long, first int, n int, {RUN_SQL}"
#: Bytes of hashes in a row of a run.
ROW_BYTES = 16 << 20


def split(text: str | None) -> list[bytes]:
    """Words between blanks, tabs, line ends, vertical tabs and form feeds."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _rolled(prefix: np.ndarray, back: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive words, the same wherever they stand."""
    return mix64((prefix[size:] - prefix[:-size]) * back[: len(prefix) - size])


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Least of every `span` consecutive values."""
    out, have = values, 1
    while have < span:
        more = min(have, span - have)
        out = np.minimum(out[: len(out) - more], out[more:])
        have += more
    return out


def _windows(texts: list[np.ndarray], size: int):
    """For all whole windows of some documents, given by their words' hashes: document number, place, anchor, 48-bit hash."""
    lengths = np.array([len(t) for t in texts])
    words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    n = len(words)
    if n < size:
        return None
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n), dtype=np.uint64)])
    back = _powers(_INVERSE, n)
    half = size // 2
    anchor = mix64(_least(_rolled(prefix, back, half), size - half + 1))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(texts)), lengths)[: n - size + 1]
    at = np.arange(n - size + 1)
    whole = at + size <= ends[doc]
    return doc[whole], (at - (ends - lengths)[doc])[whole], anchor[whole], _rolled(prefix, back, size)[whole] >> np.uint64(16)


def _six(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bucket(anchors: np.ndarray, bits: int) -> np.ndarray:
    return (anchors >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchors), np.int64)


def _inside(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ..., counts[k] of them, for all k one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it, and the number of rows."""
    new = np.ones(len(columns[0]) + 1, bool)
    if len(columns[0]) > 1:
        new[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new) if len(columns[0]) else np.zeros(1, np.int64)


def _deal(size: int, bits: int):
    """Documents into runs, packed for each bucket."""

    def pack(ids: list[int], tags: list[int], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if (found := _windows(texts, size)) is None or not len(found[0]):
            return
        doc, at, anchor, hashes = found
        ids, tags = np.array(ids, np.int64), np.array(tags, "<u4")
        # equal windows meet; those of the least id go on
        order = np.argsort(mix64(anchor ^ (hashes * _BASE)), kind="stable")
        cuts = _edges(anchor[order], hashes[order])
        least = np.minimum.reduceat(ids[doc[order]], cuts[:-1])
        gone = np.empty(len(doc), bool)
        gone[order] = ids[doc[order]] > np.repeat(least, np.diff(cuts))
        rows = []
        if gone.any():
            d, a = doc[gone], at[gone]
            c = _edges(d, a - np.arange(len(a)))
            rows.append((int(ids[d[0]]) % (1 << bits), "done", ids[d[c[:-1]]].astype("<i8").tobytes(), tags[d[c[:-1]]].tobytes(), a[c[:-1]].astype("<i4").tobytes(), np.diff(c).astype("<i4").tobytes(), b"", b""))
        doc, at, anchor, hashes = doc[~gone], at[~gone], anchor[~gone], hashes[~gone]
        c = _edges(doc, anchor, at - np.arange(len(at)))
        start, count = c[:-1], np.diff(c)
        order = np.argsort(anchor[start], kind="stable")
        start, count = start[order], count[order]
        cuts = _edges(_bucket(anchor[start], bits))
        for a, z in zip(cuts, cuts[1:], strict=False):
            r, n = start[a:z], count[a:z]
            rows.append((int(_bucket(anchor[r[:1]], bits)[0]), "new", ids[doc[r]].astype("<i8").tobytes(), tags[doc[r]].tobytes(), at[r].astype("<i4").tobytes(), n.astype("<i4").tobytes(), anchor[r].astype("<u8").tobytes(), _six(hashes[_inside(r, n)])))
        yield from in_batches(rows, RUN, weight=lambda r: len(r[-1]))

    def run(batches):
        ids, tags, texts, n, digest = [], [], [], 0, xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                if len(words) < size:
                    continue
                ids.append(i)
                tags.append(zlib.crc32(raw))
                texts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
                n += len(words)
                if n >= PACK_WORDS:
                    yield from pack(ids, tags, texts)
                    ids, tags, texts, n = [], [], [], 0
        yield from pack(ids, tags, texts)

    return run


def _bucket_rows(batches) -> Iterator[tuple[int, list[tuple]]]:
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def _joined(rows: list[tuple], k: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join([r[k] for r in rows]), kind)


def _spans(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(doc.astype(np.int64)), pa.array(tag.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(doc), f.type) for f in RUN)], schema=OUT)


def _run_rows(bucket: int, anchors: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows as rows of a run: sorted, each fingerprint once."""
    order = np.lexsort((hashes, anchors))
    anchors, hashes = anchors[order], hashes[order]
    one = _edges(anchors, hashes)[:-1]
    anchors, hashes = anchors[one], hashes[one]
    for a in range(0, len(one), ROW_BYTES // 6):
        part, own = anchors[a : a + ROW_BYTES // 6], hashes[a : a + ROW_BYTES // 6]
        cuts = _edges(part)
        row = bucket, "old", b"", b"", b"", np.diff(cuts).astype("<i4").tobytes(), part[cuts[:-1]].astype("<u8").tobytes(), _six(own)
        yield arrow(OUT, [(None, None, None, None, *row)])


def _merge(keep: bool, batches) -> Iterator[pa.RecordBatch]:
    """Of each bucket the windows that go, as (document, first window, number), and, on request, the run of what is new."""
    for bucket, rows in _bucket_rows(batches):
        done, new, old = ([r for r in rows if r[1] == kind] for kind in ("done", "new", "old"))
        if done:
            yield _spans(_joined(done, 2, "<i8"), _joined(done, 3, "<u4"), _joined(done, 4, "<i4"), _joined(done, 5, "<i4"))
        if not new:
            continue
        doc, tag, start, count, anchor = (_joined(new, k, kind) for k, kind in ((2, "<i8"), (3, "<u4"), (4, "<i4"), (5, "<i4"), (6, "<u8")))
        hashes = _unsix(b"".join([r[7] for r in new]))
        begin = np.cumsum(count) - count
        old_anchor, old_count = _joined(old, 6, "<u8"), _joined(old, 5, "<i4")
        old_hashes = _unsix(b"".join([r[7] for r in old]))
        old_begin = np.cumsum(old_count) - old_count
        # the merge-join: anchors in the history, or in several runs of the batch
        every, back, times = np.unique(anchor, return_inverse=True, return_counts=True)
        known = np.isin(every, old_anchor)
        asked = np.flatnonzero((known | (times > 1))[back])
        met = np.flatnonzero(np.isin(old_anchor, every[known]))
        n, m = count[asked], old_count[met]
        window, old_window = _inside(begin[asked], n), _inside(old_begin[met], m)
        who = np.concatenate([np.full(len(old_window), LEAST_ID), np.repeat(doc[asked], n)])
        history = np.arange(len(who)) < len(old_window)
        key = np.concatenate([np.repeat(old_anchor[met], m), np.repeat(anchor[asked], n)])
        own = np.concatenate([old_hashes[old_window], hashes[window]])
        order = np.lexsort((who, ~history, own, key))
        cuts = _edges(key[order], own[order])
        first = np.repeat(order[cuts[:-1]], np.diff(cuts))
        gone = order[~history[order] & (history[first] | (who[order] > who[first]))]
        gone = gone[gone >= len(old_window)] - len(old_window)
        if len(gone):
            run = np.repeat(asked, n)[np.sort(gone)]
            place = start[run] + (window[np.sort(gone)] - begin[run])
            order = np.lexsort((place, tag[run], doc[run]))
            run, place = run[order], place[order]
            d, t = doc[run], tag[run]
            c = _edges(d, t, place - np.arange(len(place)))
            yield _spans(d[c[:-1]], t[c[:-1]], place[c[:-1]], np.diff(c))
        if keep:
            fresh_one = np.ones(len(hashes), bool)
            fresh_one[window[gone]] = False
            yield from _run_rows(bucket, np.repeat(anchor, count)[fresh_one], hashes[fresh_one])


def _compacted(batches) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _bucket_rows(batches):
        yield from _run_rows(bucket, np.repeat(_joined(rows, 6, "<u8"), _joined(rows, 5, "<i4")), _unsix(b"".join([r[7] for r in rows])))


def _dealt_anew(bits: int, batches) -> Iterator[pa.RecordBatch]:
    """Rows of a run with other buckets; as anchors are sorted, a new bucket's are a stretch of an old one's or all of it."""
    for _, rows in _bucket_rows(batches):
        for row in rows:
            anchors, counts = np.frombuffer(row[6], "<u8"), np.frombuffer(row[5], "<i4")
            ends, cuts = np.cumsum(counts), _edges(_bucket(anchors, bits))
            for a, z in zip(cuts, cuts[1:], strict=False):
                x = int(ends[a] - counts[a])
                yield arrow(RUN, [(int(_bucket(anchors[a : a + 1], bits)[0]), "old", b"", b"", b"", counts[a:z].tobytes(), anchors[a:z].tobytes(), row[7][6 * x : 6 * int(ends[z - 1])])])


class WindowIndex:
    """Historical fingerprints in a folder that all executors share: one immutable sorted run of Parquet files a batch."""

    def __init__(self, spark: SparkSession, path: str, size: int = 50):
        self.spark, self.path, self.size = spark, path, size
        #: (files, bits of an anchor that name its bucket, bytes of the texts)
        self.runs: list[tuple[str, int, int]] = []

    def history(self, bits: int) -> list[DataFrame]:
        out = []
        for files, own, _ in self.runs:
            run = self.spark.read.schema(OUT_SQL).parquet(files).where("kind = 'old'").select(*RUN.names)
            out.append(run if own == bits else run.mapInArrow(tidy(partial(_dealt_anew, bits)), RUN_SQL))
        return out

    def _by_bucket(self, rows: list[DataFrame], bits: int, n_bytes: int) -> DataFrame:
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        parts = min(1 << bits, max(shuffle_partitions(self.spark), -(-n_bytes // TASK_BYTES)))
        # neighbouring buckets share a task
        return every.repartitionById(parts, F.expr(f"cast(bucket * {parts}L >> {bits} as int)")).sortWithinPartitions("bucket")

    def join(self, docs: DataFrame, keep: bool = True, id_col: str = "doc_id", text_col: str = "text", n_bytes: int | None = None) -> DataFrame:
        """(doc_id, tag, first, n) windows of a batch that go, tag being the text's CRC-32; on request the batch is kept as a run."""
        docs = _known(docs, id_col, text_col).select("key", "text")
        n_bytes = text_bytes(docs) if n_bytes is None else n_bytes
        bits = max([_bits(max(shuffle_partitions(self.spark), n_bytes // BUCKET_BYTES)), *(b for _, b, _ in self.runs)])
        rows = [docs.mapInArrow(tidy(_deal(self.size, bits)), RUN_SQL), *self.history(bits)]
        to = f"{self.path}/{scratch_name()}"
        self._by_bucket(rows, bits, n_bytes + sum(n for _, _, n in self.runs)).mapInArrow(tidy(partial(_merge, keep)), OUT_SQL).write.parquet(to)
        gone = cut(self.spark.read.schema(OUT_SQL).parquet(to).where("kind is null").select(*SPAN.names))
        if keep:
            self.runs = [*self.runs, (to, bits, n_bytes)]
        else:
            drop_files(self.spark, to)
        return gone

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Appends a run with what the history lacks of a batch's windows."""
        self.join(docs, True, id_col, text_col)

    def compact(self) -> None:
        """Merges all runs into one and deletes their files."""
        if len(self.runs) > 1:
            before, bits, n_bytes = self.runs, max(b for _, b, _ in self.runs), sum(n for _, _, n in self.runs)
            to = f"{self.path}/{scratch_name()}"
            self._by_bucket(self.history(bits), bits, n_bytes).mapInArrow(tidy(_compacted), OUT_SQL).write.parquet(to)
            self.runs = [(to, bits, n_bytes)]
            for files, _, _ in before:
                drop_files(self.spark, files)

    def drop(self) -> None:
        drop_files(self.spark, self.path)
        self.runs = []


def scratch_name() -> str:
    return f"run-{uuid.uuid4().hex}"


def _bits(buckets: int) -> int:
    return max(0, int(buckets - 1).bit_length())


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text); a null doc_id has the smallest key."""
    rows = id_text(docs, id_col, text_col)
    return rows.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("key"), "doc_id", "text")


def removed_windows(docs: DataFrame, size: int = 50, index: WindowIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, tag, spans) for texts that lose words; spans: (first window, number of windows).

    With an index the table is one batch against its history. Else it comes in batches of doc_id to an index of its own.
    """
    spark = docs.sparkSession
    if index is not None and index.size != size:
        raise ValueError("the index has windows of another size")
    if index is not None:
        every = index.join(docs, False, id_col, text_col)
    else:
        rows = _known(docs, id_col, text_col)
        bounds, n_bytes = id_bounds(rows, "key", batches), text_bytes(rows) // batches
        index, every = WindowIndex(spark, scratch(spark, "windows"), size), None
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            batch = rows
            batch = batch if low is None else batch.where(F.col("key") >= low)
            batch = batch if high is None else batch.where(F.col("key") < high)
            gone = index.join(batch, high is not None, "key", "text", n_bytes)
            every = gone if every is None else every.unionByName(gone)
            if high is not None and len(index.runs) > MOST_RUNS:
                index.compact()
        index.drop()
    return every.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def kept_words(words: list[bytes], spans: list, size: int) -> list[bytes]:
    if not spans:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        first, n = s["first"], s["n"]
        change[min(first, len(words))] += 1
        change[min(first + n - 1 + size, len(words))] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def dedup(docs: DataFrame, size: int = 50, index: WindowIndex | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on request, kept_text: the kept words joined by blanks."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *[("kept_text", pa.string())] * with_text])

    def run(batches):
        def rows():
            for batch in slices(batches):
                for i, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = split(text)
                    kept = kept_words(words, spans, size)
                    joined = b" ".join(kept)
                    row = i, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()
                    yield (*row, joined.decode("utf-8", "surrogatepass")) if with_text else row

        yield from in_batches(rows(), schema, weight=(lambda r: len(r[-1])) if with_text else None)

    spans = removed_windows(docs, size, index, id_col, text_col, batches).select(F.col("doc_id").alias("span_key"), "tag", "spans")
    rows = _known(docs, id_col, text_col)
    joined = rows.join(spans, (F.col("key") == F.col("span_key")) & (F.crc32("text") == F.col("tag")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def dedup_texts(docs: DataFrame, size: int = 50, index: WindowIndex | None = None, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True, batches: int = BATCHES) -> DataFrame:
    """docs with their columns, the removed words gone from the text of those that lose some.

    Texts that lose nothing stay as they are, white space included. Documents that lose every word are dropped on request.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        settle()
        out = []
        for text, s in zip(texts, spans, strict=True):
            out.append(b" ".join(kept_words(split(text), [{"first": x[0], "n": x[1]} for x in s], size)).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    key, tag, cuts = fresh(docs, "span_key", "span_tag", "spans")
    spans = removed_windows(docs, size, index, id_col, text_col, batches).select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.transform("spans", lambda x: F.array(x["first"], x["n"])).alias(cuts))
    text = F.col(text_col).cast("string")
    joined = docs.join(spans, (F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)) == F.col(key)) & (F.crc32(text) == F.col(tag)), "left")
    # Python gets the texts that change only
    changed = F.when(F.col(cuts).isNull(), text).otherwise(kept(F.when(F.col(cuts).isNotNull(), text), F.coalesce(cuts, F.array().cast("array<array<int>>"))))
    out = joined.withColumn(text_col, changed)
    if drop_emptied:
        out = out.where(F.col(cuts).isNull() | (F.col(text_col) != ""))
    return out.select(*docs.columns)
