"""Token ids in binary files, packed with Simple-8b (operator 10).

A block holds the ids of some whole documents. Its 64-bit words carry a selector in the low 4 bits and as many ids as fit
above: SELECTORS lists how many and how wide. Ids that no selector holds are replaced by 0 and kept apart as escapes,
(place, value) pairs. Every EVERY ids a new word begins, whose number the block's offsets give: each such stretch is packed
and decoded by itself, all stretches of a block side by side, and a reader can begin at any of them. A block also has its
documents' ids and token counts, and the number of ids before it in its file part. Blocks are the rows of Parquet files,
which Spark's own committer writes: a lost executor leaves no half-written file, and any file system that Spark reads will
do.

Null texts count as empty; empty texts have no ids but the end id. Rows that share a doc_id are rows of their own, in the
order of their ids' bytes; null doc_ids come first. An empty table gives no blocks and an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Memory, arrow, id_bounds, id_text, in_batches, pieces, settle, shuffle_partitions, slices, spread, spread_out, tidy

#: Ids a word and bits an id, by selector; 60 bits of a word carry ids.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
EVERY = 4096
BLOCK_IDS = 1 << 19
#: Bytes of text pieces and their ids that a worker process remembers.
MOST_BYTES = 256 << 20
#: Bytes of texts whose pieces are looked up together.
SLICE_BYTES = 16 << 20


_COUNTS = np.array([c for c, _ in SELECTORS])
_MOST = SELECTORS[0][0]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit words, offsets and escapes (place, value) of non-negative ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    big = np.flatnonzero(ids >= np.uint64(1 << 60))
    escapes = np.stack([big.astype(np.uint64), ids[big]], 1).ravel()
    stretches = -(-n // EVERY)
    # a stretch a row, zeros behind it
    rows = np.zeros((stretches, EVERY + _MOST), np.uint64)
    rows[:, :EVERY].flat[:n] = ids
    if len(big):
        rows[big // EVERY, big % EVERY] = 0
    # the widest id among the next 1, 2, 3, ... ids of every place says which selectors can begin there
    steps = np.array(sorted({b for _, b in SELECTORS}), np.uint8)
    reach = steps[np.searchsorted(np.uint64(1) << steps.astype(np.uint64), rows, "right")]
    choice, span = np.full(rows.shape, len(SELECTORS) - 1, np.uint8), 1
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[s]
        while span < count:  # reach[i] = max(width[i : i + span]), doubled as far as needed
            more = min(span, count - span)
            np.maximum(reach[:, :-more], reach[:, more:], out=reach[:, :-more])
            span += more
        choice[reach <= bits] = s
    jump = _COUNTS[choice]
    ends = np.minimum(EVERY, n - EVERY * np.arange(stretches))
    live, at, places = np.arange(stretches), np.zeros(stretches, np.int64), []
    while len(live):  # the next word of every stretch
        places.append(live * EVERY + at)
        at = at + jump[live, at]
        go = at < ends[live]
        live, at = live[go], at[go]
    places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    row, column = places // EVERY, places % EVERY
    selector = choice[row, column]
    words = selector.astype(np.uint64)
    flat, start = rows.ravel(), row * rows.shape[1] + column
    for s, (count, bits) in enumerate(SELECTORS):
        some = np.flatnonzero(selector == s)
        if len(some):
            word, first = words[some], start[some]
            for k in range(count):
                word |= flat[first + k] << np.uint64(4 + bits * k)
            words[some] = word
    return words, np.searchsorted(places, np.arange(0, n, EVERY)).astype(np.uint32), escapes


def unpack(words: np.ndarray, n: int, offsets: np.ndarray, escapes: np.ndarray = np.zeros(0, np.uint64), first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block of n ids, of its stretches [first, last) only; offsets say where in words these lie."""
    stretches = len(offsets)
    last = stretches if last is None else min(last, stretches)
    if first >= last:
        return np.zeros(0, np.uint64)
    low, high = int(offsets[first]), int(offsets[last]) if last < stretches else len(words)
    words, begin = words[low:high], offsets[first:last].astype(np.int64) - low
    selector = (words & np.uint64(15)).astype(np.int64)
    counts = _COUNTS[selector]
    before = np.cumsum(counts) - counts
    row = np.repeat(np.arange(last - first), np.diff(np.append(begin, len(words))))
    at = row * (EVERY + _MOST) + before - before[begin][row]
    out = np.zeros((last - first, EVERY + _MOST), np.uint64)
    flat = out.ravel()
    for s, (count, bits) in enumerate(SELECTORS):
        some = np.flatnonzero(selector == s)
        if len(some):
            word, place, mask = words[some], at[some], np.uint64((1 << bits) - 1)
            for k in range(count):
                flat[place + k] = (word >> np.uint64(4 + bits * k)) & mask
    out = out[:, :EVERY].ravel()[: n - EVERY * first]
    place, value = escapes[0::2].astype(np.int64) - EVERY * first, escapes[1::2]
    inside = (place >= 0) & (place < len(out))
    out[place[inside]] = value[inside]
    return out


class Encoder:
    """Ids of texts by the tokenizers library, which sees each piece of text between white space once for all its
    repeats as long as it is remembered; no token of the file reaches across white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark, self.mark_id = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special), (None, -1))
        self.memory = Memory(self._learn, len, MOST_BYTES)

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The pieces are encoded together, a special token between them."""
        texts = [b.decode("utf-8", "surrogatepass") for b in pieces]
        plain = [k for k, t in enumerate(texts) if "<|" not in t and self.mark]
        got = {}
        for a in range(0, len(plain), 2000):
            some = plain[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join([texts[k] for k in some])], add_special_tokens=False)[0].ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw = ids.tobytes()
            for k, x, y in zip(some, cuts[:-1], cuts[1:], strict=True):
                got[pieces[k]] = raw[4 * x + 4 : 4 * y]
        for k in set(range(len(texts))).difference(plain):
            got[pieces[k]] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        return got

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end; a null counts as empty."""
        different, numbers, ends = pieces(texts)
        ids, offsets = spread(self.memory.of(different, bytes.__add__), numbers)
        return np.frombuffer(ids, "<u4", offsets[-1] // 4), offsets[ends] // 4

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        ids, ends = self.arrays(texts)
        yield from np.split(ids, ends[:-1]) if len(ends) else ()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    settle("token_files", encoder.cache_clear)
    e = Encoder(path)
    normal = e.tokenizer.normalizer
    if normal is None or normal.normalize_str("Ab  C") != "ab c":
        raise ValueError("only files whose normaliser lower-cases and folds white space are supported")
    return e


ROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.large_binary())])
BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("offsets", pa.binary()), ("escapes", pa.binary())]
)
BLOCK_SQL = "part int, block long, before long, n_ids long, n_null long, doc_ids binary, counts binary, words binary, offsets binary, escapes binary"
TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
TOKENS_SQL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _with_end(ids: np.ndarray, ends: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids and where they end, each with the end id after it."""
    if end_id is None:
        return ids, ends
    after = ends + 1 + np.arange(len(ends))
    out = np.empty(len(ids) + len(ends), "<u4")
    own = np.ones(len(out), bool)
    own[after - 1] = False
    out[own], out[~own] = ids, end_id
    return out, after


class _Blocks:
    """Documents gathered into blocks, in the order in which they come."""

    def __init__(self):
        self.part, self.number, self.before = None, 0, 0
        self._empty()

    def _empty(self) -> None:
        self.size, self.ids, self.counts, self.doc_ids, self.n_null = 0, [], [], [], 0

    def add(self, part: int, doc_ids: np.ndarray, nulls: int, counts: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Documents of one part; those without an id, the first of them, are nulls in number."""
        if part != self.part:
            yield from self.close()
            self.part, self.number, self.before = part, 0, 0
        ends = np.cumsum(counts)
        a = 0
        while a < len(counts):
            done = int(ends[a - 1]) if a else 0
            z = min(len(counts), int(np.searchsorted(ends, done + BLOCK_IDS - self.size)) + 1)
            self.ids.append(ids[done : ends[z - 1]])
            self.counts.append(counts[a:z])
            self.doc_ids.append(doc_ids[a:z])
            self.n_null += max(0, min(z, nulls) - a)
            self.size += int(ends[z - 1]) - done
            a = z
            if self.size >= BLOCK_IDS:
                yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.counts:
            words, offsets, escapes = pack(np.concatenate(self.ids))
            doc_ids, counts = np.concatenate(self.doc_ids).astype("<i8"), np.concatenate(self.counts).astype("<i8")
            yield arrow(BLOCK, [(self.part, self.number, self.before, self.size, self.n_null, doc_ids.tobytes(), counts.tobytes(), words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), escapes.astype("<u8").tobytes())])
            self.number, self.before = self.number + 1, self.before + self.size
            self._empty()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Writes the ids of all texts, each followed by end_id if given, in ascending doc_id order.

    Parts are ranges of doc_id with about equal row counts, one to a task; equal ids stay in one part.
    """
    parts = parts or shuffle_partitions(docs.sparkSession)
    bounds = np.array(id_bounds(docs, id_col, parts), np.int64)

    def tokens(batches):
        e = encoder(tokenizer)
        for batch in slices(batches, SLICE_BYTES):
            ids, ends = _with_end(*e.arrays(batch.column(1)), end_id)
            # 16 bits an id wherever they do, for the shuffle
            ids = np.ascontiguousarray(ids, "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")
            offsets = np.concatenate([[0], ends]).astype(np.int64) * ids.itemsize
            values = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            doc_ids = batch.column(0)
            place = np.searchsorted(bounds, doc_ids.fill_null(LEAST).to_numpy(), "right").astype(np.int32)
            place[doc_ids.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(place), doc_ids, pa.array(np.diff(ends, prepend=0).astype(np.int64)), values], schema=ROW).cast(_SHORT)

    def blocks(batches):
        held = _Blocks()
        for batch in batches:
            if not batch.num_rows:
                continue
            part, n = (batch.column(k).to_numpy() for k in (0, 2))
            nulls = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(1).fill_null(0).to_numpy()
            data, at = spread_out(batch.column(3))
            width = np.where(n > 0, np.diff(at) // np.maximum(n, 1), 2)
            new = np.flatnonzero((part[1:] != part[:-1]) | (width[1:] != width[:-1])) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                ids = np.frombuffer(data[at[a] : at[z]], f"<u{int(width[a])}")
                yield from held.add(int(part[a]), doc_ids[a:z], int(nulls[a:z].sum()), n[a:z], ids)
        yield from held.close()

    rows = id_text(docs, id_col, text_col).mapInArrow(tidy(tokens, "token_files"), "part int, doc_id long, n long, ids binary")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    rows.mapInArrow(tidy(blocks, "token_files"), BLOCK_SQL).write.mode("overwrite").option("compression", "none").parquet(path)


LEAST = -(1 << 63)
_SHORT = pa.schema([*list(ROW)[:3], ("ids", pa.binary())])


def _block_ids(n: int, n_null: int, doc_ids: bytes, counts: bytes, words: bytes, offsets: bytes, escapes: bytes):
    """Of a block its documents' ids, where their tokens begin and end, and stretches of tokens, one by one."""
    names, ends = np.frombuffer(doc_ids, "<i8"), np.cumsum(np.frombuffer(counts, "<i8"))
    names = pa.array(names, pa.int64(), mask=np.arange(len(names)) < n_null)
    words, offsets, escapes = np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4"), np.frombuffer(escapes, "<u8")
    return names, np.concatenate([[0], ends[:-1]]), ends, lambda a, z: unpack(words, n, offsets, escapes, a // EVERY, -(-z // EVERY))[a % EVERY : a % EVERY + z - a]


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from the files alone."""

    def run(batches):
        for batch in batches:
            for offset, before, n, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, starts, ends, tokens = _block_ids(n, *block)
                ids = memoryview(tokens(0, n).astype("<u4")).cast("B") if n else b""
                sums = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(starts + offset + before), pa.array(ends - starts), pa.array(sums, pa.int64())], schema=TOKENS)

    blocks = spark.read.schema(BLOCK_SQL).parquet(path)
    # one row for each part, whose number is a parameter of the writer
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).collect()
    total, offset = 0, []
    for part, ids in sorted(sizes):
        offset.append((part, total))
        total += ids
    shift = spark.createDataFrame(offset, "part int, shift long")
    return blocks.join(F.broadcast(shift), "part").select("shift", "before", "n_ids", "n_null", "doc_ids", "counts", "words", "offsets", "escapes").mapInArrow(tidy(run, "token_files"), TOKENS_SQL)


def read_ids(spark: SparkSession, path: str, first: int = 0, most: int | None = None) -> DataFrame:
    """doc_id and its ids, from the one numbered first on and most of them at most; no stretch but those asked for is decoded."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for n, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, starts, ends, tokens = _block_ids(n, *block)
                starts = np.minimum(starts + first, ends)
                ends = ends if most is None else np.minimum(starts + most, ends)
                if first or most is not None:
                    ids = (tokens(a, z) for a, z in zip(starts.tolist(), ends.tolist(), strict=True))
                else:
                    ids = iter(np.split(tokens(0, n), ends[:-1]))
                yield from in_batches(zip(names.to_pylist(), (x.astype(np.int64) for x in ids), strict=True), schema, weight=lambda r: r[1].nbytes)

    return spark.read.schema(BLOCK_SQL).parquet(path).select("n_ids", "n_null", "doc_ids", "counts", "words", "offsets", "escapes").mapInArrow(tidy(run, "token_files"), "doc_id long, ids array<long>")
