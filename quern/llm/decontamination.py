"""Benchmark decontamination with an FM-index for each training shard (operator 6).

A shard is a bounded piece of the documents inside a task. Its words become numbers: words of the benchmark get their own,
and whatever cannot be part of an occurrence, that is runs of benchmark words shorter than the shortest window, is left out
without loss; a mark separates the runs. Over that text the shard builds a suffix array, its Burrows-Wheeler transform as
a wavelet tree with rank blocks, and a sampled suffix array. All windows are searched backwards side by side, word by word
from their ends, by two ranks a step; occurrences are located by walking to the next sampled suffix. Their spans are
merged into removal spans.

The benchmark is read in blocks of BLOCK_BYTES of text, each searched in all documents, so that what a task holds of it
has a fixed bound; one block, the usual case, takes no shuffle. Windows are given in item words: an item of fewer than
`size` words, but not none, is one window. Null and empty texts have no words: such documents come back with zeros, such
items match nothing. Equal items each count; an item without an id marks words, but isn't listed. Item ids may be of any
type and are compared as text. Rows that share a doc_id are rows of their own, as are those without one. Empty tables give
an empty result or no hits.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, id_text, in_batches, settle, slices, text_bytes, tidy

#: What separates words: ASCII apart from digits and letters.
NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK_BYTES = 8 << 20
SAMPLE = 16
SHARD_WORDS = 1 << 19


def split(text: str | None) -> list[str]:
    """Words, A-Z lower-cased."""
    return WORD.findall(text.translate(_UPPER)) if text else []


class Wavelet:
    """Rank of any value before any place, one bit plane a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            plane = (values >> b) & 1
            self.planes.append(np.concatenate([[0], np.cumsum(plane)]).astype(np.int32))
            self.zeros.append(int(len(values) - plane.sum()))
            values = np.concatenate([values[plane == 0], values[plane == 1]])
        self.last = values

    def rank(self, value: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often value, which has no more than bits bits, stands in front of place before; both are arrays."""
        low = np.zeros(len(before), np.int64)
        high = before.astype(np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros, one = self.planes[level], self.zeros[level], ((value >> b) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def at(self, place: np.ndarray) -> np.ndarray:
        place = place.astype(np.int64)
        for level in range(self.bits):
            ones, zeros = self.planes[level], self.zeros[level]
            before = ones[place]
            one = ones[place + 1] > before
            place = np.where(one, zeros + before, place - before)
        return self.last[place]


class FmIndex:
    """Backward search and location in a text of non-negative numbers; 0 is a mark that no phrase holds."""

    def __init__(self, text: np.ndarray):
        text = np.append(np.asarray(text, np.int64) + 1, 0)  # the end is a letter of its own, below all others
        self.n = n = len(text)
        suffix = self._suffixes(text)
        bwt = text[suffix - 1]
        self.tree = Wavelet(bwt, max(1, int(text.max()).bit_length()))
        # first[c]: suffixes that begin with a lesser letter than c, for letters up to the greatest and one more
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.sampled = np.where(suffix % SAMPLE == 0, suffix, -1)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Rotations in order, by doubling; rotations keep the last-to-first walk a permutation."""
        n, span, rank = len(text), 1, text
        while True:
            order = np.lexsort((np.roll(rank, -span), rank))
            a, b = rank[order], np.roll(rank, -span)[order]
            new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            rank = np.empty(n, np.int64)
            rank[order] = new
            span *= 2
            if new[-1] == n - 1 or span >= n:
                return order

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases: one a row, aligned at their ends."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        top = len(self.first) - 1  # letters from here on do not occur
        for k in range(1, phrases.shape[1] + 1):
            c = phrases[live, -k] + 1
            done = lengths[live] < k
            known = (c < top) & (c > 1)
            high[live[~done & ~known]] = low[live[~done & ~known]]
            go = live[~done & known]
            c = c[~done & known]
            low[go] = self.first[c] + self.tree.rank(c, low[go])
            high[go] = self.first[c] + self.tree.rank(c, high[go])
            live = go[high[go] > low[go]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the text at which the suffixes of rows begin."""
        place, steps, at = np.full(len(rows), -1, np.int64), 0, rows.astype(np.int64)
        live = np.arange(len(rows))
        while len(live):
            found = self.sampled[at[live]]
            hit = found >= 0
            place[live[hit]] = found[hit] + steps
            live = live[~hit]
            c = self.tree.at(at[live])
            at[live] = self.first[c] + self.tree.rank(c, at[live])
            steps += 1
        return place


class Phrases:
    """The windows of some items as numbers."""

    def __init__(self, items: list[tuple], size: int):
        self.size, self.word, texts = size, {}, []
        for _, text in items:
            texts.append(np.array([self.word.setdefault(w, len(self.word) + 1) for w in split(text)], np.int32))
        # a window a row, aligned at its end, zeros before it
        lengths = np.array([len(t) for t in texts], np.int64)
        many = np.where(lengths > 0, np.maximum(1, lengths - size + 1), 0)
        table = np.zeros((int(many.sum()), size), np.int32)
        at = 0
        for words, n in zip(texts, many.tolist(), strict=True):
            if len(words) >= size:
                table[at : at + n] = np.lib.stride_tricks.sliding_window_view(words, size)
            elif n:
                table[at, size - len(words) :] = words
            at += n
        owner = np.repeat(np.arange(len(items)), many)
        self.table, number = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, owner)
        self.lengths = (self.table > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(self.table) else 0
        # the ids of the items that have a window, window by window
        pairs = np.unique(np.column_stack([number.ravel(), owner]), axis=0)
        self.owner_ends, self.owners, self.names = np.searchsorted(pairs[:, 0], np.arange(len(self.table)), "right"), pairs[:, 1], [i for i, _ in items]

    def items(self, window: int) -> list:
        a = self.owner_ends[window - 1] if window else 0
        return [self.names[k] for k in self.owners[a : self.owner_ends[window]].tolist()]

    def hits(self, numbers: np.ndarray, ends: np.ndarray):
        """Occurrences in documents laid end to end: window, place of its first word. ends: where each document ends."""
        if not len(self.lengths) or not len(numbers):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = numbers > 0
        breaks = np.zeros(len(numbers) + 1, bool)
        breaks[0] = breaks[-1] = True
        breaks[ends[ends < len(numbers)]] = True
        breaks[1:] |= ~known
        breaks[:-1] |= ~known
        cuts = np.flatnonzero(breaks)
        starts, length = cuts[:-1], np.diff(cuts)
        keep = known[starts] & (length >= self.shortest)
        starts, length = starts[keep], length[keep]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # each kept run, then a mark
        room = length + 1
        place = np.repeat(starts - (np.cumsum(room) - room), room) + np.arange(room.sum())
        text = np.where(np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) < np.repeat(length, room), numbers[np.minimum(place, len(numbers) - 1)], 0)
        index = FmIndex(text)
        low, high = index.search(self.table, self.lengths)
        count = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return window, place[index.locate(rows)]


HITS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])
HITS_SQL = "doc_id long, key long, n_words long, spans array<array<int>>, items array<string>"


def _merge(spans) -> list[list[int]]:
    """Sorted spans [first, end) of words without overlaps."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _scan(items: list[tuple], size: int, hit_only: bool):
    def run(batches):
        phrases = Phrases(items, size)
        number = phrases.word.get

        def finish(held, numbers, ends):
            numbers, ends = np.array(numbers, np.int64), np.array(ends, np.int64)
            window, place = phrases.hits(numbers, ends)
            doc = np.searchsorted(ends, place, "right")
            found: dict[int, tuple[list, set]] = {}
            begin = np.concatenate([[0], ends[:-1]])
            for w, p, d in zip(window.tolist(), place.tolist(), doc.tolist(), strict=True):
                spans, got = found.setdefault(d, ([], set()))
                a = p - int(begin[d])
                spans.append((a, a + int(phrases.lengths[w])))
                got.add(w)
            for k, (i, key) in enumerate(held):
                spans, got = found.get(k, ((), ()))
                if spans or not hit_only:
                    names = {name for w in got for name in phrases.items(w) if name is not None}
                    yield i, key, int(ends[k] - begin[k]), _merge(spans), sorted(names)

        def rows():
            held, numbers, ends = [], [], []
            for batch in slices(batches):
                for i, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append((i, key))
                    numbers.extend([number(w, 0) for w in split(text)])
                    ends.append(len(numbers))
                    if len(numbers) >= SHARD_WORDS:
                        yield from finish(held, numbers, ends)
                        held, numbers, ends = [], [], []
            if held:
                yield from finish(held, numbers, ends)

        yield from in_batches(rows(), HITS)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most_bytes: int = BLOCK_BYTES):
    """The benchmark in lists of (item, text) of bounded bytes, one at a time; items' ids as text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = text_bytes(items)
    n = max(1, -(-total // most_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


#: Merged spans of sorted ones, as an expression.
_JOINED = """aggregate(spans, cast(array() as array<array<int>>), (acc, x) ->
    if(size(acc) > 0 and x[0] <= acc[size(acc) - 1][1],
       concat(slice(acc, 1, size(acc) - 1), array(array(acc[size(acc) - 1][0], greatest(x[1], acc[size(acc) - 1][1])))),
       concat(acc, array(x))))"""


def _united(parts: list[DataFrame]) -> DataFrame:
    """The hits of all blocks in each different document: by doc_id and text."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("doc_id", "key").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return merged.select("doc_id", "key", "n_words", F.expr(_JOINED).alias("spans"), "items")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each row doc_id, n_words, merged removal spans [first, end) in words, and the ids of the items found, as text."""
    docs = _keyed(docs, id_col, text_col)
    lists = list(blocks(benchmark, item_col, text_col, most_bytes))
    if len(lists) == 1:
        return docs.mapInArrow(tidy(_scan(lists[0], size, False)), HITS_SQL).drop("key")
    every = docs.mapInArrow(tidy(_scan([], size, False)), HITS_SQL).select("doc_id", "key", "n_words")
    found = _united([docs.mapInArrow(tidy(_scan(items, size, True)), HITS_SQL) for items in lists]).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "spans", "items")
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def n_hit(spans: str = "spans"):
    return F.expr(f"aggregate({spans}, 0L, (n, x) -> n + x[1] - x[0])")


def remove(text: str, spans: list) -> str:
    """The text without the words of spans and the separators inside them; all else stays as it is."""
    if not spans:
        return text
    words, out, at = list(WORD.finditer(text.translate(_UPPER))), [], 0
    for a, z in spans:
        out.append(text[at : words[a].start()])
        at = words[z - 1].end()
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with their columns: contaminated rows are dropped, smaller hits cut out of the others' texts."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        settle()
        return pd.Series([remove(t, [list(x) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    rows = _keyed(docs, id_col, text_col)
    # hits belong to a text under an id, so that rows which share an id each get their own
    hit_id, hit_key, bad, cuts = fresh(docs, "hit_id", "hit_key", "bad", "spans")
    found = _united([rows.mapInArrow(tidy(_scan(items, size, True)), HITS_SQL) for items in blocks(benchmark, item_col, text_col, most_bytes)]).withColumn("n_hit", n_hit())
    hits = found.select(F.col("doc_id").alias(hit_id), F.col("key").alias(hit_key), contaminated().alias(bad), F.col("spans").alias(cuts))
    text = F.col(text_col).cast("string")
    joined = docs.join(hits, F.col(id_col).cast("long").eqNullSafe(F.col(hit_id)) & (F.xxhash64(text) == F.col(hit_key)), "left").where(F.col(bad).isNull() | ~F.col(bad))
    # Python gets the texts that change only
    cut_out = F.when(F.col(cuts).isNull(), text).otherwise(without(F.when(F.col(cuts).isNotNull(), text), F.coalesce(cuts, F.array().cast("array<array<int>>"))))
    return joined.withColumn(text_col, cut_out).select(*docs.columns)
