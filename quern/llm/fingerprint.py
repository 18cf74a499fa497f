"""Document fingerprints from prefix polynomial hashes (operator 7).

Over a text's code points, prefix arrays hold the polynomial hash of every prefix modulo two primes. They are the text's
fingerprint: the hash of any span is a difference of two entries, so that any two spans are compared in one step and the
longest common extension of two places is found by binary search. The fingerprint column names them by length and both
whole hashes.

The likeness of two fingerprints is the share of both texts' code points that lie in common spans of a width or more. The
longest common extensions of the two beginnings and of the two ends come by binary search; all spans of the width between
them are looked up among the other text's. The shorter of the two texts chooses the width for both: 24 from 96 code points
on, 6 from 16 on, 2 from 4 on, else 1. It is 1 for equal texts.

Null texts count as empty; the empty text is like itself only. Equal texts have equal fingerprints. Rows that share a doc_id
stand in the order of their texts. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_bounds, id_text, in_batches, shuffle_partitions, slices, tidy

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911_382_323, 972_663_749)
#: Widths of spans, and the length from which the shorter of two texts is compared by them.
SPANS = ((24, 96), (6, 16), (2, 4), (1, 1))


@lru_cache(2)
def _powers(which: int, bits: int) -> np.ndarray:
    """base ** k modulo the prime for k below 2 ** bits, doubled up."""
    p, out = PRIMES[which], np.ones(1, np.int64)
    step = BASES[which]
    for _ in range(bits):
        out, step = np.concatenate([out, out * step % p]), step * step % p
    return out


def powers(which: int, n: int) -> np.ndarray:
    return _powers(which, max(12, int(n).bit_length()))


class Prefixes:
    """Prefix arrays of a text."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.n, self.sums, self.kept = len(code), [], {}
        for k, p in enumerate(PRIMES):
            terms = code * powers(k, self.n)[: self.n] % p
            self.sums.append(np.concatenate([[0], np.cumsum(terms)]) % p)

    @property
    def name(self) -> str:
        """Hex: length (16 digits) and both whole hashes (8 and 8)."""
        return f"{self.n:016x}" + "".join(f"{int(s[-1]):08x}" for s in self.sums)

    def equal(self, a: int, other: Prefixes, b: int, length: int) -> bool:
        """Whether the spans of that length at a here and at b there are equal, up to collisions modulo both primes."""
        if a + length > self.n or b + length > other.n:
            return False
        low = min(a, b)
        for k, p in enumerate(PRIMES):
            here = int(self.sums[k][a + length]) - int(self.sums[k][a])
            there = int(other.sums[k][b + length]) - int(other.sums[k][b])
            if a != b:
                raised = powers(k, max(a, b))
                here, there = here * int(raised[b - low]), there * int(raised[a - low])
            if (here - there) % p:
                return False
        return True

    def _longest(self, most: int, same) -> int:
        """The greatest length for which same holds, which holds for all lesser ones too."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    def extension(self, a: int, other: Prefixes, b: int) -> int:
        """Length of the longest common extension of the two places, by binary search."""
        return self._longest(min(self.n - a, other.n - b), lambda k: self.equal(a, other, b, k))

    def ending(self, other: Prefixes) -> int:
        """Length of the longest common end."""
        return self._longest(min(self.n, other.n), lambda k: self.equal(self.n - k, other, other.n - k, k))

    def spans(self, width: int) -> np.ndarray:
        """Hashes, modulo both primes, of all spans of that width, the same wherever they stand."""
        if width not in self.kept:
            out = np.zeros(self.n - width + 1, np.int64)
            for k, p in enumerate(PRIMES):
                raised = (self.sums[k][width:] - self.sums[k][:-width]) % p
                back = powers(k, self.n)[self.n - width :: -1][: len(raised)]
                out = out << 32 | raised * back % p * int(pow(BASES[k], _TOP - self.n, p)) % p
            self.kept[width] = out
        return self.kept[width]


#: All spans are raised to this power in the end, above any text's length.
_TOP = 1 << 40


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where x has values of y. A table of marks sorts out most of both before they are compared."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64)
    mask = (1 << int(8 * max(len(x), len(y))).bit_length()) - 1
    marks = np.zeros(mask + 1, bool)
    slot = x & mask
    other = y & mask
    marks[other] = True
    some = np.flatnonzero(marks[slot])
    if not len(some):
        return some
    marks[:] = False
    marks[slot[some]] = True
    left = np.sort(y[marks[other]])
    return some[left[np.minimum(np.searchsorted(left, x[some]), len(left) - 1)] == x[some]]


def _covered(this: Prefixes, other: Prefixes, width: int, begin: int, end: int) -> int:
    """Code points of this in spans of the width that the other has. begin, end: the longest common beginning and end."""
    change = np.zeros(this.n + 1, np.int32)
    for a, z in ((0, begin), (this.n - end, this.n)):
        if z - a >= width:
            change[a] += 1
            change[z] -= 1
    low = begin - width + 1 if begin >= width else 0
    high = this.n - end if end >= width else this.n - width + 1
    if low < high:
        at = _among(this.spans(width)[low:high], other.spans(width)) + low
        change[at] += 1
        change[at + width] -= 1
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def likeness(a: Prefixes, b: Prefixes) -> float:
    if a.n == b.n and a.equal(0, b, 0, a.n):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    width = next(w for w, least in SPANS if min(a.n, b.n) >= least)
    begin = a.extension(0, b, 0) if a.equal(0, b, 0, width) else 0
    end = a.ending(b) if a.equal(a.n - width, b, b.n - width, width) else 0
    return (_covered(a, b, width, begin, end) + _covered(b, a, width, begin, end)) / (a.n + b.n)


def fingerprint(text: str) -> str:
    return Prefixes(text).name


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ROW_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order; each range's last row is followed by the next range's first, which is only looked at."""

    def rows():
        held = None
        for batch in slices(batches):
            for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                now = (part, ahead, doc_id, text, Prefixes(text))
                if held is not None and not held[1] and held[0] == part:
                    yield _row(held, now)
                held = now

    yield from in_batches(rows(), ROW)


def _row(this, following):
    _, _, doc_id, text, prefixes = this
    changed = edited(text, following[3])
    other = prefixes if changed == text else Prefixes(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), prefixes.name, other.name, likeness(prefixes, other), likeness(prefixes, following[4])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(part, ahead, doc_id, text) dealt and sorted so that each row is followed by the next document.

    Parts are ranges of doc_id between existing ids. The first document of a range also goes, marked ahead, to the end of
    the range before it, that of the first range to the end of the last one. Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    docs = id_text(docs, id_col, text_col)
    bounds = id_bounds(docs, "doc_id", parts)
    least = docs.agg(F.min("doc_id")).first()[0]
    firsts = sorted({b for b in bounds if b != least} | ({least} if least is not None else set()))
    last = len(firsts) - 1
    # edges in rows of about the root of their number: a row counts the rows that begin at or before its id, then the edges
    # of the last of these
    width = max(1, math.isqrt(len(firsts)))
    chunks = [firsts[k : k + width] for k in range(0, len(firsts), width)]
    edges = F.array(*[F.array(*[F.lit(b).cast("long") for b in c]) for c in chunks]) if chunks else F.array().cast("array<array<long>>")
    placed = docs.withColumn("edges", edges).withColumn("c", F.expr("aggregate(edges, 0, (n, e) -> n + int(e[0] <= doc_id))"))
    placed = placed.withColumn("row", F.expr("try_element_at(edges, if(c > 0, c, null))")).withColumn("r", F.expr("aggregate(row, 0, (n, b) -> n + int(b <= doc_id))"))
    placed = placed.withColumn("part", F.coalesce(F.expr(f"(c - 1) * {width} + r - 1"), F.lit(0)))
    first = F.coalesce(F.expr("row[r - 1] = doc_id"), F.lit(False))
    before = F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1)
    copies = F.when(first, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead")), F.struct(before.alias("part"), F.lit(True).alias("ahead")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))))
    rows = placed.select(F.explode(copies).alias("c"), "doc_id", "text").select("c.part", "c.ahead", "doc_id", "text")
    return rows.repartitionById(max(1, len(firsts)), F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, its edited text's, and their likeness and that to the next document's.

    Documents are in the order of (doc_id, text), nulls first; after the last comes the first of the least non-null doc_id.
    """
    return with_next(docs, id_col, text_col).mapInArrow(tidy(_walk), ROW_SQL)
