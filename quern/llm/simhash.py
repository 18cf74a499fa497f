"""SimHash near-duplicates by an inverted index on positional bytes (operator 2).

A fingerprint has 8 positional bytes. Two that differ in at most k <= 4 bits share at least 8 - k of them. Of the triples
of positions, KEYS holds a set that has one inside every choice of four positions (a Turan system), so that the postings
of these triples bring every such pair together in at least one list. Inside a list the shared positional bytes of a pair
are counted, pairs under the guaranteed 8 - k are left out and the others verified by their differing bits.

Equal fingerprints are one entry. A list gives a spanning forest of its links, not its pairs. Lists longer than LONG are
not gathered: their entries meet in the midpoints of their links instead, which takes a number of rows in proportion to
the entries, over all tasks, whatever their similarity.

Null and empty texts have no words, hence fingerprint zero, and link like any other. Rows that share a doc_id count as
copies of one node if their fingerprints do; else each row keeps its own component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, id_text, in_batches, slices, tidy
from quern.llm.components import components

WORD_BYTES = bytes([0x20, *range(9, 14)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Positions in three rings of 3, 3 and 2: triples inside a ring, and two of a ring with one of the next.
RINGS = ((0, 1, 2), (3, 4, 5), (6, 7))
KEYS = [t for r in RINGS for t in combinations(r, 3)] + [(*sorted((*two, one)),) for k, r in enumerate(RINGS) for two in combinations(r, 2) for one in RINGS[(k + 1) % 3]]
LONG = 4096


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits, set where over half the shingles' XXH64 values (seed 42) have them set."""
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, 42)
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[words - 1 :]
    for a in range(0, n, 1 << 16):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a : min(n, a + (1 << 16))].tolist(), ends[a : a + (1 << 16)].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already; none: zero."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint as a signed long; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            yield from in_batches(((i, signed(fingerprint(t, words))) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)), schema)

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, fp long")


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(255)


def _forest(fps: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links of a list's spanning forest, from each entry to its part's least."""
    n = len(fps)
    root = np.arange(n)
    bytes_ = fps.view(np.uint8).reshape(n, 8)
    for a in range(0, n - 1, 256):
        rows = slice(a, min(n, a + 256))
        shared = np.zeros((rows.stop - a, n - a), np.uint8)
        for p in range(8):
            shared += bytes_[rows, p][:, None] == bytes_[a:, p][None, :]
        i, j = np.nonzero(shared >= 8 - bits)
        i, j = i + a, j + a
        keep = j > i
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        i, j = i[keep], j[keep]
        while len(i):  # roots of linked entries meet at the lesser one
            x, y = root[i], root[j]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
    least = np.full(n, np.iinfo(np.int64).max)
    signed_fps = fps.view(np.int64)
    np.minimum.at(least, root, signed_fps)
    for k in np.flatnonzero(least[root] != signed_fps).tolist():
        yield int(signed_fps[k]), int(least[root[k]])


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _short_lists(bits: int):
    def run(batches):
        def edges():
            key, held = None, []

            def close():
                fps = np.concatenate(held).view(np.uint64)
                if len(fps) > 1:
                    yield from _forest(np.ascontiguousarray(fps), bits)

            for batch in batches:
                keys, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if a == z:
                        continue
                    if held and keys[a] != key:
                        yield from close()
                        held = []
                    key = keys[a]
                    held.append(fps[a:z])
            if held:
                yield from close()

        yield from in_batches(edges(), EDGE)

    return run


def _midpoints(flips: int):
    """For an entry of a long list: the values at up to so many flips outside the list's three bytes, which stay equal."""
    schema = pa.schema([("key", pa.int64()), ("mid", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                which = key >> 24
                if which not in masks:
                    free = [np.uint64(1) << np.uint64(8 * p + b) for p in range(8) if p not in KEYS[which] for b in range(8)]
                    ways = [np.bitwise_or.reduce(np.array(c, np.uint64)) for k in range(1, flips + 1) for c in combinations(free, k)]
                    masks[which] = np.array([0, *ways], np.uint64)
                mids = (masks[which] ^ np.uint64(fp & (2**64 - 1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mids), key)), pa.array(mids), pa.array(np.full(len(mids), fp))], schema=schema)

    return run


def _meeting(lists: DataFrame, bits: int) -> DataFrame:
    """Links of long lists: those flip half the bits each and meet in the middle; for odd bounds one side flips one more."""

    def around(flips: int) -> DataFrame:
        return lists.mapInArrow(tidy(_midpoints(flips)), "key long, mid long, fp long")

    near, far = around(bits // 2), around((bits + 1) // 2)
    # whoever stands in a value within the lesser reach is linked to the least that does so within the greater, and so back
    least_far = far.groupBy("key", "mid").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = near.join(least_far, ["key", "mid"])
    if bits % 2:
        least_near = near.groupBy("key", "mid").agg(F.min("fp").alias("v"))
        links = links.unionByName(far.join(least_near, ["key", "mid"]))
    return links.where("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def links(fps: DataFrame, bits: int = 4, long: int = LONG) -> DataFrame:
    """(u, v) links that join the same fingerprints as all pairs at up to bits differing bits do. fps: distinct fp."""
    if not 0 <= bits <= 4:
        raise ValueError("the triples bring pairs of up to 4 differing bits together")
    lists = fps.select(
        "fp", F.explode(F.array(*[F.lit(k << 24).bitwiseOR(F.shiftleft(_byte(a), 16)).bitwiseOR(F.shiftleft(_byte(b), 8)).bitwiseOR(_byte(c)).cast("long") for k, (a, b, c) in enumerate(KEYS)])).alias("key")
    ).select("key", "fp")
    lengths = cut(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long))
    short = lists
    edges = None
    if lengths.limit(1).count():
        short = lists.join(lengths, "key", "left_anti")
        edges = _meeting(lists.join(lengths.select("key"), "key", "left_semi").select("key", "fp"), bits)
    near = short.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(tidy(_short_lists(bits)), "u long, v long").distinct()
    return near if edges is None else near.unionByName(edges).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id: the least doc_id that links reach, its own included."""
    rows = cut(fingerprints(docs, words, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), bits))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = joined.join(least, "root").select("fp", "component_id")
    return rows.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id by a Jaccard similarity of 0.8 or more of the shingle sets.

    The fingerprints of the sets go through links() first, and what it links is checked on the sets. Pairs at 0.8 differ in
    ten of 64 bits on average, so that no byte need be equal; those that links() can't see are found by min-hash bands.
    """
    from quern.llm.jaccard import near_duplicates as by_sets

    return by_sets(docs, words, id_col, text_col)


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
