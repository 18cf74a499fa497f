"""Near-duplicates by the Jaccard similarity of word shingles, for the pipeline.

Two texts are linked if the sets of their shingles of five words have a similarity of 0.8 or more, which is checked on the
sets themselves (XXH64 of each shingle). The sets' SimHash fingerprints are linked first, as operator 2 does: postings of
positional bytes, shared bytes counted, up to BITS differing bits; equal fingerprints are linked too. Links that the sets
confirm join most near copies. At 0.8 some ten bits differ, so further candidates come from min-hash bands, for what is not
joined yet: BANDS lists of ROWS least values each, of which a pair at exactly 0.8 shares none with probability
(1 - 0.8 ** 5) ** 32, or 3 in a million, and a closer pair less.
Pairs with under COMMON of all 160 least values' low bytes in common aren't checked in the rounds below; at 0.8, 128 are common
on average, and under 99 with a probability below one in a million. Sets are made anew for the texts that share a list.

Only links that join two components are looked for. In each of ROUNDS rounds a list that still has several components names
one of its texts, the same one as others do where it can, and each text of another component is checked against one of those
that its lists name: a pair a text at most. Rounds are left out once the sets of all such lists fit one part. What is left is
checked inside the lists, set by set, for the entries outside a list's largest component: long lists are cut into parts of
CHUNK_BYTES of sets, each of which these entries visit, and only links come out. So a pair is left out only if it can't change
the components.

Texts of equal sets are one node, named by a 64-bit digest. Texts of under five words have one shingle, null and empty ones
none; these are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import cut, id_text, in_batches, mix64, settle, slices, tidy
from quern.llm.components import components
from quern.llm.simhash import LOWER, of_hashes, signed

WORDS = 5
#: A similarity of 4 / 5: the common shingles of both are 4 / 9 of the two sets' sizes or more.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
#: Differing bits of SimHash fingerprints up to which operator 2's postings bring every pair together.
BITS = 4
COMMON = 99
#: Rounds of one pair a text, and bytes of sets in a part of a list.
ROUNDS, CHUNK_BYTES = 2, 16 << 20
#: Links, of 16 bytes each, up to which the driver joins them.
IN_DRIVER = 1 << 16
_RANDOM = np.random.default_rng(42)
_FLIP, _TIMES = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(2))
NODE = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("low", pa.binary()), ("keys", pa.list_(pa.int64()))])
NODE_SQL = "doc_id long, node long, n long, fp long, low binary, keys array<long>"


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles' hashes, ascending; words as op2 cuts and lowers them."""
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[words - 1 :]
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64))


def least_values(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[a : a + 2048, None] ^ _FLIP) * _TIMES).min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band of least values."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix64(keys) ^ column
    return mix64(keys).view(np.int64)


def _name(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def nodes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Of each row its node, number of shingles, fingerprint, the low bytes of its least values, and its band keys; the empty set has none."""

    def run(batches):
        for batch in slices(batches):
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                least = [least_values(s) for s in sets]
                keys = [bands(x) if len(s) else np.zeros(0, np.int64) for x, s in zip(least, sets, strict=True)]
                # values spread by one more step, as a product's low bits follow its factor's
                low = [mix64(x).astype(np.uint8).tobytes() for x in least]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_name, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([signed(of_hashes(s)) for s in sets], pa.int64()), pa.array(low, pa.binary()), _lists(keys)], schema=NODE)

    return docs.mapInArrow(tidy(run), NODE_SQL)


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles) of each row."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches):
            for a in range(0, batch.num_rows, 500):
                sets = [shingles(t, words) for t in batch.column(1).slice(a, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(_name, sets), pa.int64()), _lists(sets)], schema=schema)

    return docs.mapInArrow(tidy(run), "node long, shingles array<long>")


def fingerprint_links(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) of nodes whose fingerprints are equal or linked by operator 2; the sets have yet to confirm them."""
    entries = rows.where("n > 0").select("node", "fp").distinct()
    classes = cut(entries.groupBy("fp").agg(F.min("node").alias("first")))
    equal = entries.join(classes, "fp").where("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    a, b = (classes.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "uv")
    near = simhash.links(classes.select("fp"), bits).join(a, "u").join(b, "v").select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))
    return equal.unionByName(near)


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    settle()
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BANDS * ROWS) for s in (a, b))
    return pd.Series((x == y).sum(1))


def _close(links: DataFrame, lows: DataFrame) -> DataFrame:
    """Those of the links whose least values have enough in common."""
    a, b = (lows.select(F.col("node").alias(x), F.col("low").alias(f"low_{x}")) for x in "uv")
    in_common = F.pandas_udf(_common, "int")
    return links.join(a, "u").join(b, "v").where(in_common("low_u", "low_v") >= COMMON).select("u", "v")


def _alike(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the links whose sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    common = F.size(F.array_intersect("of_u", "of_v"))
    return cut(near.join(a, "u").join(b, "v").where(common * (LEAST[0] + LEAST[1]) >= (F.size("of_u") + F.size("of_v")) * LEAST[0]).select("u", "v"))


PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class _Part:
    """The sets of a part of a list, all elements one after the other."""

    def __init__(self, node: list[int], root: list[int], sets: list[np.ndarray]):
        self.node, self.root, self.sizes = np.array(node), np.array(root), np.array([len(s) for s in sets])
        self.all, self.owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        #: components that the links of this part have joined so far
        self.above: dict[int, int] = {}

    def _top(self, root: int) -> int:
        while (up := self.above.get(root, root)) != root:
            self.above[root] = root = self.above.get(up, up)
        return root

    def links(self, node: int, root: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """Of the entries that are similar enough to a set those that join components which this part has not joined yet."""
        n = len(own)
        fit = (self.root != root) & (self.sizes * LEAST[1] >= n * LEAST[0]) & (n * LEAST[1] >= self.sizes * LEAST[0])
        if not fit.any():
            return
        bits = max(10, (8 * n).bit_length())
        marks = np.zeros(1 << bits, bool)
        slot = lambda x: (x & np.uint64((1 << bits) - 1)).astype(np.int64)
        marks[slot(own)] = True
        maybe = np.flatnonzero(marks[slot(self.all)])
        at = np.minimum(np.searchsorted(own, self.all[maybe]), n - 1)
        common = np.bincount(self.owner[maybe[own[at] == self.all[maybe]]], minlength=len(self.sizes))
        good = np.flatnonzero(fit & (common * (LEAST[0] + LEAST[1]) >= (self.sizes + n) * LEAST[0]))
        good = good[np.argsort(-common[good], kind="stable")]
        for k in good[np.unique(self.root[good], return_index=True)[1]].tolist():
            a, b, other = self._top(root), self._top(int(self.root[k])), int(self.node[k])
            if a != b:
                self.above[a] = b
                yield max(node, other), min(node, other)


def _inside(batches) -> Iterator[pa.RecordBatch]:
    """Links inside parts of lists. Rows: key, part, asks, node, root, set; a part's own entries come before those that ask."""

    def links():
        now, held, part = None, [], None
        for batch in slices(batches):
            keys, parts, asks, nodes_, roots = (batch.column(k).to_pylist() for k in range(5))
            ends = batch.column(5).offsets.to_numpy()
            values = batch.column(5).values.to_numpy().view(np.uint64)  # ascending as such
            for k, at in enumerate(zip(keys, parts, strict=True)):
                own = values[ends[k] : ends[k + 1]]
                if at != now:
                    now, held, part = at, [], None
                if not asks[k]:
                    held.append((nodes_[k], roots[k], own.copy()))
                    continue
                if part is None and held:
                    part, held = _Part(*map(list, zip(*held, strict=True))), []
                if part is not None:
                    yield from part.links(nodes_[k], roots[k], own)

    yield from in_batches(links(), PAIR)


def _left(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that share a list, all that may matter."""
    by_root = mixed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("n"))
    lists = by_root.groupBy("key").agg(F.max_by("root", F.struct("entries", "root")).alias("main"), F.ceil(F.sum("n") * 8 / CHUNK_BYTES).cast("int").alias("parts"))
    entries = mixed.join(lists, "key")
    own = entries.select("key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(False).alias("asks"), "node", "root")
    asking = entries.where("root != main").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "node", "root")
    rows = own.unionByName(asking).join(sets, "node").select("key", "part", "asks", "node", "root", "shingles")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "asks").mapInArrow(tidy(_inside), "u long, v long").distinct()


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after the links; only their ends' roots go through the search for components."""
    ends = [root.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv"]
    between = links.join(ends[0], "u").join(ends[1], "v").where("root_u != root_v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    step = components(between, in_driver=IN_DRIVER).select(F.col("node").alias("old"), F.col("root").alias("new"))
    return cut(root.join(step, root["root"] == step["old"], "left").select("node", F.coalesce("new", "root").alias("root")))


def _mixed(lists: DataFrame, root: DataFrame) -> DataFrame:
    """The entries, with their roots, of lists that have several components."""
    labelled = lists.select("key", "node", "n").join(root, "node")
    several = labelled.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a != z").select("key")
    return cut(labelled.join(several, "key", "left_semi"))


def _named(mixed: DataFrame, salt: int) -> DataFrame:
    """(u, v): of each entry one pair with a text that a list of it names and that is of another component."""
    order = F.xxhash64(F.lit(salt), "node") if salt else F.col("node")
    centre = mixed.groupBy("key").agg(F.min(F.struct(order.alias("h"), "node", "root")).alias("c"))
    others = mixed.join(centre, "key").where("root != c.root").groupBy("node").agg(F.min(F.struct("c.h", "c.node")).alias("c"))
    return others.select(F.greatest("node", "c.node").alias("u"), F.least("node", "c.node").alias("v")).distinct()


def _set_bytes(mixed: DataFrame) -> int:
    """Bytes of the sets of all entries."""
    return 8 * (mixed.agg(F.sum("n")).first()[0] or 0)


def _all(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, links).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id: the least doc_id that links reach, its own included."""
    docs = id_text(docs, id_col, text_col)
    rows = cut(nodes(docs, words))
    near = cut(fingerprint_links(rows))
    lists = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).select("node", "n", F.explode("keys").alias("key"))
    shared = lists.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1").select("key")
    mixed = cut(lists.join(shared, "key", "left_semi").select("key", "node", "n", F.col("node").alias("root")))
    # the sets of all that may be asked for, made anew from one row each
    root = cut(mixed.select("node").union(near.select("u")).union(near.select("v")).distinct().withColumn("root", F.col("node")))
    asked = rows.join(root.select("node"), "node", "left_semi")
    lows = cut(asked.groupBy("node").agg(F.first("low").alias("low")))
    ids = asked.groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct()
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = cut(sets_of(texts, words).groupBy("node").agg(F.first("shingles").alias("shingles")))
    waiting = [near]
    for salt in range(ROUNDS):
        if _set_bytes(mixed) <= CHUNK_BYTES:
            break
        root = _joined(root, _alike(_all([*waiting, _close(_named(mixed, salt), lows)]), sets))
        mixed, waiting = _mixed(mixed, root), []
    found = [_alike(near, sets) for near in waiting]
    if _set_bytes(mixed):
        found.append(cut(_left(mixed, sets)))
    if found:
        root = _joined(root, _all(found))
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("first")).join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = classes.join(least, "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "component_id")
