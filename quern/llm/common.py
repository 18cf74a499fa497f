"""What the operators share: shared-folder checkpoints, doc-id ranges, batch plumbing.

Every operator selects the columns it needs under its own names first, so further columns of the input, whatever
they are called, never clash with those an operator adds.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker process remembers for an operator, by the operator's name: what gives it back.
_held: dict[str, Callable[[], None]] = {}


def settle(name: str = "", release: Callable[[], None] | None = None) -> None:
    """Gives back what the worker process remembers for operators of other names, and frees what the allocators keep."""
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    if release:
        _held[name] = release
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, name: str = ""):
    """run for mapInArrow, with memory settled before and after a task."""

    def tidied(batches):
        settle(name)
        try:
            yield from run(batches)
        finally:
            settle(name)

    return tidied


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. One of our own is set only where the session names none and runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_files(spark: SparkSession, path: str) -> None:
    """Deletes a path in whatever file system it is, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the folder all executors share."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most_bytes: int = 16 << 20) -> None:
    """Batches of texts that go to Python have so many bytes at most, unless the session has set a bound of its own.

    Spark's default of 64 MB stands several times in an executor's memory at once.
    """
    if spark.conf.get(_BATCH).lower().rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(most_bytes))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; one aggregate on the JVM side."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def id_bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """Up to parts-1 existing ids that cut the table into ranges of about equal row counts, ascending.

    Only the id column is read, and what reaches the driver is bounded by parts, not by the rows.
    """
    if parts < 2:
        return []
    cuts = docs.select(F.col(id_col).cast("long").alias("i")).agg(
        F.percentile_approx("i", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000).alias("q")
    ).first()[0]
    return sorted(set(cuts or []))


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes at most, single rows apart."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def batch_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)


def arrow(schema: str | pa.Schema, rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 5000, weight=None, most_weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded row count and, if weight is given, of bounded total weight."""
    held, w = [], 0
    for row in rows:
        held.append(row)
        w += weight(row) if weight else 0
        if len(held) >= most_rows or w >= most_weight:
            yield arrow(schema, held)
            held, w = [], 0
    if held:
        yield arrow(schema, held)


def pieces(texts: pa.Array) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """Texts cut at ASCII white space: the different pieces, each piece's number among them, and where each text's end.

    A-Z are lower-cased except in texts with a <, which may spell a special token. A null has no pieces, an empty text one
    empty piece, as has white space at either end.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lowered = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(lowered)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices, np.diff(lists.offsets.to_numpy()).cumsum()


_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _ends_in_letter(head: bytes) -> bool:
    """Whether letters still end in a letter, of any version of Unicode, once they are composed and lower-cased."""
    text = head.decode("utf-8", "replace")
    if not text.isalpha():
        return False
    last = unicodedata.normalize("NFC", text).lower()[-1]
    return last.isalpha() and unicodedata.ucd_3_2_0.category(last)[0] == "L"


def halves(piece: bytes) -> tuple[bytes, bytes] | None:
    """A piece of letters and then ASCII signs alone as these two, which every splitter by letters parts."""
    head = piece.rstrip(_SIGNS)
    if head and len(head) < len(piece) and (head.isalpha() or not head.isascii() and _ends_in_letter(head)):
        return head, piece[len(head) :]
    return None


class Memory:
    """What a function gives for pieces of text, remembered up to a number of bytes; beyond it the memory starts afresh."""

    #: Bytes that an entry takes in Python besides its texts.
    ENTRY = 190

    def __init__(self, learn, weight, most_bytes: int, longest: int = 48):
        """weight: bytes of what learn gives for a piece; pieces over longest bytes are not remembered."""
        self.learn, self.weight, self.most_bytes, self.longest, self.seen, self.size = learn, weight, most_bytes, longest, {}, 0

    def of(self, different: list[bytes], joined) -> list:
        """For each piece what learn gives, or what joined makes of its halves'."""
        if self.size > self.most_bytes:
            self.seen, self.size = {}, 0
        seen = self.seen
        out = list(map(seen.get, different))
        missing = [k for k, v in enumerate(out) if v is None]
        parts = {k: p for k in missing if (p := halves(different[k]))}
        asked = dict.fromkeys(x for k in missing for x in parts.get(k, (different[k],)))
        new = [b for b in asked if b not in seen]
        for k in range(0, len(new), 16_000):
            seen.update(self.learn(new[k : k + 16_000]))
        for k in missing:
            p = parts.get(k)
            out[k] = seen[different[k]] if p is None else joined(seen[p[0]], seen[p[1]])
        for k in parts:
            seen[different[k]] = out[k]
            new.append(different[k])
        for b in new:
            if len(b) > self.longest:
                del seen[b]
            else:
                self.size += self.ENTRY + len(b) + self.weight(seen[b])
        return out


def spread(values: list[bytes], numbers: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values of all numbers, one after the other, and where each ends."""
    return spread_out(pa.array(values, pa.binary()).take(numbers))


def spread_out(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of binary values, and where in them each begins and the last one ends."""
    buffers, n = values.buffers(), len(values)
    kind = np.dtype(np.int64 if pa.types.is_large_binary(values.type) else np.int32)
    return memoryview(buffers[2] or b""), np.frombuffer(buffers[1], kind, n + 1, kind.itemsize * values.offset)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values; wraps on purpose."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
