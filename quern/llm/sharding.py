"""Shards of near equal bytes by minimax contiguous partition (operator 3); DataFrame and SQL functions only.

Documents with equal texts are one group and stay together. Groups are laid out in the order of a hash of their text; the
ATOMS leading values of that hash make the ordered atoms, whose sizes fit one row whatever the corpus holds. A binary
search finds the least capacity with which filling shards greedily, in that order, takes no more shards than there are;
the shards are cut there. As cuts lie between atoms, the capacity is over that of the best cuts between single groups by less
than one atom's bytes, on average a 65,536th of all. An atom that alone outweighs an equal share of what is left, such as a very large group of
copies, gets a shard of its own first, so that it doesn't set the capacity of the others.

A null text has no bytes and counts as empty for its hash and checksum. Rows that share a doc_id are rows of their own. An
empty table gives an empty result. A shard may stay empty if there are fewer atoms than shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, id_text

#: Leading hash values; so many numbers are gathered in one row, about 1.5 MB, for any input.
ATOMS = 1 << 16
OVERHEAD = 16
#: Cells of a shard in which rows are numbered apart, so that no task numbers a whole shard.
CELLS = 256


def _plan(atoms: DataFrame, shards: int) -> DataFrame:
    """(atom, shard) for a table (atom, bytes) of at most ATOMS rows."""
    row = atoms.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("atom")))).alias("falling"), F.sum("bytes").alias("total")).where("total is not null")
    row = row.withColumn(
        "own",
        F.expr(
            f"""aggregate(slice(falling, 1, {shards - 1}), named_struct('n', 0, 'rest', total, 'go', true), (acc, x) ->
                if(acc.go and -x.less * ({shards} - acc.n) > acc.rest,
                   named_struct('n', acc.n + 1, 'rest', acc.rest + x.less, 'go', true),
                   named_struct('n', acc.n, 'rest', acc.rest, 'go', false)))"""
            if shards > 1
            else "named_struct('n', 0, 'rest', total, 'go', false)"
        ),
    )
    row = row.select(
        F.slice("falling", 1, F.col("own.n")).alias("large"),
        F.expr("array_sort(transform(slice(falling, own.n + 1, size(falling)), x -> named_struct('atom', x.atom, 'bytes', -x.less)))").alias("small"),
        (F.lit(shards) - F.col("own.n")).alias("k"),
        F.col("own.rest").alias("rest"),
    )
    # written in between: an expression that a lambda function names would be worked out again for every element
    row = cut(row.withColumn("most", F.expr("coalesce(array_max(transform(small, x -> x.bytes)), 0L)")))
    row = row.withColumn(
        "capacity",
        F.expr(
            """aggregate(sequence(1, 63), named_struct('lo', greatest(most, (rest + k - 1) div k), 'hi', greatest(most, (rest + k - 1) div k) + most),
                 (acc, step) -> if(acc.lo >= acc.hi, acc,
                   if(aggregate(small, named_struct('load', 0L, 'used', 1),
                        (s, x) -> if(s.load + x.bytes <= (acc.lo + acc.hi) div 2,
                                     named_struct('load', s.load + x.bytes, 'used', s.used),
                                     named_struct('load', x.bytes, 'used', s.used + 1))).used <= k,
                      named_struct('lo', acc.lo, 'hi', (acc.lo + acc.hi) div 2),
                      named_struct('lo', (acc.lo + acc.hi) div 2 + 1, 'hi', acc.hi)))).lo"""
        ),
    )
    row = cut(row).withColumn(
        "firsts",
        F.expr(
            """aggregate(small, named_struct('load', 0L, 'firsts', cast(array() as array<int>)),
                 (s, x) -> if(size(s.firsts) > 0 and s.load + x.bytes <= capacity,
                              named_struct('load', s.load + x.bytes, 'firsts', s.firsts),
                              named_struct('load', x.bytes, 'firsts', array_append(s.firsts, x.atom)))).firsts"""
        ),
    )
    return cut(row).select(
        F.explode(
            F.expr(
                """concat(transform(large, (x, i) -> named_struct('atom', x.atom, 'shard', i)),
                          transform(small, x -> named_struct('atom', x.atom, 'shard', size(large) - 1 + size(filter(firsts, f -> f <= x.atom)))))"""
            )
        ).alias("at")
    ).select("at.atom", "at.shard")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null: the law is bytes)."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        id_text(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % ATOMS).cast("int").alias("atom"),
        )
    )
    # at most ATOMS rows of two numbers
    at = cut(_plan(rows.groupBy("atom").agg(F.sum("size").alias("bytes")), shards))
    placed = rows.join(F.broadcast(at), "atom").withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int"))
    cells = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    # at most shards x CELLS rows
    before = cells.select("shard", "cell", F.expr("sum(n) over (partition by shard order by cell rows between unbounded preceding and current row) - n").alias("before"))
    numbered = placed.withColumn("number", F.expr("row_number() over (partition by shard, cell order by doc_id, text_crc32, size) - 1"))
    return numbered.join(F.broadcast(before), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
