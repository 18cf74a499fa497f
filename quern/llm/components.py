"""Connected components of an edge table by alternating large-star and small-star steps.

Edges and labels stay in tables; the driver sees one count a round. Every round is cut in the shared folder, so that a lost
executor costs one round at most. A round is some ten stages, whose threads and plans the driver holds for a while; where the
caller allows it, edges that are few enough are joined in the driver instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node's larger neighbours get the least of the node and its neighbours as theirs; else the others do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    return linked.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m")).where("a != m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def _in_driver(edges: DataFrame) -> DataFrame:
    """components() of an edge table of longs that fits the driver."""
    got = edges.toArrow()
    nodes, ends = np.unique(np.concatenate([got.column(k).to_numpy() for k in "uv"]), return_inverse=True)
    a, b = ends[: got.num_rows], ends[got.num_rows :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():  # roots of joined nodes meet at the lesser one
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    hangs = root != np.arange(len(nodes))
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes[hangs], pa.int64()), "root": pa.array(nodes[root[hangs]], pa.int64())}))


def components(edges: DataFrame, most_rounds: int = 60, in_driver: int = 0) -> DataFrame:
    """(node, root) for each node of an edge with a smaller one in its component; root is the component's least node.

    edges: columns u and v of one orderable type. Rows with u = v or a null are of no account. in_driver: up to so many edges,
    of longs, are joined in the driver at once, 16 bytes each.
    """
    edges = cut(edges.select("u", "v").where("u != v").distinct())
    if in_driver and edges.count() <= in_driver:
        return _in_driver(edges)
    before = None
    for _ in range(most_rounds):
        edges = cut(_star(_star(edges, True), False))
        # both steps done without a change: every node hangs on its root
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
