"""Directed labelled edges (src, label, dst, ...): neighbours, bounded traversal and unweighted paths.

Traversals advance a frontier by one join a step; visited nodes and paths are tables, cut through the checkpoint folder
every step so that plans stay short and lost executors cost one step.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LimitExceeded

MAX_DEPTH, MAX_EXPANSION = 3, 10_000
#: Nodes of a frontier that are broadcast at most; beyond, a shuffle join.
BROADCAST = 100_000


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the new ones in place of those of the same (src, label, dst)."""
    key = ["src", "label", "dst"]
    return edges.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates(key), allowMissingColumns=True)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "label", "dst").distinct(), ["src", "label", "dst"], "left_anti")


def _labelled(edges: DataFrame, label: str | None) -> DataFrame:
    return edges if label is None else edges.filter(F.col("label") == label)


def neighbors(edges: DataFrame, src, label: str | None = None) -> DataFrame:
    """Outgoing neighbours, shorter names first, then in order."""
    return _labelled(edges, label).filter(F.col("src") == src).select(F.col("dst").alias("node")).distinct().orderBy(F.length(F.col("node").cast("string")), "node")


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="multiweave-"))
    return df.checkpoint(eager=True)


def k_hop(edges: DataFrame, start, label: str | None = None, *, max_depth: int = MAX_DEPTH, max_expansion: int = MAX_EXPANSION) -> DataFrame:
    """(node, depth) of the nodes within max_depth steps, the start left out. More than max_expansion of them is an error."""
    spark = edges.sparkSession
    own = _labelled(edges, label).select("src", "dst").filter("src <> dst")
    seen = spark.createDataFrame([(start, 0)], "node " + dict(edges.dtypes)["src"] + ", depth int")
    front, total, n = seen.select("node"), 0, 1
    for depth in range(1, max_depth + 1):
        step = own.join(F.broadcast(front) if n <= BROADCAST else front, own.src == front.node).select(F.col("dst").alias("node")).distinct()
        front = _cut(step.join(seen, "node", "left_anti"))
        n = front.count()
        total += n
        if total > max_expansion:
            raise LimitExceeded(f"more than {max_expansion} nodes are reached")
        if not n:
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.filter("depth > 0").orderBy("depth", F.length(F.col("node").cast("string")), "node")


def shortest_path(edges: DataFrame, start, end, label: str | None = None, *, max_depth: int = MAX_DEPTH, max_expansion: int = MAX_EXPANSION) -> list | None:
    """The nodes of a shortest path with both ends, or None if there is none of max_depth steps; of equal ones the first in order."""
    if start == end:
        return [start]
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    own = _labelled(edges, label).select("src", "dst").filter("src <> dst")
    front = seen = spark.createDataFrame([(start, [start])], f"node {kind}, path array<{kind}>")
    total, n = 0, 1
    for _ in range(max_depth):
        step = own.join(F.broadcast(front) if n <= BROADCAST else front, own.src == front.node).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = _cut(step.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti"))
        if found := front.filter(F.col("node") == end).head():
            return list(found["path"])
        n = front.count()
        total += n
        if total > max_expansion:
            raise LimitExceeded(f"more than {max_expansion} nodes are reached")
        if not n:
            return None
        seen = seen.unionByName(front)
    return None
