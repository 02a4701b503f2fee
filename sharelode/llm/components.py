"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sharelode.llm.common import stored


# Links that one task joins by itself.
LINKS_PER_TASK = 500_000


def connected(links: DataFrame) -> DataFrame:
    """`node`, `component` (the smallest node reachable) of all nodes in `links` (`a`, `b`).

    First every task joins its share of the links, which leaves one link per node and task.
    With more than one task two steps alternate until nothing changes: every node tells its larger
    neighbours, then its smaller ones, the smallest node it knows. Links only get fewer, and
    the number of rounds is about the logarithm of the longest path. Each step is a minimum per
    node, combined before the shuffle, and a join that can be split where a node has many links.
    """
    links = stored(links.select("a", "b"), "links")
    tasks = links.count() // LINKS_PER_TASK + 1
    joined = stored(links.repartition(tasks).mapInArrow(_joined, "node long, component long"), "links-joined")
    if tasks == 1:
        return joined
    edges = joined.select(F.col("node").alias("u"), F.col("component").alias("w")).filter("u > w").distinct()
    before = None
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("w").alias("y")).unionByName(
            edges.select(F.col("w").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(
            both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("w")).distinct(),
            "links-large")
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        edges = stored(
            large.join(least, "u").filter("w > m").select(F.col("w").alias("u"), F.col("m").alias("w"))
            .unionByName(least.select("u", F.col("m").alias("w"))).distinct(),
            "links-small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(20)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("w").alias("node"), F.col("w").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("w").alias("component")).unionByName(roots)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of a task's links with the smallest node that these links reach."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while above.setdefault(top, top) != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(a), root(b)))
            above[high] = low
    nodes = list(above)
    if nodes:
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])
