"""Connected components of a table of links, by union-find in parts and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.session import checkpoint


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of one partition by a forest: each node and its root.

    Memory holds one entry per node of at most ``limit`` links at a time.
    """
    limit, parent, kind = 1 << 20, {}, None

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def flush():
        nodes = [x for x in parent if parent[x] != x]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["a", "b"])
        parent.clear()
        return out

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > limit:
            yield flush()
    if parent:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the smallest node that can be reached.

    Each pass first contracts the links of every partition by union-find, then
    joins all neighbours of a node to the smallest of them (large star), then
    each node's smaller neighbours (small star).  Passes are few, since a group's
    width falls at least by half.  Nothing gathers a group: a node's smallest
    neighbour is an aggregate that Spark forms in part before it shuffles.
    A table without links gives no rows; nulls are not links.
    """
    kind = links.schema["a"].dataType.simpleString()
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = checkpoint(links.mapInArrow(_forest, f"a {kind}, b {kind}"))
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # Large star: larger neighbours of a node go to the smallest.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: the node and its smaller neighbours go to the smallest.
        down = large.where("b < a").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        new = checkpoint(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        # Done when every node has one parent and no parent has one.
        busy = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").limit(1)
        chain = new.select(F.col("b").alias("a")).distinct().join(new.select("a"), "a", "left_semi").limit(1)
        if not busy.unionByName(chain).take(1):
            break
        links = new
    roots = new.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
