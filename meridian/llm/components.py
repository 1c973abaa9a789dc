"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize


def spanning_stars(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find over some pairs: every node that is not a root, with its root (the smallest node)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x] = top
            x = up
        return top

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch of edges by a star forest with the same components: never more edges than before."""
    for batch in batches:
        stars = spanning_stars(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(stars.keys(), pa.int64()), pa.array(stars.values(), pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v: long) to (node, root): each node that has an edge, with the smallest node it reaches.

    Self loops and repeated edges are allowed; no edges give no rows. Every step is a partial
    aggregation and a join that adaptive execution can split, so a node with very many edges is
    never gathered in one task. Each round is written to the shared folder.
    """
    stars = "u long, v long"
    now = materialize(arrow_map(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v"), _contract, stars).distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        # large-star: link every larger neighbour to the smallest node around
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: link the smaller neighbours and the node itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(low, large["u"] == low["k"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
