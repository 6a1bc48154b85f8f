"""Connected components of links.

Up to ``LOCAL`` distinct links, counted first, one task merges them with a
disjoint-set forest. More links go through alternating star contractions: each
round moves every node's links to the smallest neighbour (large star, then small
star), so the links reach stars in a logarithmic number of rounds, and every
round's links are written to the shared folder. Nothing but counts and sums of
links reaches the driver in either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored

#: Links that one task merges at most.
LOCAL = 500_000


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, *, local: int = LOCAL) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``links(a, b)``; the root is the smallest node reachable.

    Loops and repeated links are allowed; no links give no rows.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.count() <= local:
        return now.coalesce(1).mapInArrow(_merge, "node long, root long")
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select("a", "b", "m")
        small = small.select(F.col("a"), F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = stored(small, "links")
        fresh = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if fresh == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = fresh
