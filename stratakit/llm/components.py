"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import checkpointed, with_class


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a long, b long) edges -> (node, component): the smallest node reachable from each node with an edge.

    Alternates large-star and small-star steps until the edges stand still: every node then
    points at its component's smallest node. Each step is an aggregate and an equi-join on node
    ids; only an edge count and a checksum reach the driver, and each round is checkpointed.
    Self loops and repeated edges do no harm; an empty table gives an empty result.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = checkpointed(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct())
    before, rows = None, now.count()
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large-star: every larger neighbour of a node is moved to the node's smallest neighbour (or itself)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = with_class(now.select(F.col("a").alias("v"), F.col("b").alias("a")), least, ["a"], "n", 2 * rows, ["m"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.where("a <> b").distinct())
        # small-star: a node and its smaller neighbours are moved to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_class(large, down, ["a"], "n", rows, ["m"]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        now = checkpointed(small.where("a <> b").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before, rows = tuple(mark), mark[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over 0..n-1 for use inside one task; roots are the smallest members."""

    def __init__(self, n: int):
        import numpy as np

        self.up = np.arange(n, dtype=np.int64)

    def roots(self, x):
        up = self.up
        r = up[x]
        while True:
            nxt = up[r]
            if (nxt == r).all():
                up[x] = r
                return r
            r = nxt

    def unite(self, x, y) -> None:
        """Join x[i] with y[i] for all i; pairs that share a root already cost one lookup."""
        import numpy as np

        while len(x):
            rx, ry = self.roots(x), self.roots(y)
            lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
            apart = lo != hi
            if not apart.any():
                return
            x, y, lo, hi = x[apart], y[apart], lo[apart], hi[apart]
            np.minimum.at(self.up, hi, lo)  # each root hangs below the smallest root met in this pass
