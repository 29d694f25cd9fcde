"""Connected components of an undirected graph by stars: every node tells its neighbours the least one it knows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import broadcast_if_small, discard, stored

#: Edges that a task joins up at a time.
CHUNK = 500_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v, moved) to edges (node, least node, moved) of the components that a task's edges make, CHUNK by CHUNK;
    moved if any edge of the chunk is."""
    parent: dict[int, int] = {}
    n, moved = 0, False

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)), pa.array([moved] * len(pairs), pa.bool_())], ["u", "v", "moved"])

    for b in batches:
        for x, y in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
            low, high = sorted((root(x), root(y)))
            parent[high] = low
        moved |= any(b[2].to_pylist())
        n += b.num_rows
        if n > CHUNK:
            yield stars()
            n, moved = 0, False
    yield stars()


def _joined_up(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "moved").mapInArrow(_forest, "u long, v long, moved boolean")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable.

    In a round each node that has a smaller neighbour joins itself and all its other neighbours to the smallest one, so
    that distances about halve, and each task joins up the edges that it holds. It ends when every node has one edge, to
    its component's smallest: then no node with a smaller neighbour has another one. A node that is smaller than all its
    neighbours does nothing, so a star's centre is no hot key. Nothing is collected; each round is written to the shared
    folder. Loops and repeated edges do no harm; null ends are left out. No edges: no rows.
    """
    every = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"), F.lit(True).alias("moved")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = every.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    e = stored(_joined_up(every.where("u <> v")), "components-edges")
    while not e.where("moved").isEmpty():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that a node of many edges is split in the join, or not shuffled at all.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "components-least")
        told = both.join(broadcast_if_small(least, 16), "u")
        own = F.col("v") == F.col("m")
        rows = told.select(F.when(own, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (~own).alias("moved"))
        new = stored(_joined_up(rows), "components-edges")
        discard(e, least)
        e = new
    # A root stands for itself; a node with a loop alone is its own component.
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
    out = stored(nodes.unionByName(loops).groupBy("node").agg(F.min("component").alias("component")), "components")
    discard(e)
    return out
