"""Connected components of an edge table by randomised contraction.

Each round orders the nodes anew (by their numbers under a changing mask). Every
task first replaces the edges that it holds, up to HELD at a time, by stars: each
node's edge leads to the first node that can be reached by those edges. Then all
nodes point at the first one among themselves and their neighbours, the ends of
every edge are replaced by what they point at, and loops and repeats are dropped.
A fair share of the nodes goes in every round, whatever the graph's shape, so the
rounds are at most about as many as the logarithm of its size; what the tasks find
by themselves makes them one or two where Spark deals the edges to few tasks. Few
rounds also keep the driver's memory low, which grows with the jobs that it plans.
No table of nodes, edges or labels is ever collected; the driver sees whether
edges are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Edges that a task looks at together; bounds its memory.
HELD = 1 << 20


def _mask(n: int) -> int:
    return int.from_bytes(hashlib.sha256(b"round %d" % n).digest()[:8], "big", signed=True)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect: from each node to the smallest one that can be reached."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (further := root[root])).any():
            root = further
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    leaves = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaves], nodes[root[leaves]]


def contracted(edges: DataFrame, mask: int, held: int = HELD) -> DataFrame:
    """edges (a long, b long, neither null) -> edges that connect the same nodes, stars in every so many held of a task; nodes are ordered under mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def stars() -> pa.RecordBatch:
            a, b = _stars(*(np.concatenate(x) ^ mask for x in zip(*parts)))
            return pa.RecordBatch.from_arrays([pa.array(a ^ mask), pa.array(b ^ mask)], names=["a", "b"])

        for batch in batches:
            for k in range(0, batch.num_rows, held):
                parts.append([c.to_numpy(zero_copy_only=False) for c in batch.slice(k, held).columns])
                n += len(parts[-1][0])
                if n >= held:
                    yield stars()
                    parts, n = [], 0
        if n:
            yield stars()

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """edges (a long, b long) -> (node long, root long) for each node that has an edge to another.

    root is the smallest node that can be reached, itself included. Edges with a
    null end, loops and repeated edges are allowed and change nothing; an empty
    table gives an empty result.
    """
    live = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    rounds: list[DataFrame] = []
    while True:
        mask = _mask(len(rounds))
        stars = checkpointed(contracted(live, mask, held))
        if stars.isEmpty():
            break
        mask = F.lit(mask)
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # partial aggregation keeps one row for each node and task, so hubs stay cheap
        first = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        to = checkpointed(first.select(F.col("a").alias("node"), F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")))
        rounds.append(to)
        left = to.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = stars.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        live = moved.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    found = rounds.pop().select("node", F.col("to").alias("root"))
    while rounds:
        later = found.select(F.col("node").alias("to"), F.col("root").alias("last"))
        found = checkpointed(rounds.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("root")))
    least = checkpointed(found.groupBy("root").agg(F.min("node").alias("least")))
    return found.join(least, "root").select("node", F.col("least").alias("root"))
