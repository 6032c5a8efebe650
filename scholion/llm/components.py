"""Connected components over an edge table, with no state on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.session import discard, materialize

#: Most edges (16 bytes each) that one task joins by itself; more go through distributed rounds.
TASK_EDGES = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (src, dst) become (node, component): roots are hooked to the smallest neighbouring root, then paths halved."""
    parts = [np.stack([batch.column(k).to_numpy() for k in (0, 1)]) for batch in batches if len(batch)]
    if not parts:
        return
    node, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    for lo in range(0, len(node), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + (1 << 17)]), pa.array(node[root[lo : lo + (1 << 17)]])], ["node", "component"])


def connected_components(edges: DataFrame, rounds: int = 60, task_edges: int | None = None) -> DataFrame:
    """Components of the undirected graph ``edges(src long, dst long)`` as ``(node, component)``.

    ``component`` is the smallest node of the component; only nodes that occur in ``edges`` are returned. Large-star
    and small-star rounds alternate until no edge changes: each round points every node at the smallest neighbour it
    knows. A node's minimum is one partial aggregate; it comes back to the edges by an equi join whose skewed partitions
    AQE splits. Each round's edges are written to the shared folder; only a count and a checksum reach the driver. Null
    nodes and self-loops are ignored. Up to ``task_edges`` (``TASK_EDGES``) edges are joined in one task instead, without
    rounds; give edges that are cheap to read.
    """
    proper = edges.where("src is not null and dst is not null and src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    if proper.count() <= (TASK_EDGES if task_edges is None else task_edges):
        return materialize(proper.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = materialize(proper.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges")
    was = state(now)
    for _ in range(rounds):
        if not was[0]:
            break
        for large in (True, False):
            # large star: each node hands its smallest neighbour to its larger ones; small star: to its smaller ones
            both = now.union(now.select("b", "a")) if large else now
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
            joined = both.join(low, "a")
            if large:
                new = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            else:
                new = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", "low"))
            old, now = now, materialize(new.where("a <> b").distinct(), "edges")
            discard(old)
        if (new_state := state(now)) == was:
            break
        was = new_state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
