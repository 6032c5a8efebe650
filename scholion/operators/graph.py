"""Graphs of references: edges, breadth-first and depth-first walks, leaves, edge indexes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.session import materialize


def edges(layer: DataFrame, *fields: str) -> DataFrame:
    """(doc_id, src, ord, pos, dst): from each node to those its reference fields name, by field, then list order."""
    if not fields:
        raise ValueError("no fields")
    parts = []
    for k, name in enumerate(fields):
        kind = (layer.schema[name].metadata or {}).get("kind")
        if kind == "noderef":
            part = layer.where(F.col(name).isNotNull()).select("doc_id", F.col("node_id").alias("src"), F.lit(k).alias("ord"), F.lit(0).alias("pos"), F.col(name).alias("dst"))
        elif kind == "noderef_array":
            part = layer.select("doc_id", F.col("node_id").alias("src"), F.lit(k).alias("ord"), F.posexplode(name).alias("pos", "dst"))
        else:
            raise ValueError(f"{name} is no reference field")
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def bfs(edge: DataFrame, start: DataFrame, is_result: Column | None = None, limit: int = 10_000) -> DataFrame:
    """(doc_id, node_id, depth) of all nodes reachable from start(doc_id, node_id), at their least depth.

    One join for each depth on the nodes found last; what was found before is left out by an anti join, so cycles end.
    Each round is written to the shared folder. ``is_result`` filters what is returned, not the walk.
    """
    step = edge.select("doc_id", F.col("src").alias("node_id"), "dst").distinct()
    found = frontier = materialize(start.select("doc_id", "node_id").distinct().withColumn("depth", F.lit(0)), "bfs")
    for depth in range(1, limit):
        new = frontier.join(step, ["doc_id", "node_id"]).select("doc_id", F.col("dst").alias("node_id")).distinct()
        new = new.join(found, ["doc_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialize(new, "bfs")
        if not frontier.limit(1).count():
            break
        found = found.unionByName(frontier)
    else:
        raise RuntimeError(f"nodes lie at a depth of {limit - 1} or more; raise the limit")
    return found if is_result is None else found.where(is_result)


def _walk(children: dict[int, list[int]], start: list[int]) -> tuple[list[int], list[int]]:
    """Pre-order of a depth-first walk, and the nodes that had no unvisited child when visited."""
    order, leaves, seen = [], [], set()
    stack = start[::-1]
    while stack:
        node = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        order.append(node)
        new = [c for c in children.get(node, ()) if c not in seen]
        if not new:
            leaves.append(node)
        stack.extend(new[::-1])
    return order, leaves


def dfs(edge: DataFrame, start: DataFrame, is_result: Column | None = None) -> DataFrame:
    """(doc_id, node_id, place, leaf): pre-order of a depth-first walk of each document's graph, children in order.

    leaf: no child was unvisited at the visit. The order of a walk over a general graph is sequential, so each document
    is walked by itself in Python; memory is one document's edges. ``is_result`` filters what is returned, not the walk.
    """
    kind = edge.schema["doc_id"].dataType.simpleString()
    rows = edge.select("doc_id", "src", "ord", "pos", "dst").unionByName(start.select("doc_id", F.lit(None).cast("int").alias("src"), F.lit(-1).alias("ord"), F.col("node_id").cast("int").alias("pos"), F.col("node_id").alias("dst")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "pos"], kind="stable")
        children: dict[int, list[int]] = {}
        inner = pdf[pdf["ord"] >= 0]
        for src, dst in zip(inner["src"], inner["dst"], strict=True):
            children.setdefault(int(src), []).append(int(dst))
        order, leaves = _walk(children, [int(x) for x in pdf.loc[pdf["ord"] < 0, "dst"]])
        last = set(leaves)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "node_id": order, "place": range(len(order)), "leaf": [n in last for n in order]})

    out = rows.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, node_id int, place int, leaf boolean")
    return out if is_result is None else out.where(is_result)


def forest_paths(spark, tree: str, roots: str, depth: int = 90) -> DataFrame:
    """Pre-order of a forest in SQL: views tree(src, dst, pos) and roots(node_id); (node_id, depth, path).

    Ordering by path, an array of child positions, is the pre-order. For forests of up to ``depth`` levels; a deeper one is an error.
    """
    return spark.sql(f"""
        WITH RECURSIVE walk(node_id, depth, path) AS (
            SELECT node_id, 0, array(node_id) FROM {roots}
            UNION ALL
            SELECT t.dst, w.depth + 1, concat(w.path, array(t.pos)) FROM walk w JOIN {tree} t ON t.src = w.node_id WHERE w.depth <= {depth}
        ) SELECT * FROM walk WHERE assert_true(depth <= {depth}, 'the forest has more than {depth} levels') IS NULL""")


def tree_leaves(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of a forest without children."""
    return nodes.join(edge.select("doc_id", F.col("src").alias("node_id")), ["doc_id", "node_id"], "left_anti")


def edge_index(edge: DataFrame, side: str = "in") -> DataFrame:
    """(doc_id, node_id, others): sources of the edges into each node, or targets of those out of it, sorted."""
    key, other = ("dst", "src") if side == "in" else ("src", "dst")
    return edge.groupBy("doc_id", F.col(key).alias("node_id")).agg(F.sort_array(F.collect_list(other)).alias("others"))
