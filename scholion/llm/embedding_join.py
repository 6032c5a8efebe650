"""Exact metric range join over embeddings: pivot cells, triangle-inequality replication, independent cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType

from scholion.llm.components import connected_components
from scholion.llm.workers import lean
from scholion.session import hinted, materialize

#: Vectors a cell should hold; a label with fewer is one cell.
CELL = 2_000
#: Most pivots over all labels, and most bytes of them, so that they can be broadcast.
PIVOTS = 4_096
PIVOT_BYTES = 16 << 20
#: Vectors of one side that a task compares at once; larger cells are cut into block pairs.
BLOCK = 8_192


@dataclass
class VectorLinks:
    """``classes(node, label, embedding, copies)``; ``degrees(node, n)`` linked vectors, the node's own copies
    included; ``edges(src, dst)`` a spanning set of the links; ``members(vec_id, node)``, node null where nothing can link."""

    members: DataFrame
    degrees: DataFrame
    edges: DataFrame


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots of each (label, dimension) with more than a cell of vectors: those with the smallest hashes.

    A cell holds ``CELL`` vectors, or more, so that all labels together have no more than about ``PIVOTS`` pivots.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total, dim = classes.agg(F.count("*"), F.max("dim")).first()
    cell = max(CELL, total // max(64, min(PIVOTS, PIVOT_BYTES // (8 * (dim or 1)))) + 1)
    large = sizes.where(F.col("n") > cell).withColumn("k", F.ceil(F.col("n") / cell))
    rank = F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1 << 30))
    some = classes.join(hinted(large), ["label", "dim"]).where(rank < (F.lit(float(1 << 30)) * (F.col("k") + 3 * F.sqrt("k") + 3) / F.col("n")))
    found: dict[tuple, list] = {}
    # fewer than total / cell labels are large, and each gives a few vectors more than its k
    for batch in some.select("label", "dim", "k", "embedding", rank.alias("rank")).orderBy("rank").toArrow().to_batches():
        for i, (label, dim, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            kept = found.setdefault((label, dim), [])
            if len(kept) < k:
                kept.append(np.array(batch.column(3)[i].values))
    return {k: _unit(v) for k, v in found.items()}


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))


def _placed(classes: DataFrame, pivots: dict[tuple, np.ndarray], radius: float, reach: dict | None) -> DataFrame:
    """Without reach: (label, dim, cell, r), the radius of each home cell of the labels with pivots. With it: a row per
    vector and cell that must see it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for (label, dim), g in pdf.groupby(["label", "dim"], sort=False):
                p = pivots.get((label, dim))
                if p is None and reach is None:
                    continue
                if p is None:
                    cell, home, at = np.zeros(len(g), np.int64), np.ones(len(g), bool), np.arange(len(g))
                    near = np.zeros(len(g))
                else:
                    d = _distances(_unit(g["embedding"].tolist()), p)
                    own = d.argmin(axis=1)
                    near = d[np.arange(len(g)), own]
                    if reach is None:
                        cell, home, at = own, np.ones(len(g), bool), np.arange(len(g))
                    else:
                        r = np.array([reach.get((label, dim, j), -1.0) for j in range(len(p))])
                        # a neighbour x of y, at home in cell j: d(y, p_j) <= d(x, p_j) + radius <= d(y, p_own) + 2 radius
                        sees = (d <= near[:, None] + 2 * radius + 1e-6) & (d <= r[None, :] + radius + 1e-6) & (r[None, :] >= 0)
                        # x lies on p_j's side of the plane half-way between the two pivots, so y is no further than radius beyond it
                        sees &= d * d - (near * near)[:, None] <= 2 * radius * _distances(p[own], p) + 1e-6
                        sees[np.arange(len(g)), own] = True
                        at, cell = np.nonzero(sees)
                        home = cell == own[at]
                if reach is None:
                    out = pd.DataFrame({"cell": cell, "r": near}).groupby("cell", as_index=False).max()
                    yield pa.RecordBatch.from_pandas(out.assign(label=label, dim=dim)[["label", "dim", "cell", "r"]].astype({"cell": "int64", "dim": "int32"}), schema=small, preserve_index=False)
                else:
                    out = g.iloc[at].assign(cell=cell, home=home)
                    yield pa.RecordBatch.from_pandas(out[["label", "dim", "cell", "home", "node", "copies", "embedding"]], schema=full, preserve_index=False)

    small = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int64()), ("r", pa.float64())])
    kind = classes.schema["embedding"].dataType.elementType
    number = pa.float32() if isinstance(kind, FloatType) else pa.float64()
    full = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_()), ("node", pa.int64()), ("copies", pa.int64()), ("embedding", pa.list_(number))])
    source = classes.select("label", "dim", "node", "copies", "embedding")
    ddl = "label string, dim int, cell long, " + ("r double" if reach is None else f"home boolean, node long, copies long, embedding array<{kind.simpleString()}>")
    return source.mapInArrow(lean(run), ddl)


def _label(vectors: DataFrame, label_col: str) -> Column:
    """The label as text, equal where labels of its type are equal."""
    label, kind = F.col(label_col), vectors.schema[label_col].dataType
    if isinstance(kind, (FloatType, DoubleType)):
        label = label + F.lit(0.0)  # makes -0.0 and 0.0 the same
    return label.cast("string") if not isinstance(kind, BinaryType) else F.hex(label)


def _block_links(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links from the home vectors of one block to the vectors of another: degrees, and a forest of the links."""
        left, right = pdf[pdf.left], pdf[pdf.right]
        if left.empty or right.empty:
            return pd.DataFrame({"src": [], "dst": [], "n": []}).astype("int64")
        order = np.argsort(right["node"].to_numpy(), kind="stable")
        right = right.iloc[order]
        a, b = _unit(left["embedding"].tolist()), _unit(right["embedding"].tolist())
        ids, others, weight = left["node"].to_numpy(), right["node"].to_numpy(), right["copies"].to_numpy()
        degree = np.zeros(len(ids), np.int64)
        # components of this block's links: labels fall to the smallest node until nothing changes
        low_b, hits = others.copy(), []
        for at in range(0, len(ids), 512):
            hit = a[at : at + 512] @ b.T >= threshold
            degree[at : at + 512] = hit @ weight
            hits.append(np.packbits(hit, axis=1))
        low_a = ids.copy()
        while True:
            before = low_a.copy(), low_b.copy()
            for k, packed in enumerate(hits):
                hit = np.unpackbits(packed, axis=1, count=len(others)).astype(bool)
                rows = slice(512 * k, 512 * k + len(hit))
                best = np.where(hit, low_b[None, :], np.iinfo(np.int64).max).min(axis=1)
                low_a[rows] = np.minimum(low_a[rows], best)
                best = np.where(hit, low_a[rows][:, None], np.iinfo(np.int64).max).min(axis=0)
                low_b = np.minimum(low_b, best)
            if (before[0] == low_a).all() and (before[1] == low_b).all():
                break
        out = pd.DataFrame({"src": ids, "dst": low_a, "n": degree})
        linked = low_b != others
        return pd.concat([out, pd.DataFrame({"src": others[linked], "dst": low_b[linked], "n": 0})], ignore_index=True).astype("int64")

    return run


def vector_links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> VectorLinks:
    """All pairs of vectors with equal labels and a cosine of at least ``threshold``, as degrees and spanning links; exact.

    Equal vectors of a label form one class first. A label with many classes gets pivots; a vector is at home in the
    cell of its nearest pivot, and is copied to each other cell that may hold a neighbour: by the triangle inequality
    those with d(v, p) <= d(v, home pivot) + 2 r and d(v, p) <= the cell's radius + r, r the Euclidean distance that
    belongs to the threshold, and no further than r beyond the plane half-way between the two pivots. Then each cell finds all neighbours of its home vectors by itself. A cell of any size is
    cut into pairs of blocks, each a task of its own, so a hot label costs more tasks, not a larger one.

    Links with nothing: vectors that are null, empty, zero or hold null or non-finite components, null labels.
    Vectors of different dimensions never link. Labels may have any type. Repeated rows count as so many vectors; extra columns are ignored.
    """
    # single precision is kept as such until a task takes the vectors as doubles, which loses nothing
    number = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col(id_col).alias("vec_id"), _label(vectors, label_col).alias("label"), F.col(vector_col).cast(f"array<{number}>").alias("embedding"))
    # x + 0.0 makes -0.0 and 0.0 the same; non-finite components differ from themselves minus themselves
    good = F.expr("label is not null and size(embedding) > 0 and forall(embedding, x -> coalesce(x - x = 0.0, false)) and exists(embedding, x -> x <> 0.0)")
    v = v.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), F.expr(f"transform(embedding, x -> x + cast(0 as {number}))")))
    grouped = v.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    node = F.xxhash64("label", "embedding")
    classes = materialize(grouped.select("label", "embedding", "copies", node.alias("node"), F.size("embedding").alias("dim")), "vectors")
    members = v.select("vec_id", F.when(F.col("embedding").isNotNull(), node).alias("node"))

    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    pivots = _pivots(classes)
    near = {}
    if pivots:
        for r in _placed(classes, pivots, radius, None).groupBy("label", "dim", "cell").agg(F.max("r").alias("r")).collect():
            near[r.label, r.dim, r.cell] = r.r
    # placed twice, for the sizes of the cells and for their vectors, rather than stored
    placed = _placed(classes, pivots, radius, near)
    blocks = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(hinted(materialize(blocks, "blocks")), ["label", "dim", "cell"]).withColumn("block", F.pmod(F.hash(F.lit(3), "node"), "blocks"))
    # a vector is on the right in its block's column and, if at home, on the left in its block's row; where they cross it is sent once
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda i, j, left, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"), right.alias("right"))
    block = F.col("block")
    column = F.transform(each, lambda k: place(k, block, F.col("home") & (k == block), F.lit(True)))
    row = F.filter(F.transform(each, lambda k: place(block, k, F.lit(True), F.lit(False))), lambda x: F.col("home") & (x["j"] != block))
    sent = placed.select("label", "dim", "cell", "node", "copies", "embedding", F.explode(F.concat(column, row)).alias("p"))
    sent = sent.select("label", "dim", "cell", "p.i", "p.j", "p.left", "p.right", "node", "copies", "embedding")
    found = sent.groupBy("label", "dim", "cell", "i", "j").applyInPandas(_block_links(threshold), "src long, dst long, n long")
    found = materialize(found, "links")
    degrees = found.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n"))
    return VectorLinks(members, degrees, found.where("src <> dst").select("src", "dst").distinct())


def vector_components(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", **columns: str) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept). Options: those of ``vector_links``.

    component_id is the smallest vec_id reachable by links; a vector that links with nothing has its own.
    """
    found = vector_links(vectors, threshold, id_col, **columns)
    low = found.members.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("low"))
    own = low.join(connected_components(found.edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = own.join(own.groupBy("component").agg(F.min("low").alias("component_id")), "component").join(found.degrees, "node").select("node", "component_id", "n")
    out = found.members.join(hinted(materialize(named, "named")), "node", "left")
    out = out.select("vec_id", F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
