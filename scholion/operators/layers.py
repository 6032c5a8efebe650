"""Reading and editing layers: tables of (doc_id, node_id, fields), node_id being the order. All return new tables."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from scholion.functions.spans import covered_text
from scholion.functions.types import ARGUMENTS, FieldType, wider

def by_node() -> WindowSpec:
    """The nodes of each document in order."""
    return Window.partitionBy("doc_id").orderBy("node_id")


def project(layer: DataFrame, *fields: str) -> DataFrame:
    """Fields of all nodes; a missing value is null."""
    return layer.select("doc_id", "node_id", *fields)


def field_or(field: str, default: Any) -> Column:
    return F.coalesce(F.col(field), F.lit(default))


def node_at(layer: DataFrame, index: int) -> DataFrame:
    return layer.where(F.col("node_id") == index)


def node_slice(layer: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Nodes [start:stop] of each document by the rules of slices; gaps are skipped, negative bounds count from its end."""
    size = F.lit(None)
    if (start or 0) < 0 or (stop or 0) < 0:
        size = F.max(F.col("node_id") + 1).over(Window.partitionBy("doc_id"))
    bound = lambda k: F.lit(k) if k >= 0 else size + k
    out = layer.withColumn("from_", bound(start or 0)).withColumn("to_", bound(stop) if stop is not None else F.lit(2**31 - 1))
    return out.where("node_id >= from_ and node_id < to_").drop("from_", "to_")


def take(layer: DataFrame, places: list[int]) -> DataFrame:
    """The nodes at the given places of each document, with ``position``; order and repeats are kept."""
    wanted = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(k).alias("position")) for k, p in enumerate(places)))
    hits = F.filter(wanted, lambda w: w["place"] == F.col("node_id"))
    rows = layer.where(F.col("node_id").isin(places)).withColumn("hit_", F.explode(hits))
    return rows.withColumn("position", F.col("hit_.position")).drop("hit_")


def first_last(layer: DataFrame, field: str) -> DataFrame:
    """(doc_id, first, last): the field at the first and the last node; documents without nodes are absent."""
    return layer.groupBy("doc_id").agg(F.min_by(field, "node_id").alias("first"), F.max_by(field, "node_id").alias("last"))


def node_count(docs: DataFrame, layer: DataFrame) -> DataFrame:
    """(doc_id, n) for every document, 0 included."""
    counts = layer.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


def head_and_tail(layer: DataFrame, rows: int = 100) -> DataFrame:
    """At most ``rows`` nodes of each document for display: the first and the last half."""
    back = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("node_id")))
    ranked = layer.withColumn("front_", F.row_number().over(by_node())).withColumn("back_", back)
    return ranked.where((F.col("front_") <= rows - rows // 2) | (F.col("back_") <= rows // 2)).drop("front_", "back_")


def fill_defaults(layer: DataFrame, values: dict[str, Any]) -> DataFrame:
    return layer.select(*(F.coalesce(F.col(c), F.lit(values[c])).alias(c, metadata=layer.schema[c].metadata) if c in values else F.col(c) for c in layer.columns))


def declared_defaults(layer: DataFrame) -> dict[str, Any]:
    return {f.name: f.metadata["default"] for f in layer.schema if "default" in (f.metadata or {})}


def add_nodes(layer: DataFrame, new: DataFrame, default_fill: bool = True, order: str | None = None) -> DataFrame:
    """Append nodes ``new(doc_id, fields)``; they get the ids after their document's last one, in the order of ``order``.

    ``default_fill`` puts the declared defaults where a field is missing. Without ``order`` it is that of all the new
    fields, so that reruns agree: rows that tie are equal.
    """
    for name in set(new.columns) - set(layer.columns) - {order}:
        raise ValueError(f"{name} is not declared")
    last = layer.groupBy("doc_id").agg((F.max("node_id") + 1).alias("next_"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*([order] if order else map(F.to_json, [F.struct(*sorted(new.columns))])))) - 1
    rows = new.withColumn("place_", place).join(last, "doc_id", "left")
    rows = rows.withColumn("node_id", (F.coalesce("next_", F.lit(0)) + F.col("place_")).cast("int"))
    rows = rows.drop("place_", "next_", *([order] if order and order not in layer.columns else []))
    for f in layer.schema:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows = rows.select(*layer.columns)
    return layer.unionByName(fill_defaults(rows, declared_defaults(layer)) if default_fill else rows)


def remove_nodes(layer: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the nodes (doc_id, node_id) in ``gone``; ids keep their gaps."""
    return layer.join(gone.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def retain_nodes(layer: DataFrame, kept: DataFrame) -> DataFrame:
    """Only the nodes in ``kept``, repeats tolerated; ids keep their gaps until ``compact``."""
    return layer.join(kept.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")


def renumbering(layer: DataFrame, *keys: Column | str) -> DataFrame:
    """(doc_id, old, new): new ids 0, 1, ... in order of the keys, ties by id."""
    order = Window.partitionBy("doc_id").orderBy(*keys, "node_id")
    return layer.select("doc_id", F.col("node_id").alias("old"), (F.row_number().over(order) - 1).cast("int").alias("new"))


def remap_references(layer: DataFrame, target: str, ids: DataFrame) -> DataFrame:
    """Rewrite all fields that refer to the layer ``target`` by ids(doc_id, old, new).

    A reference to a node that is gone becomes null, and leaves a list. A node span shrinks to what is left of it.
    """
    for f in layer.schema.fields:
        meta = f.metadata or {}
        kind = meta.get("kind")
        if kind not in ("noderef", "noderef_array", "nodespan") or meta.get("layer") != target:
            continue
        others = [c for c in layer.columns if c != f.name]
        if kind == "noderef":
            joined = layer.join(ids.withColumnRenamed("old", f.name), ["doc_id", f.name], "left")
            layer = joined.select(*(F.col("new").alias(f.name, metadata=meta) if c == f.name else F.col(c) for c in layer.columns))
            continue
        if kind == "noderef_array":
            exploded = layer.select("doc_id", "node_id", F.posexplode(f.name).alias("at_", "old"))
            lists = exploded.join(ids, ["doc_id", "old"]).groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("at_", "new"))).alias("l_"))
            new = F.when(F.col(f.name).isNotNull(), F.coalesce(F.transform("l_", lambda x: x["new"]), F.array().cast("array<int>")))
        else:
            inside = layer.select("doc_id", "node_id", F.explode(F.sequence(f"{f.name}.left", f"{f.name}.right")).alias("old"))
            lists = inside.join(ids, ["doc_id", "old"]).groupBy("doc_id", "node_id").agg(F.struct(F.min("new").alias("left"), F.max("new").alias("right")).alias("l_"))
            new = F.col("l_")
        joined = layer.join(lists, ["doc_id", "node_id"], "left")
        layer = joined.select(*(new.alias(f.name, metadata=meta) if c == f.name else F.col(c) for c in [*others, f.name])).select(*layer.columns)
    return layer


def renumber(layers: dict[str, DataFrame], name: str, *keys: Column | str) -> dict[str, DataFrame]:
    """Sort the nodes of a layer by the keys (none: compact it) and rewrite all references to them."""
    ids = renumbering(layers[name], *keys)
    order = Window.partitionBy("doc_id").orderBy(*keys, "node_id")
    own = layers[name].withColumn("node_id", (F.row_number().over(order) - 1).cast("int"))
    return {k: remap_references(own if k == name else v, name, ids) for k, v in layers.items()}


def add_field(layer: DataFrame, name: str, dtype: FieldType, init: bool = False) -> DataFrame:
    """Declare a field; with ``init`` existing nodes get its default, else they lack it."""
    if name in layer.columns:
        raise ValueError(f"{name} exists")
    value = F.lit(dtype.default) if init and dtype.default is not None else F.lit(None)
    return layer.withColumn(name, value.cast(dtype.spark)).withMetadata(name, dtype.metadata())


def remove_field(layer: DataFrame, name: str) -> DataFrame:
    return layer.drop(name)


def clear(layer: DataFrame) -> DataFrame:
    return layer.limit(0)


def referring_fields(layers: dict[str, DataFrame], argument: str, name: str) -> list[tuple[str, str]]:
    """(layer, field) of all fields that refer to a layer (argument ``layer``) or a text (argument ``context``)."""
    return [(k, f.name) for k, v in layers.items() for f in v.schema.fields if (f.metadata or {}).get(argument) == name and ARGUMENTS.get((f.metadata or {}).get("kind", "")) == argument]


def remove_layer(layers: dict[str, DataFrame], name: str, cascade: bool = False) -> dict[str, DataFrame]:
    """Without the layer; fields of others that refer to it go with ``cascade`` and are an error without."""
    rest = {k: v for k, v in layers.items() if k != name}
    return _drop_fields(rest, referring_fields(rest, "layer", name), name, cascade)


def remove_text(layers: dict[str, DataFrame], texts: DataFrame, name: str, cascade: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Without the text; span fields over it go with ``cascade`` and are an error without."""
    return _drop_fields(layers, referring_fields(layers, "context", name), name, cascade), texts.where(F.col("context") != name)


def _drop_fields(layers: dict[str, DataFrame], fields: list[tuple[str, str]], name: str, cascade: bool) -> dict[str, DataFrame]:
    if fields and not cascade:
        raise ValueError(f"{name} is referred to by {', '.join(f'{a}.{b}' for a, b in fields)}")
    return {k: v.drop(*(f for a, f in fields if a == k)) for k, v in layers.items()}


def add_text(texts: DataFrame, new: DataFrame) -> DataFrame:
    """Add texts (doc_id, context, text); a context that a document has already is kept, the new text is left out.

    Of several new texts of one context the least is added.
    """
    first = F.row_number().over(Window.partitionBy("doc_id", "context").orderBy("text"))
    fresh = new.join(texts.select("doc_id", "context"), ["doc_id", "context"], "left_anti").select(*texts.columns, first.alias("first_")).where("first_ = 1")
    return texts.unionByName(fresh.select(*texts.columns))


def add_layer(layers: dict[str, DataFrame], name: str, layer: DataFrame, replace: bool = False) -> dict[str, DataFrame]:
    """With one more layer; a layer of that name is an error unless it is to be replaced."""
    if name in layers and not replace:
        raise ValueError(f"layer {name} exists")
    return layers | {name: layer}


def contains(layer: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(doc_id, node_id) with ``present``: whether the layer has the node."""
    own = layer.select("doc_id", "node_id").distinct().withColumn("present", F.lit(True))
    return nodes.join(own, ["doc_id", "node_id"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def export(layer: DataFrame, texts: DataFrame | None = None, fields: tuple[str, ...] = (), ref: bool = False) -> DataFrame:
    """The layer as a flat table to hand on: the fields (all, unless named) by document and node.

    With ``texts(doc_id, context, text)`` spans become the text they cover; a span without its text becomes null.
    ``ref`` adds the node's id as ``__ref``.
    """
    out, names = layer, fields or tuple(c for c in layer.columns if c not in ("doc_id", "node_id"))
    for name in names if texts is not None else ():
        meta = layer.schema[name].metadata or {}
        if meta.get("kind") == "span":
            own = texts.where(F.col("context") == meta["context"]).select("doc_id", F.col("text").alias("body_"))
            out = out.join(own, "doc_id", "left").withColumn(name, covered_text(F.col("body_"), F.col(name))).drop("body_")
    return out.select("doc_id", *([F.col("node_id").alias("__ref")] if ref else []), *names)


def to_pandas(layer: DataFrame, texts: DataFrame | None = None, fields: tuple[str, ...] = (), ref: bool = False) -> pd.DataFrame:
    """``export``, collected in order of documents and nodes. For layers that fit the driver's memory."""
    rows = export(layer, texts, fields, True).toPandas().sort_values(["doc_id", "__ref"], ignore_index=True)
    return rows if ref else rows.drop(columns="__ref")


def merge_layers(*layers: DataFrame) -> DataFrame:
    """A list of nodes of several layers: all fields, numbers widened (i1 < i32 < i64 < f64); null where a node has none."""
    types: dict[str, FieldType] = {}
    for layer in layers:
        for f in layer.schema.fields:
            if f.name in ("doc_id", "node_id"):
                continue
            own = FieldType.of(f)
            if f.name in types:
                both = wider(types[f.name], own)
                if both is None:
                    raise ValueError(f"{f.name}: {types[f.name].kind} and {own.kind} have no common type")
                own = both
            types[f.name] = own
    out = None
    for layer in layers:
        rows = layer.select("doc_id", "node_id", *((F.col(n).cast(t.spark) if n in layer.columns else F.lit(None).cast(t.spark)).alias(n, metadata=t.metadata()) for n, t in types.items()))
        out = rows if out is None else out.unionByName(rows)
    return out


def schema_rows(layers: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(layer, field, type, argument) of all fields, sorted."""
    rows = []
    for name, layer in layers.items():
        for f in layer.schema.fields:
            if f.name not in ("doc_id", "node_id"):
                t = FieldType.of(f)
                rows.append((name, f.name, t.kind, t.arg or ""))
    return sorted(rows)
