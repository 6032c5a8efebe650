"""Validation of layers: queries that return violating rows (doc_id, layer, node_id, field, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.types import FieldType
from scholion.operators.layers import renumber

COLUMNS = ["doc_id", "layer", "node_id", "field", "rule"]


def _rows(df: DataFrame, layer: str, field: str, rule: str) -> DataFrame:
    return df.select("doc_id", F.lit(layer).alias("layer"), "node_id", F.lit(field).alias("field"), F.lit(rule).alias("rule"))


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else _rows(like.limit(0), "", "", "")


def undeclared_fields(layer: DataFrame, declared: list[str]) -> list[str]:
    """Fields of the table that its schema does not declare."""
    return sorted(set(layer.columns) - {"doc_id", "node_id"} - set(declared))


def missing_targets(layers: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(layer, field, target) of reference fields whose layer does not exist."""
    out = []
    for name, layer in layers.items():
        for f in layer.schema.fields:
            target = (f.metadata or {}).get("layer")
            if target is not None and target not in layers:
                out.append((name, f.name, target))
    return out


def value_violations(name: str, layer: DataFrame) -> DataFrame:
    """Values that their field's type does not allow: node spans whose left is after their right, reversed or negative spans."""
    checks: list[tuple[str, str, Column]] = []
    for f in layer.schema.fields:
        kind = (f.metadata or {}).get("kind")
        c = F.col(f.name)
        if kind == "nodespan":
            checks.append((f.name, "nodespan_order", c["left"] > c["right"]))
        if kind == "span":
            checks.append((f.name, "span_order", (c["start"] > c["stop"]) | (c["start"] < 0)))
    found = F.filter(F.array(*(F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(rule).alias("rule"))) for f, rule, bad in checks)), lambda x: x.isNotNull()) if checks else None
    if found is None:
        return _union([], layer)
    rows = layer.select("doc_id", F.lit(name).alias("layer"), "node_id", F.explode(found).alias("v"))
    return rows.select("doc_id", "layer", "node_id", "v.field", "v.rule")


def cast_violations(name: str, layer: DataFrame, field: str, dtype: FieldType) -> DataFrame:
    """Raw values (strings, as read from outside) that are present but not of the type."""
    return _rows(layer.where(F.col(field).isNotNull() & F.col(field).try_cast(dtype.spark).isNull()), name, field, f"not_{dtype.kind}")


def text_violations(name: str, layer: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans over texts that their document lacks, or beyond the text's end."""
    parts = []
    for f in layer.schema.fields:
        meta = f.metadata or {}
        if meta.get("kind") != "span":
            continue
        own = texts.where(F.col("context") == meta["context"]).select("doc_id", F.char_length("text").alias("size_"))
        joined = layer.where(F.col(f.name).isNotNull()).join(own, "doc_id", "left")
        parts.append(_rows(joined.where("size_ is null"), name, f.name, "text_missing"))
        parts.append(_rows(joined.where(F.col(f.name)["stop"] > F.col("size_")), name, f.name, "beyond_text"))
    return _union(parts, layer)


def dangling_references(name: str, layer: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Nodes whose references point at no node of the target layer."""
    parts = []
    for f in layer.schema.fields:
        meta = f.metadata or {}
        kind, c = meta.get("kind"), F.col(f.name)
        if kind == "noderef":
            ref = layer.select("doc_id", "node_id", c.alias("ref_"))
        elif kind == "noderef_array":
            ref = layer.select("doc_id", "node_id", F.explode(c).alias("ref_"))
        elif kind == "nodespan":
            ref = layer.select("doc_id", "node_id", F.explode(F.array(c["left"], c["right"])).alias("ref_"))
        else:
            continue
        ref = ref.where("ref_ is not null")
        target = layers.get(meta["layer"])
        if target is not None:
            ref = ref.join(target.select("doc_id", F.col("node_id").alias("ref_")), ["doc_id", "ref_"], "left_anti")
        parts.append(_rows(ref, name, f.name, "dangling").distinct())
    return _union(parts, layer)


def violations(layers: dict[str, DataFrame], texts: DataFrame) -> DataFrame:
    """All violations of all layers."""
    parts = []
    for name, layer in layers.items():
        parts += [value_violations(name, layer), text_violations(name, layer, texts), dangling_references(name, layer, layers)]
    return reduce(DataFrame.unionByName, parts)


def compiled(layers: dict[str, DataFrame], texts: DataFrame, extra_fields_ok: bool = False, declared: dict[str, list[str]] | None = None, check: bool = True) -> dict[str, DataFrame]:
    """Layers with compact ids, ready to encode. The schema is checked at once, the values by one query if ``check``."""
    if missing := missing_targets(layers):
        raise ValueError(f"missing layers: {missing}")
    for name, fields in (declared or {}).items():
        if not extra_fields_ok and (extra := undeclared_fields(layers[name], fields)):
            raise ValueError(f"{name}: undeclared fields {extra}")
    if check and (bad := violations(layers, texts).limit(5).collect()):
        raise ValueError(f"invalid values, such as {[r.asDict() for r in bad]}")
    for name in list(layers):
        layers = renumber(layers, name)
    return layers
