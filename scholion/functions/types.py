"""Field types of layers as Spark fields with metadata; widening, inference and defaults."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
NODE_SPAN = T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())])
EXT = T.StructType([T.StructField("type", T.StringType()), T.StructField("data", T.BinaryType())])

# The wire names of the field types.
SPARK_TYPES: dict[str, T.DataType] = {
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "f64": T.DoubleType(),
    "i1": T.BooleanType(),
    "str": T.StringType(),
    "bin": T.BinaryType(),
    "span": SPAN,
    "noderef": T.IntegerType(),
    "noderef_array": T.ArrayType(T.IntegerType()),
    "nodespan": NODE_SPAN,
    "ext": EXT,
}
#: Argument that a kind needs: the text of a span, the layer of a reference, the type of an extension.
ARGUMENTS = {"span": "context", "noderef": "layer", "noderef_array": "layer", "nodespan": "layer", "ext": "type"}
DEFAULTS = {"i32": 0, "i64": 0, "f64": 0.0, "i1": False, "str": ""}
WIDENING = ("i1", "i32", "i64", "f64")


@dataclass(frozen=True)
class FieldType:
    """Type of a layer's field: a wire name, its argument and the value that ``add`` fills in."""

    kind: str
    arg: str | None = None
    default: Any = None

    def __post_init__(self) -> None:
        if self.kind not in SPARK_TYPES:
            raise ValueError(f"unknown field type {self.kind}")
        if (self.kind in ARGUMENTS) != (self.arg is not None):
            raise ValueError(f"{self.kind} {'needs' if self.kind in ARGUMENTS else 'has no'} argument")

    @property
    def spark(self) -> T.DataType:
        return SPARK_TYPES[self.kind]

    def metadata(self) -> dict[str, Any]:
        meta: dict[str, Any] = {"kind": self.kind}
        if self.arg is not None:
            meta[ARGUMENTS[self.kind]] = self.arg
        if self.default is not None:
            meta["default"] = self.default
        return meta

    def field(self, name: str) -> T.StructField:
        return T.StructField(name, self.spark, True, self.metadata())

    def column(self, value: Column, name: str) -> Column:
        """``value`` as a column of this type; a cast or expression drops metadata, so it is attached again."""
        return value.cast(self.spark).alias(name, metadata=self.metadata())

    @staticmethod
    def of(field: T.StructField) -> FieldType:
        meta = field.metadata or {}
        kind = meta.get("kind") or next((k for k, t in SPARK_TYPES.items() if t == field.dataType), None)
        if kind is None:
            raise ValueError(f"{field.name}: {field.dataType.simpleString()} is no field type")
        return FieldType(kind, meta.get(ARGUMENTS.get(kind, "")), meta.get("default"))


def with_default(kind: str, arg: str | None = None) -> FieldType:
    """The type with its usual default (0, 0.0, false or the empty string), if it has one."""
    return FieldType(kind, arg, DEFAULTS.get(kind))


def wider(a: FieldType, b: FieldType) -> FieldType | None:
    """The type that holds both, i1 < i32 < i64 < f64; None if there is none."""
    if a.kind == b.kind and a.arg == b.arg:
        return a
    if a.kind in WIDENING and b.kind in WIDENING:
        return max(a, b, key=lambda t: WIDENING.index(t.kind))
    return None


def type_of(value: Any) -> FieldType:
    """The type of a plain value: bool before int, int by range."""
    if isinstance(value, bool):
        return FieldType("i1")
    if isinstance(value, int):
        if -(2**31) <= value < 2**31:
            return FieldType("i32")
        if -(2**63) <= value < 2**63:
            return FieldType("i64")
        raise ValueError("integer beyond 64 bits")
    for kind, cls in (("f64", float), ("str", str), ("bin", bytes)):
        if isinstance(value, cls):
            return FieldType(kind)
    raise ValueError(f"no field type for {type(value).__name__}")


def coerced(value: Column, kind: str) -> Column:
    """A coercing accessor: null and text that cannot be read give the type's zero; numbers are true unless 0."""
    target = SPARK_TYPES[kind]
    if kind == "i1":
        text = F.lower(value.cast("string"))
        return F.coalesce(F.when(text.isin("true", "false"), text == "true"), text.try_cast("double") != 0, F.lit(False))
    zero = F.lit(DEFAULTS.get(kind)).cast(target)
    if kind in ("i32", "i64"):
        text = value.cast("string")
        flag = F.when(F.lower(text) == "true", 1).when(F.lower(text) == "false", 0)
        return F.coalesce(text.try_cast(target), text.try_cast("double").try_cast(target), flag.cast(target), zero)
    if kind == "f64":
        text = value.cast("string")
        return F.coalesce(text.try_cast(target), F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0), zero)
    return F.coalesce(value.cast(target), zero)
