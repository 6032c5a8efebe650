"""Field predicates with two-valued logic: each is true or false for every row, so that ``~`` negates it.

Missing fields are null. Equality takes null as a value; an order or span predicate on null is false.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(field: Column | str) -> Column:
    return F.col(field) if isinstance(field, str) else field


def certain(condition: Column) -> Column:
    """The condition with null taken as false."""
    return F.coalesce(condition, F.lit(False))


def eq(field: Column | str, value: Any) -> Column:
    return _column(field).eqNullSafe(value)


def ne(field: Column | str, value: Any) -> Column:
    return ~eq(field, value)


def lt(field: Column | str, value: Any) -> Column:
    return certain(_column(field) < value)


def le(field: Column | str, value: Any) -> Column:
    return certain(_column(field) <= value)


def gt(field: Column | str, value: Any) -> Column:
    return certain(_column(field) > value)


def ge(field: Column | str, value: Any) -> Column:
    return certain(_column(field) >= value)


def is_any(field: Column | str, *items: Any) -> Column:
    """Membership; None among the items matches missing fields."""
    known = [x for x in items if x is not None]
    found = certain(_column(field).isin(known)) if known else F.lit(False)
    return found | _column(field).isNull() if len(known) < len(items) else found


def is_none(field: Column | str) -> Column:
    return _column(field).isNull()


def has_value(field: Column | str) -> Column:
    return _column(field).isNotNull()


def covered_by(field: Column | str, start: Any, stop: Any) -> Column:
    """The span lies within [start, stop)."""
    s = _column(field)
    return certain((s["start"] >= start) & (s["stop"] <= stop))


def intersected_by(field: Column | str, start: Any, stop: Any, closed: bool = False) -> Column:
    """The span and [start, stop) overlap; with ``closed``, touching counts."""
    s = _column(field)
    if closed:
        return certain((s["start"] <= stop) & (F.lit(start) <= s["stop"]))
    return certain((F.lit(stop) > s["start"]) & (F.lit(start) < s["stop"]))


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, map(certain, conditions), F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(operator.or_, map(certain, conditions), F.lit(False))


def negate(condition: Column) -> Column:
    return ~certain(condition)


def matches(fields: Iterable[str], fn: Callable[..., Column]) -> Column:
    """A predicate from a function over the columns of the named fields."""
    return certain(fn(*map(F.col, fields)))


def chain(*functions: Callable) -> Callable:
    """The functions one after another: chain(f, g)(x) is g(f(x))."""
    return lambda x: reduce(lambda value, f: f(value), functions, x)


def has_field(layer: DataFrame, name: str) -> bool:
    """Whether the layer declares the field."""
    return name in layer.columns
