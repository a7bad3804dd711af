"""The aggregate functions by name. Each takes the argument's column and type, or None for `*`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count(value: Column | None, type_: T.DataType | None) -> Column:
    """Rows of the group, whatever the argument: nulls count too."""
    return F.count(F.lit(1))


def total(value: Column | None, type_: T.DataType | None) -> Column:
    """Sum from 0; true counts as 1."""
    if value is None or not isinstance(type_, T.NumericType | T.NullType | T.BooleanType):
        raise TypeError("sum takes a number")
    if isinstance(type_, T.BooleanType):
        value = value.cast("long")
    return F.coalesce(F.sum(value), F.lit(0))


def _extreme(function: Callable[[Column], Column], name: str):
    def out(value: Column | None, type_: T.DataType | None) -> Column:
        if value is None:
            raise ValueError(f"{name} takes a column or a literal")
        return function(value)

    return out


AGGREGATES: dict[str, Callable[[Column | None, T.DataType | None], Column]] = {"count": count, "sum": total, "min": _extreme(F.min, "min"), "max": _extreme(F.max, "max")}


def aggregate(name: str, value: Column | None, type_: T.DataType | None) -> Column:
    """By a name in any case."""
    if name.lower() not in AGGREGATES:
        raise ValueError(f"no aggregate function {name!r}; there are {', '.join(AGGREGATES)}")
    return AGGREGATES[name.lower()](value, type_)
