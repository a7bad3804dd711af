"""Expressions as Spark columns, with the dialect's comparisons: null equals null, a number never equals a string, and
conditions take anything by its truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import BinaryExpression, Expression, Identifier, Literal
from .scope import column

_LITERAL = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}


def kind(type_: T.DataType) -> str:
    """Types of one kind can be compared."""
    if isinstance(type_, T.NumericType | T.BooleanType):
        return "number"
    if isinstance(type_, T.StringType | T.CharType | T.VarcharType):
        return "string"
    if isinstance(type_, T.NullType):
        return "null"
    return "time" if isinstance(type_, T.DateType | T.TimestampType | T.TimestampNTZType) else type_.typeName()


def type_of(e: Expression, frame: DataFrame) -> T.DataType:
    match e:
        case Identifier(name):
            column(frame, name)
            return frame.schema[name].dataType
        case Literal(value):
            return _LITERAL[type(value)]
        case BinaryExpression():
            return T.BooleanType()
    raise ValueError(f"{type(e).__name__} has no place in a condition")


def truth(value: Column, type_: T.DataType) -> Column:
    """Whether a value counts as true: numbers but 0, texts but the empty one, and never null.

    Null stands for false, since the dialect cannot negate; so conditions stay plain enough to be pushed into scans.
    """
    if isinstance(type_, T.BooleanType):
        return value
    match kind(type_):
        case "number":
            return value != 0
        case "string":
            return value != ""
        case "null":
            return F.lit(False)
    return value.isNotNull()


def same_kind(a: T.DataType, b: T.DataType) -> bool:
    kinds = {kind(a), kind(b)}
    return len(kinds) == 1 or "null" in kinds


def _number(value: Column, type_: T.DataType, other: T.DataType) -> Column:
    # true is 1 beside a number
    return value.cast("long") if isinstance(type_, T.BooleanType) and not isinstance(other, T.BooleanType) else value


def value(e: Expression, frame: DataFrame) -> Column:
    """The column of an expression over the columns of `frame`."""
    match e:
        case Identifier(name):
            return column(frame, name)
        case Literal(v):
            return F.lit(v)
        case BinaryExpression(left, operator, right):
            return _binary(left, operator, right, frame)
    raise ValueError(f"{type(e).__name__} has no place in a condition")


def _binary(left: Expression, operator: str, right: Expression, frame: DataFrame) -> Column:
    a, b = value(left, frame), value(right, frame)
    s, t = type_of(left, frame), type_of(right, frame)
    if operator in ("AND", "OR"):
        a, b = truth(a, s), truth(b, t)
        return a & b if operator == "AND" else a | b
    a, b = _number(a, s, t), _number(b, t, s)
    if operator in ("=", "!="):
        if not same_kind(s, t):
            return F.lit(operator != "=")
        if operator == "=" and any(isinstance(e, Literal) and e.value is not None for e in (left, right)):
            return a == b  # null equals no literal
        return a.eqNullSafe(b) if operator == "=" else ~a.eqNullSafe(b)
    order: dict[str, Callable[[Column, Column], Column]] = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}
    if operator not in order:
        raise ValueError(f"no operator {operator!r}")
    if not same_kind(s, t):
        raise TypeError(f"{s.simpleString()} and {t.simpleString()} have no order")
    return order[operator](a, b)


def condition(e: Expression, frame: DataFrame) -> Column:
    return truth(value(e, frame), type_of(e, frame))
