"""Projection, filter, aggregation and sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate as call
from ..plans.syntax import BinaryExpression, Expression, FunctionCall, Identifier, Literal, OrderItem, SelectItem, Star
from .predicates import condition, type_of, value
from .scope import column, last_of_each, quoted

_ROWS = "_rows_"


def project(frame: DataFrame, items: Sequence[SelectItem]) -> DataFrame:
    """Columns, all columns for `*`, and literals, which are called `literal`."""
    out: list[tuple[str, Column]] = []
    for item in items:
        match item.expression:
            case Star():
                out += [(n, column(frame, n)) for n in frame.columns]
            case Identifier(name):
                out.append((item.alias or name, column(frame, name)))
            case Literal(v):
                out.append((item.alias or "literal", F.lit(v)))
            case e:
                raise ValueError(f"a select list has no {type(e).__name__}")
    return frame.select(*last_of_each(out))


def keep(frame: DataFrame, predicate: Expression) -> DataFrame:
    return frame.filter(condition(predicate, frame))


def _name(e: Expression, alias: str | None = None) -> str:
    if alias:
        return alias
    return e.name if isinstance(e, Identifier) else e.name.lower() if isinstance(e, FunctionCall) else "expr"


def aggregate(frame: DataFrame, group_by: Sequence[Expression], items: Sequence[SelectItem], first_by: str | None = None) -> DataFrame:
    """Group columns, then the select list.

    A column of the list that is no group column has the value of the group's first row: the one with the least
    `first_by`, a column of the input. Without `first_by` it is the row that is least in these columns themselves, compared
    from left to right, nulls first; so the result does not depend on the order in which Spark reads. No rows give no group,
    even without GROUP BY.
    """
    bare = [i.expression.name for i in items if isinstance(i.expression, Identifier)]
    least = F.min(F.struct(*(column(frame, n).alias(f"_{k}") for k, n in enumerate(bare)))) if bare and first_by is None else None
    keys: list[tuple[str, Column]] = []
    for e in group_by:
        if not isinstance(e, Identifier | Literal | BinaryExpression):
            raise ValueError(f"a group key is no {type(e).__name__}")
        keys.append((_name(e), value(e, frame)))
    aggregates: list[tuple[str, Column]] = []
    for item in items:
        match item.expression:
            case FunctionCall(name, arguments):
                if len(arguments) > 1:
                    raise ValueError(f"{name} takes one argument")
                argument = arguments[0] if arguments else Star()
                if isinstance(argument, Star):
                    out = call(name, None, None)
                else:
                    out = call(name, value(argument, frame), type_of(argument, frame))
            case Identifier(name):
                out = F.min_by(column(frame, name), column(frame, first_by)) if least is None else least[f"_{bare.index(name)}"]
            case Literal(v):
                out = F.first(F.lit(v))
            case e:
                raise ValueError(f"an aggregate has no {type(e).__name__}")
        aggregates.append((_name(item.expression, item.alias), out))
    own = {f"_key_{k}": c for k, (_, c) in enumerate(keys)}
    made = {f"_made_{k}": c for k, (_, c) in enumerate(aggregates)}
    grouped = frame.groupBy(*(c.alias(n) for n, c in own.items()))
    extra = {} if keys else {_ROWS: F.count(F.lit(1))}
    out = grouped.agg(*(c.alias(n) for n, c in (made | extra).items())) if made or extra else frame.select(*(c.alias(n) for n, c in own.items())).distinct()
    if not keys:
        out = out.filter(F.col(_ROWS) > 0)
    names = [n for n, _ in keys] + [n for n, _ in aggregates]
    return out.select(*last_of_each(zip(names, (F.col(n) for n in [*own, *made]), strict=True)))


def sort(frame: DataFrame, order_by: Sequence[OrderItem]) -> DataFrame:
    """Sorted rows. A literal orders nothing; a call is the output column of its name."""
    keys: list[Column] = []
    for item in order_by:
        match item.expression:
            case Literal():
                continue
            case Star():
                raise ValueError("rows are not ordered by *")
            case BinaryExpression() as e:
                key = value(e, frame)
            case e:
                key = column(frame, _name(e))
        keys.append(key.desc() if item.descending else key.asc())
    return frame.orderBy(*keys) if keys else frame


def wants_below(order_by: Sequence[OrderItem], output: Sequence[str], below: Sequence[str]) -> bool:
    """Whether sorting needs a column that a projection drops."""
    return any(isinstance(o.expression, Identifier) and o.expression.name not in output and o.expression.name in below for o in order_by)


def distinct_names(frame: DataFrame) -> DataFrame:
    """A source's columns, of equal names the last."""
    if len(set(frame.columns)) == len(frame.columns):
        return frame
    renamed = frame.toDF(*(f"_c{k}" for k in range(len(frame.columns))))
    return renamed.select(*last_of_each((n, renamed[quoted(f"_c{k}")]) for k, n in enumerate(frame.columns)))
