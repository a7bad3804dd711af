"""Syntax tree of the dialect. The names of the nodes and of their fields."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Identifier:
    name: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class FunctionCall:
    name: str
    arguments: tuple[Expression, ...] = ()


@dataclass(frozen=True)
class BinaryExpression:
    left: Expression
    operator: str
    right: Expression


Expression = Identifier | Star | Literal | FunctionCall | BinaryExpression


@dataclass(frozen=True)
class SelectItem:
    expression: Expression
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str


@dataclass(frozen=True)
class JoinClause:
    table: TableRef
    condition: Expression


@dataclass(frozen=True)
class OrderItem:
    expression: Expression
    descending: bool = False


@dataclass(frozen=True)
class Cte:
    name: str
    query: Query


@dataclass(frozen=True)
class Query:
    select: tuple[SelectItem, ...]
    table: TableRef
    joins: tuple[JoinClause, ...] = ()
    where: Expression | None = None
    group_by: tuple[Expression, ...] = ()
    order_by: tuple[OrderItem, ...] = ()
    ctes: tuple[Cte, ...] = ()


def show(e: Expression) -> str:
    """The expression as dialect text."""
    match e:
        case Identifier(name):
            return name
        case Star():
            return "*"
        case Literal(value):
            return f"'{value}'" if isinstance(value, str) else str(value)
        case FunctionCall(name, arguments):
            return f"{name}({', '.join(map(show, arguments))})"
        case BinaryExpression(left, operator, right):
            return f"({show(left)} {operator} {show(right)})"
    raise TypeError(f"not an expression: {e!r}")
