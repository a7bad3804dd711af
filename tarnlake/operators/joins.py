"""Inner joins. Keys of an equality are positional: the left name is the left input's, the right name the right's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.syntax import BinaryExpression, Expression, Identifier
from .predicates import same_kind, condition
from .scope import column, quoted

_PRIVATE = "_right_"
#: Spark's names of the strategies.
HINTS = {"broadcast": "broadcast", "sort_merge": "merge", "hash": "shuffle_hash"}
#: A side is broadcast only if Spark too believes that it has at most so many bytes.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(frame: DataFrame) -> int:
    """Spark's estimate of the size of a result, from the statistics of its files."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(left: DataFrame, right: DataFrame, strategy: str | None, forced: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides, the smaller one with the strategy's hint.

    Only a broadcast of a side that is known to be small is hinted, unless a strategy is forced: Spark's adaptive execution
    may still turn a sort and merge into a broadcast once it has seen the sides, which a hint would forbid.
    """
    if strategy is None or strategy != "broadcast" and not forced:
        return left, right
    sizes = estimated_bytes(left), estimated_bytes(right)
    if strategy == "broadcast" and min(sizes) > BROADCAST_BYTES:
        return left, right
    hint = HINTS[strategy]
    return (left, right.hint(hint)) if sizes[1] <= sizes[0] else (left.hint(hint), right)


def merged(joined: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """One column for each name: the left's names, then those that only the right has; the right's value counts."""
    new = [n for n in right if n not in left]
    return joined.select(*(joined[quoted(_PRIVATE + n if n in right else n)].alias(n) for n in [*left, *new]))


def join(left: DataFrame, right: DataFrame, on: Expression, strategy: str | None = None, forced: bool = False) -> DataFrame:
    """Rows of both sides for which the condition holds. Null keys are equal.

    The condition is over columns of the two sides, so that Catalyst finds its equalities. The right side's columns have
    private names meanwhile, so that a table may be joined with itself.
    """
    names, others = left.columns, right.columns
    private = right.select(*(right[quoted(n)].alias(_PRIVATE + n) for n in others))
    match on:
        case BinaryExpression(Identifier(a), "=", Identifier(b)):
            key, other = column(left, a), column(private, _PRIVATE + b)
            same = same_kind(left.schema[a].dataType, right.schema[b].dataType)
            test = key.eqNullSafe(other) if same else F.lit(False)
        case _:  # a name is that of the merged row
            test = condition(on, _Sides(left, private, names, others))
            if not _has_equality(on):
                strategy = strategy if strategy == "broadcast" else None  # the others need keys
    one, two = hinted(left, private, strategy, forced)
    return merged(one.join(two, test), names, others)


def _has_equality(e: Expression) -> bool:
    """Whether an equality of two columns must hold."""
    if isinstance(e, BinaryExpression) and e.operator == "AND":
        return _has_equality(e.left) or _has_equality(e.right)
    return isinstance(e, BinaryExpression) and e.operator == "=" and isinstance(e.left, Identifier) and isinstance(e.right, Identifier)


class _Sides:
    """Looks like the merged row, with columns of the two sides themselves."""

    def __init__(self, left: DataFrame, right: DataFrame, names: list[str], others: list[str]):
        self.left, self.right, self.others = left, right, others
        self.columns = [*names, *(n for n in others if n not in names)]
        self.schema = {n: right.schema[_PRIVATE + n] if n in others else left.schema[n] for n in self.columns}

    def __getitem__(self, name: str):
        plain = name[1:-1].replace("``", "`")
        return self.right[quoted(_PRIVATE + plain)] if plain in self.others else self.left[name]
