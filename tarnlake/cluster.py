"""Queries over tables that are spread over workers. Spark's executors do the work; what is left is naming and order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.joins import join
from .operators.scope import exact_names, quoted
from .plans.syntax import BinaryExpression, Identifier, Query
from .session import EngineSession
from .sources.memory import from_rows


def in_order(frame: DataFrame) -> DataFrame:
    """Sorted by `name`, or by all columns if there is none."""
    by = ["name"] if "name" in frame.columns else frame.columns
    return frame.orderBy(*(F.col(quoted(c)) for c in by))


def distributed_query(session: EngineSession, query: str | Query) -> DataFrame:
    """A query's result in a fixed order; one global query, whatever its clauses."""
    return in_order(session.sql(query))


def distributed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on a key of each side, in a fixed order; Spark broadcasts a side that is small at run time."""
    with exact_names(left.sparkSession):
        return in_order(join(left, right, BinaryExpression(Identifier(left_key), "=", Identifier(right_key))))


def distributed_count(frame: DataFrame, key: str) -> DataFrame:
    """Rows of each key, counted within each task first, in the order of the key."""
    return frame.groupBy(F.col(quoted(key)).alias(key)).agg(F.count(F.lit(1)).alias("count")).orderBy(key)


class Shards:
    """Tables registered worker by worker. Facts are the union of the workers' shards; replicated tables are taken once."""

    def __init__(self, session: EngineSession, replicated: Iterable[str] = ()):
        self.session, self.replicated = session, frozenset(replicated)
        self._shards: dict[str, dict[str, DataFrame]] = {}

    def register(self, worker: str, tables: Mapping[str, DataFrame | Sequence[Mapping[str, object]]]) -> None:
        for name, table in tables.items():
            frame = table if isinstance(table, DataFrame) else from_rows(self.session.spark, table)
            self._shards.setdefault(name, {})[worker] = frame

    def table(self, name: str) -> DataFrame:
        shards = list(self._shards[name].values())
        return shards[0] if name in self.replicated else reduce(DataFrame.unionByName, shards)

    def query(self, query: str | Query) -> DataFrame:
        """One global query over all shards."""
        whole = EngineSession(self.session.spark, self.session.stats, self.session.scheduler)
        whole.tables = self.session.tables | {name: self.table(name) for name in self._shards}
        return whole.sql(query)
