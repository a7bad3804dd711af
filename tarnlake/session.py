"""The engine's front door: tables by name, queries in the dialect, plans as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators.scope import exact_names
from .operators.statistics import collect_stats
from .plans.dialect import Parser
from .plans.logical import CostModel, LogicalPlanner, Optimizer, Plan, StatsCatalog, TableStats, render
from .plans.lower import lower
from .plans.syntax import Query
from .sources import files
from .sources.memory import from_rows, to_rows


@dataclass(frozen=True)
class LocalScheduler:
    """How many tasks may make a result at a time, and rows of a batch of it. Less than 1 counts as 1."""

    workers: int = 1
    batch_size: int = 4096

    def __post_init__(self):
        object.__setattr__(self, "workers", max(1, self.workers))
        object.__setattr__(self, "batch_size", max(1, self.batch_size))

    def bound(self, frame: DataFrame) -> DataFrame:
        """The same rows in at most so many partitions."""
        return frame.coalesce(self.workers)


class EngineSession:
    """Tables and statistics of one user; several may share a SparkSession.

    Queries are built as DataFrames and left to Catalyst and adaptive execution. Nothing runs until the result is used.
    A scheduler bounds the tasks that make a result; without one, all that Spark has are used.
    """

    def __init__(self, spark: SparkSession, stats: StatsCatalog | None = None, scheduler: LocalScheduler | None = None):
        self.spark = spark
        self.stats = stats or StatsCatalog()
        self.scheduler = scheduler
        self.tables: dict[str, DataFrame] = {}

    # tables

    def register(self, name: str, table: DataFrame | Sequence[Mapping[str, object]]) -> DataFrame:
        """A DataFrame, or rows as dicts."""
        self.tables[name] = table if isinstance(table, DataFrame) else from_rows(self.spark, table)
        return self.tables[name]

    def register_folder(self, folder: str, names: Sequence[str] = files.NAMES) -> EngineSession:
        """Parquet tables `<folder>/<name>.parquet`."""
        for name in names:
            self.register(name, files.parquet(self.spark, folder, name))
        return self

    def analyze(self, *names: str, columns: bool = False) -> EngineSession:
        """Collect statistics, which choose the strategies of joins."""
        for name in names:
            self.stats.register(name, collect_stats(self.tables[name], columns))
        return self

    def register_stats(self, name: str, stats: TableStats) -> None:
        self.stats.register(name, stats)

    # queries

    def parse(self, sql: str) -> Query:
        return Parser().parse(sql)

    def plan(self, query: str | Query) -> Plan:
        return LogicalPlanner().plan(self.parse(query) if isinstance(query, str) else query)

    def optimized_plan(self, query: str | Query) -> Plan:
        return Optimizer(CostModel(self.stats), self.stats).optimize(self.plan(query))

    def sql(self, query: str | Query, first_by: str | None = None) -> DataFrame:
        """The result of a query, as text or as a syntax tree. first_by: what makes a row the first of its group, for
        columns of an aggregate that are no group keys."""
        return self.execute(self.optimized_plan(query), first_by)

    def execute(self, plan: Plan, first_by: str | None = None) -> DataFrame:
        with exact_names(self.spark):
            out = lower(plan, self.tables, first_by)
        return self.scheduler.bound(out) if self.scheduler else out

    @property
    def workers(self) -> int:
        return self.scheduler.workers if self.scheduler else self.spark.sparkContext.defaultParallelism

    @property
    def execution_mode(self) -> str:
        return "parallel" if self.workers > 1 else "sequential"

    def execution_summary(self, query: str | Query | Plan) -> str:
        """Mode, workers, and the kind of the plan's root."""
        plan = query if isinstance(query, Plan) else self.plan(query)
        return f"mode={self.execution_mode} workers={self.workers} plan={type(plan).__name__}"

    def rows(self, query: str | Query, first_by: str | None = None) -> list[dict[str, object]]:
        return to_rows(self.sql(query, first_by))

    def explain(self, query: str | Query, physical: bool = False) -> str:
        """The optimized plan and its estimated cost; with `physical`, also what Spark makes of it."""
        plan = self.optimized_plan(query)
        cost = CostModel(self.stats).estimate(plan)
        out = f"{render(plan)}\nestimated rows {cost.rows:g}, cost {cost.total:g} (cpu {cost.cpu:g}, io {cost.io:g}, network {cost.network:g})"
        if physical:
            frame = self.execute(plan)
            out += "\n" + frame._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return out


class RowExecutor:
    """Plans to rows as dicts."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def execute(self, plan: Plan, tables: Mapping[str, DataFrame | Sequence[Mapping[str, object]]]) -> list[dict[str, object]]:
        session = EngineSession(self.spark)
        for name, table in tables.items():
            session.register(name, table)
        return to_rows(session.execute(plan))
