"""Names of a DataFrame, as the dialect sees them: exact, case-sensitive, each once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


@contextmanager
def exact_names(spark: SparkSession) -> Iterator[None]:
    """Names are resolved when a DataFrame is built; so the setting is needed, and changed, only meanwhile."""
    key, before = "spark.sql.caseSensitive", spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(frame: DataFrame, name: str) -> Column:
    """A column by its exact name."""
    if name not in frame.columns:
        raise KeyError(f"no column {name!r}; there are {', '.join(frame.columns)}")
    return frame[quoted(name)]


def last_of_each(named: Iterable[tuple[str, Column]]) -> list[Column]:
    """Columns under their names; of a name that comes again the last value counts, in the first place."""
    return [c.alias(n) for n, c in dict(named).items()]
