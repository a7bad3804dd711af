"""Statistics of a table in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.logical import ColumnStats, TableStats
from .scope import quoted


def collect_stats(frame: DataFrame, columns: bool = False) -> TableStats:
    """The number of rows, and for each column the distinct values (by a sketch), nulls, and extremes."""
    wanted = [f.name for f in frame.schema if isinstance(f.dataType, T.AtomicType)] if columns else []
    parts = [F.count(F.lit(1))]
    for name in wanted:
        c = F.col(quoted(name))
        parts += [F.approx_count_distinct(c), F.count_if(c.isNull()), F.min(c), F.max(c)]
    n, *rest = frame.agg(*(p.alias(f"s{k}") for k, p in enumerate(parts))).first()
    return TableStats(n, {name: ColumnStats(*rest[4 * k : 4 * k + 4]) for k, name in enumerate(wanted)})
