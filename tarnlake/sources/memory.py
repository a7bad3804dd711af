"""Tables from and to rows in memory."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterator, Mapping, Sequence
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_TYPES: dict[type, T.DataType] = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    decimal.Decimal: T.DecimalType(38, 18),
    datetime.datetime: T.TimestampNTZType(),
    datetime.date: T.DateType(),
}


def _type(name: str, values: Sequence[object]) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int, float} and float in kinds:
        return T.DoubleType()
    if len(kinds) > 1:
        raise TypeError(f"column {name!r} mixes {', '.join(sorted(k.__name__ for k in kinds))}")
    return _TYPES[kinds.pop()] if kinds else T.StringType()


def from_rows(spark: SparkSession, rows: Sequence[Mapping[str, object]], schema: T.StructType | None = None) -> DataFrame:
    """A table of dicts. Names and order of columns are those of the first row; what later rows have besides is dropped,
    what they lack is an error. An empty list needs a schema, or has no columns."""
    if not rows:
        return spark.createDataFrame([], schema or T.StructType())
    names = list(rows[0]) if schema is None else schema.names
    data = [tuple(row[n] for n in names) for row in rows]
    if schema is None:
        columns = list(zip(*data, strict=True))
        schema = T.StructType([T.StructField(n, _type(n, c)) for n, c in zip(names, columns, strict=True)])
        wide = [isinstance(f.dataType, T.DoubleType) for f in schema]
        data = [tuple(float(v) if w and v is not None else v for v, w in zip(row, wide, strict=True)) for row in data]
    if not names:
        return spark.createDataFrame(data, schema)
    # as an Arrow table, which gives a relation of known size
    arrow = to_arrow_schema(schema)
    columns = [pa.array(c, f.type) for c, f in zip(zip(*data, strict=True), arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def to_rows(frame: DataFrame) -> list[dict[str, object]]:
    """All rows as dicts, on the driver."""
    return [r.asDict() for r in frame.collect()]


def project(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns of these names in this order; names that the table lacks are left out."""
    return frame.select(*(frame[n] for n in names if n in frame.columns))


def batches(frame: DataFrame, size: int) -> Iterator[list[dict[str, object]]]:
    """All rows in lists of `size` or fewer, of which the driver holds a partition's at a time."""
    for some in batched(frame.toLocalIterator(), max(1, size)):
        yield [r.asDict() for r in some]
