"""Joining every row with the first row and the size of its group, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut

#: Bytes of an answer, about.
WIDTH = 32
#: Keys above this share of all rows are broadcast; so there are at most 1 / SUPPORT of them.
SUPPORT = 1 / 2000


def frequent(rows: DataFrame, key: str, support: float = SUPPORT) -> DataFrame:
    """Keys that may have more than `support` of the rows: at most 1 / support, none missed.

    DataFrame.freqItems is the Misra-Gries summary (Karp, Schenker and Papadimitriou's form): each task keeps
    1 / support counters, and summaries are merged on the way to one row.
    """
    found = rows.select(F.col(key).alias("k")).freqItems(["k"], support)
    return found.select(F.explode("k_freqItems").alias(key)).filter(F.col(key).isNotNull())


def lookup(rows: DataFrame, key: str, answers: DataFrame, support: float = SUPPORT, most: int = BROADCAST_BYTES) -> DataFrame:
    """`rows` left-joined with `answers`, which has one slim row for each key; a key may have a third of the rows.

    Answers, which should be materialised, are broadcast if they take `most` bytes or less. Else Misra-Gries proposes the frequent keys; their answers, at most 1 / support rows, are broadcast. The other keys have
    few rows each and are joined by an ordinary shuffle. `rows` should be slim and materialised; keys are not null.
    """
    if answers.count() * WIDTH <= most:
        return rows.join(F.broadcast(answers), key, "left")
    hot = cut(answers.join(F.broadcast(frequent(rows, key, support)), key, "left_semi"))
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(answers, key, "left")
    return near.unionByName(far)


def with_first(rows: DataFrame, key: str, order: str, support: float = SUPPORT) -> DataFrame:
    """`rows` with `first` (the least `order` among rows of equal `key`) and `size` (their number).

    Rows should be slim and already materialised: they are read four times. Keys must not be null.

    1. Misra-Gries proposes frequent keys, and an exact count verifies them.
    2. Rows of the verified keys get their answer from a broadcast of at most 1 / support rows, on the map side.
    3. The other keys, each with few rows, are summed before the shuffle and joined by an ordinary shuffle.

    An empty input gives an empty result.
    """
    answer = (F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    proposed = frequent(rows, key, support)
    counted = rows.join(F.broadcast(proposed), key, "left_semi").groupBy(key).agg(*answer)
    least = F.greatest(F.lit(2.0), F.col("total") * F.lit(support))
    winners = cut(counted.crossJoin(F.broadcast(total)).filter(F.col("size") >= least).drop("total"))
    hot = rows.join(F.broadcast(winners), key)
    cold = rows.join(F.broadcast(winners), key, "left_anti")
    groups = cold.groupBy(key).agg(*answer)
    return hot.unionByName(cold.join(groups, key))
