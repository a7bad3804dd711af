"""What several operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else is part of a word.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to a Python worker, or one longer row.
BATCH_BYTES = 4 << 20
#: What is broadcast because its size was checked is no larger.
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the session names none, a local master gets a folder of its own, as in tests; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tarnlake-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_SCRATCH: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what results read until they are used; deleted at exit or by `clear_scratch`."""
    if not _SCRATCH:
        atexit.register(clear_scratch)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    _SCRATCH.pop(path, None)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


def clear_scratch() -> None:
    """Delete all folders that `scratch` named and that are still there. Results that read them are of no use afterwards."""
    for path, spark in list(_SCRATCH.items()):
        _SCRATCH.pop(path)
        # at exit Spark may be gone; nothing but the folder is lost then
        with contextlib.suppress(Exception):
            remove(spark, path)


def cut(frame: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs only its running tasks."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def small(frame: DataFrame, width: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A materialised `frame` of rows of about `width` bytes, marked for a broadcast if all of it takes `most` bytes or
    less; else as it is, for an ordinary join."""
    return F.broadcast(frame) if frame.count() * width <= most else frame


def rows_told(docs: DataFrame, keys: dict[str, Column], told: DataFrame, width: int) -> DataFrame:
    """The rows of `docs` that `told` keeps, with all their columns.

    told has a row for each of docs: their keys, by the names of `keys` (expressions over docs, never null), and `kept`.
    Rows alike in all keys are one to us: if `told` keeps any of them, one of them stays. Only keys of rows that go, or of
    rows that repeat, are joined with docs; they are broadcast if they are few (`width`: bytes of all keys of a row).
    """
    names = list(keys)
    rows = told.groupBy(*names).agg(F.max(F.col("kept").cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
    few = cut(rows.filter("stays = 0 or n > 1"))
    gone, repeated = few.filter("stays = 0").select(*names), few.filter("stays = 1").select(*names)
    left = docs.select("*", *(c.alias(n) for n, c in keys.items())).join(small(gone, width), names, "left_anti")
    if not repeated.isEmpty():
        again = small(repeated, width)
        left = left.join(again, names, "left_anti").unionByName(left.join(again, names, "left_semi").dropDuplicates(names))
    return left.select(*docs.columns)


def mapped(frame: DataFrame, rows: Callable[[Iterator], Iterator], schema, most: int = BATCH_BYTES) -> DataFrame:
    """`frame.mapInArrow(rows, schema)` over batches of bounded bytes; workers give memory back after each task.

    The bound is the session's spark.sql.execution.arrow.maxBytesPerBatch, which is set here.
    """
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))

    def task(batches: Iterator) -> Iterator:
        yield from rows(batches)
        give_back()

    return frame.mapInArrow(task, schema)


_HELD: dict[str, Callable[[], object]] = {}


def hold(owner: str, forget: Callable[[], object]) -> None:
    """In a Python worker, which Spark keeps for tasks of other operators: what `owner` remembers from now on is given up
    by `forget` as soon as another owner begins."""
    if owner in _HELD:
        return
    for other in list(_HELD):
        _HELD.pop(other)()
    give_back()
    _HELD[owner] = forget


def give_back() -> None:
    """Return freed memory to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def unused(docs: DataFrame, name: str) -> str:
    """A column name like `name` that the documents do not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
