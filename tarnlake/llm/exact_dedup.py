"""Exact dedup with a heavy-hitter split. DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space. Misra-Gries finds
the frequent digests; their verified winners are broadcast and settle those rows on the map side. The remaining digests
are summed and joined by an ordinary shuffle (skew.py).

Defined cases: a null text counts as empty, so all null, empty and missing texts are copies of each other; a text of
white space only is one space, and differs from the empty one. The row with the smallest doc_id stays, a null doc_id
comes last, and of rows that repeat doc_id and text exactly one stays. Texts of any length are read whole, and only
their digests are shuffled; two texts of one SHA-256 would count as equal. An empty table gives an empty table. Further
columns of the documents, whatever their names, pass through `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, cut, rows_told, table, text_of, unused
from .skew import SUPPORT, with_first


def digest(docs: DataFrame) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(text_of(docs), BLANKS, " "), 256)


def exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """For every row: doc_id, keep_id (the doc_id that stays), group_size, kept, text_sha256."""
    slim = docs.select(docs["doc_id"], digest(docs).alias("text_sha256"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.monotonically_increasing_id().alias("row"))
    # the place is an id within this file only, so what follows must not compute it anew
    rows = cut(slim.select("text_sha256", place.alias("place")))
    found = with_first(rows, "text_sha256", "place", support)
    return found.select(
        F.col("place.doc_id").alias("doc_id"),
        F.col("first.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("place") == F.col("first")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of `docs`, one for each distinct text, with all their columns."""
    names = [unused(docs, n) for n in ("_id", "_no_id", "_digest")]
    parts = lambda f, d: dict(zip(names, (F.coalesce(f["doc_id"], F.lit(0)), f["doc_id"].isNull(), F.unhex(d)), strict=True))
    copies = exact_copies(docs, support)
    told = copies.select(*(c.alias(n) for n, c in parts(copies, F.col("text_sha256")).items()), "kept")
    return rows_told(docs, parts(docs, digest(docs)), told, 60)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by doc_id) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id) = 1 as kept,
       text_sha256
from t
"""
