"""Documents with every oddity at once."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that the operators use themselves
    + [T.StructField(n, T.StringType()) for n in ("score", "kept", "node", "key", "size", "fingerprint", "place", "range", "ids", "text_", "_id")]
)

LONG = " ".join(f"word{k % 977} of{k % 13}" for k in range(30_000))
TEXTS = [
    None, "", " \n\t", "one", "one", "a b  c", "a b c", "a\tb\nc", LONG, LONG + " end", "x" * 5000, "Grüße aus Köln, ça va bien? 漢字 🙂 é", "GRÜSSE AUS KÖLN, ÇA VA BIEN? 漢字 🙂 É",
    "the cat sat on the mat and looked at the dog for a very long time indeed today", "the cat sat on the mat and looked at the dog for a very long time indeed today too", "123 456 !!!", "<s> ▁ \x00 <|endoftext|>",
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(k, t, [None, "en", "de", "fr"][k % 4], [None, "s1", "s2", ""][k % 4], None if t is None else len(t)) for k, t in enumerate(TEXTS)]
    rows += [rows[4], rows[13], (None, "without an id", "en", "s1", 13), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *["clash"] * 11) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
