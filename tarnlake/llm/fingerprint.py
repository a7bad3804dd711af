"""Document fingerprints: canonical exact digest. DataFrame functions only.

The canonical form of a text is its Unicode normalisation (compatibility composition), full case folding, normalisation
again, and each run of white space as one space, none at the ends. Both Unicode steps are calls of the ICU library that
Spark ships, through the SQL function java_method, inside the JVM.

The fingerprint is a wide xxhash of the canonical form: two 64-bit hashes with independent seeds, 32 hex digits. Equal
fingerprints are a bucket (skew.py deals with buckets of a third of all rows). Within buckets of two rows or more, bytes are
compared: their texts are grouped by the hash and the canonical bytes themselves, so that texts that collide in 128 bits
are classes of their own. Texts that are alone in their buckets are not shuffled for it, and grouping combines equal texts
in each task before the shuffle.

The likeness of two texts is 1 if their fingerprints and their canonical bytes are equal, else 0: an exact digest knows
nothing in between.

Defined cases: a null text counts as empty; text of white space only has the canonical form of the empty text. A null
doc_id is the last in descending order. Rows that repeat a doc_id follow each other in the order of a hash of their texts. A
single document is followed by itself. Texts of any length are read whole. An empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small, table, text_of
from .skew import with_first

#: Rows of a range of doc_ids within which documents are put in order; more, if there were more than MOST_RANGES. So what is
#: broadcast about them, 12 bytes for each, has a bound.
ROWS_OF_RANGE = 4_000
MOST_RANGES = 50_000
#: Place of a range after the parts into which a frequent doc_id is divided.
AFTER_PARTS = (1 << 31) - 1

#: White space of Unicode.
BLANKS = r"[\s\x{85}\p{Z}]+"


def canonical(text: Column) -> Column:
    composed = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), BLANKS, " "))


def wide_hash(canonical_text: Column) -> Column:
    """32 hex digits."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canonical_text))), 16, "0")
    return F.concat(half(1), half(2))


def turn(text: Column) -> Column:
    """A hash of the text as it stands, which orders rows of one doc_id."""
    return F.xxhash64(text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, text (never null), turn, fingerprint."""
    known = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    return known.select("doc_id", "text", turn(F.col("text")).alias("turn"), wide_hash(canonical(F.col("text"))).alias("fingerprint"))


def classified(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, turn, fingerprint and more, materialised) of `docs` with class_id (the smallest doc_id of its class,
    null only if no row of it has one), class_size and forms (canonical texts of the fingerprint: 1 unless 128 bits collide)."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    found = with_first(rows.withColumn("place", place), "fingerprint", "place")
    found = cut(found.select(*rows.columns, F.col("first.doc_id").alias("class_id"), F.col("size").alias("class_size"), F.lit(1).cast("long").alias("forms")))
    # texts whose bytes have to be compared, by their hashes
    shared = cut(found.filter("class_size > 1").select("turn").distinct())
    known = docs.select(docs["doc_id"], text_of(docs).alias("text")).withColumn("turn", turn(F.col("text"))).join(small(shared, 16), "turn", "left_semi")
    known = known.withColumn("form", canonical(F.col("text"))).withColumn("fingerprint", wide_hash(F.col("form")))
    own = known.groupBy("fingerprint", "form").agg(F.min(F.col("doc_id").cast("long")).alias("own_id"), F.count(F.lit(1)).alias("own_size"))
    collided = cut(own.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_forms")).filter("n_forms > 1"))
    if collided.isEmpty():
        return found
    apart = own.join(small(collided, 64), "fingerprint")
    told = known.select(F.col("doc_id").cast("long").alias("its_id"), "turn", "fingerprint", "form").join(apart, ["fingerprint", "form"])
    told = told.select("its_id", F.col("turn").alias("its_turn"), F.col("fingerprint").alias("its_print"), "own_id", "own_size", "n_forms").distinct()
    same = found["doc_id"].eqNullSafe(told["its_id"]) & (found["turn"] == told["its_turn"]) & (found["fingerprint"] == told["its_print"])
    mine = F.col("n_forms").isNotNull()
    either = lambda a, b: F.when(mine, F.col(a)).otherwise(F.col(b)).alias(b)
    return found.join(told, same, "left").select(*rows.columns, either("own_id", "class_id"), either("own_size", "class_size"), either("n_forms", "forms"))


def reached(values: Column, x: Column, n: int) -> Column:
    """How many of the sorted `values`, an array of up to n, are less than x: a binary search in steps of powers of two."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) < x, at + step).otherwise(at))


class Ranges:
    """Ranges of about `size` rows, of rows (doc_id, turn and more) in descending order of doc_id, then ascending of turn.

    Cuts are percentiles of the doc_ids. A doc_id that takes several of them is divided by turn into as many parts, and so
    are the rows without one.
    """

    def __init__(self, ids: DataFrame, size: int):
        n_rows, n_null = ids.agg(F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
        size = max(size, n_rows // MOST_RANGES)
        self.n, self.n_without = 1 + (n_rows - n_null) // size, 1 + n_null // size
        n_cuts = max(1, self.n - 1)  # as one constant, however many
        shares = F.split(F.lit(",".join(f"{k / (n_cuts + 1):.9f}" for k in range(1, n_cuts + 1))), ",").cast("array<double>")
        cuts = ids.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 4 * self.n))).alias("c")).select(F.explode("c").alias("c"))
        counted = cuts.groupBy("c").agg(F.count(F.lit(1)).cast("int").alias("m")).agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("p"))
        # an approximation may come out differently each time; one row, of 12 bytes for each range
        self.cuts = cut(counted.select(F.transform("p", lambda x: x["c"]).alias("cuts"), F.transform("p", lambda x: x["m"]).alias("parts")))

    def of(self, rows: DataFrame) -> DataFrame:
        """`rows` with `at` and `within`: ranges follow each other in descending order of at, then ascending of within."""
        share = F.shiftright(F.col("turn"), 33) + F.lit(1 << 30)  # 31 bits, in the order of turns
        part = lambda m: F.shiftright(share * m, 31).cast("int")
        none = F.col("doc_id").isNull()
        placed = rows.crossJoin(F.broadcast(self.cuts)).withColumn("at", F.when(none, -1).otherwise(reached(F.col("cuts"), F.col("doc_id"), self.n)))
        often = F.get("parts", F.col("at"))
        divided = (F.get("cuts", F.col("at")) == F.col("doc_id")) & (often > 1)
        return placed.withColumn("within", F.when(none, part(F.lit(self.n_without))).when(divided, part(often)).otherwise(AFTER_PARTS)).drop("cuts", "parts")


def followed(docs: DataFrame, size: int = ROWS_OF_RANGE) -> DataFrame:
    """`fingerprints` with next_text and next_fingerprint: of the next document in descending order of doc_id, after the
    last the first.

    Each range of doc_ids is one window, and the first document of a range is copied into the range before it; so texts
    are shuffled once.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    ranges = Ranges(plain.select("doc_id"), size)
    # one row for each range: its first document, and the range that it follows
    slim = ranges.of(plain.select("doc_id", turn(F.col("text")).alias("turn")))
    heads = slim.groupBy("at", "within").agg(F.max(F.struct("doc_id", F.bitwise_not("turn").alias("back"))).alias("head"))
    order = W.orderBy(F.col("at").desc(), "within")
    before = lambda c: F.coalesce(F.lag(c).over(order), F.last(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = cut(heads.select(F.col("head.doc_id").alias("head_id"), F.bitwise_not("head.back").alias("head_turn"), before("at").alias("at"), before("within").alias("within")))
    known = ranges.of(fingerprints(docs.withColumn("doc_id", docs["doc_id"].cast("long")))).withColumn("copy", F.lit(False))
    # rows alike in doc_id and text may all be heads; one is copied
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("turn") == F.col("head_turn"))
    copies = plain.withColumn("turn", turn(F.col("text"))).join(F.broadcast(heads), is_head).groupBy("at", "within").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"), F.min("turn").alias("turn"))
    copies = copies.select("doc_id", "text", "turn", wide_hash(canonical(F.col("text"))).alias("fingerprint"), "at", "within", F.lit(True).alias("copy"))
    down = W.partitionBy("at", "within").orderBy("copy", F.col("doc_id").desc_nulls_last(), "turn", "text")
    after = lambda c: F.lead(c).over(down)
    dealt = known.select(*copies.columns).unionByName(copies)
    dealt = dealt.select("doc_id", "text", "turn", "fingerprint", "copy", after("text").alias("next_text"), after("fingerprint").alias("next_fingerprint"))
    return dealt.filter(~F.col("copy")).drop("copy")


def alike(fingerprint: Column, other: Column, text: Column, other_text: Column) -> Column:
    """1.0 if both fingerprints and, within the bucket, the canonical bytes are equal; else 0.0."""
    return F.when(fingerprint != other, 0.0).when(text == other_text, 1.0).when(canonical(text) == canonical(other_text), 1.0).otherwise(0.0)


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the following text, or all that it has."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = followed(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    found = found.withColumn("edited_fingerprint", wide_hash(canonical(F.col("edited"))))
    rows = cut(
        found.select(
            "doc_id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
            alike(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("text"), F.col("edited")).alias("near_edited"),
            alike(F.col("fingerprint"), F.col("next_fingerprint"), F.col("text"), F.col("next_text")).alias("near_next"),
            "turn",
        )
    )
    return classified(docs, rows).drop("turn")
