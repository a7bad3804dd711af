"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over the training time [0, 1]. Integrated, it says how many of the source's target
tokens are used up to any time. The documents of a source stand in a fixed shuffled order; a document's place in the
running sum of sizes is the demand at which its turn comes, and inverting the integral gives its position. Documents
are then range-sorted by position. A source whose target exceeds its size begins its documents again.

The shuffled order is by MD5 of the doc_id and the text's MD5, so that reruns agree, and rows that share a doc_id or have
none are spread as well. Running sums are taken within (source, bucket), where a bucket is a range of the order; there are
as many as the square root of the number of rows, so that a source with a third of all rows is spread over many tasks at any
size, and its buckets are as few as the rows of one. No result depends on their number. Buckets' totals are summed before
the shuffle.

Defined cases: a null text has size 0, is taken 0 times and has no position; a null source is a source of its own, the
last; a null doc_id is ordered as an empty one. Texts of any length are counted whole. Rows alike in doc_id and text stand
side by side. If all sizes are 0, all targets are 0. An empty table gives an empty table. Extra columns are ignored by
`mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, table, text_of, unused

#: The sources' weights, repeating in the order of their names; all sizes are shared 1.5 times, each source twice at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Weight at knots in time, linear in between, repeating like WEIGHTS; only the shape matters. Early, even and late use.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def n_words(docs: DataFrame) -> Column:
    return F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size): source, source_size, nth, target. One row for each source, so windows here see few rows.

    Sources fill at rates given by their weights until `share` of all sizes is dealt out. Those with the least
    most * size / weight stop first; when j have stopped, the others hold level * weight, where level is what is left
    over the weights left. The level of the first j at which the next source does not stop is the answer.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights)) + 1)
    named = totals.select("source", "source_size", nth.alias("nth"), weight.alias("weight"))
    named = named.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_stop = W.orderBy(F.col("limit") / F.col("weight"), "nth")
    before, rest = by_stop.rowsBetween(W.unboundedPreceding, -1), by_stop.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    tried = named.select("*", level.alias("level"))
    holds = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level"))
    # levels rise while sources stop and fall once sources are taken off that don't, so the first that holds is the highest
    first = F.max(holds).over(everything)
    return tried.select("source", "source_size", "nth", F.least("limit", F.coalesce(first, F.lit(0.0)) * F.col("weight")).alias("target"))


def inverse(demand: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches `demand`, a share (0 to 1) of the whole integral."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole = sum(areas)
    out, done = F.lit(knots[-1][0]), whole - areas[-1] if areas else 0.0
    for k in range(len(areas) - 1, -1, -1):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        need = demand * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        if slope:  # w0 x + slope x^2 / 2 = need
            step = (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * need)) - F.lit(w0)) / F.lit(slope)
        else:
            step = need / F.lit(w0)
        here = F.lit(t0) + step
        out = here if k == len(areas) - 1 else F.when(demand * F.lit(whole) < F.lit(done + areas[k]), here).otherwise(out)
        done -= areas[k - 1] if k else 0.0
    return F.least(F.lit(knots[-1][0]), F.greatest(F.lit(knots[0][0]), out))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    buckets: int | None = None,
) -> DataFrame:
    """One row for each document, in the order of position: doc_id, source, size, source_size, target, taken, position,
    again.

    taken: words that the mix takes; a source's sum is its target rounded to a whole number. position: training time
    (0 to 1) of the document's first copy, null if none is taken; again: that of the second. buckets: their number, if not
    by that of the rows.
    """
    if most > 2:
        raise ValueError("a document has two positions at most")
    own = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("|"), F.md5(text_of(docs)))
    rows = cut(docs.select(docs["doc_id"], docs["source"], n_words(docs).alias("size"), F.md5(own).alias("turn")))
    if buckets is None:
        buckets = 1 + math.isqrt(rows.count())
    place = F.conv(F.substring("turn", 1, 7), 16, 10).cast("long")  # 28 bits, in the order of turns
    rows = rows.withColumn("bucket", F.shiftright(place * F.lit(buckets), 28))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    named = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, most)
    until = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("*", F.coalesce(F.sum("part").over(until), F.lit(0)).alias("offset")).drop("part")
    parts = parts.withColumnsRenamed({"source": "p_source", "bucket": "p_bucket"})
    parts = parts.join(named, parts["p_source"].eqNullSafe(named["source"])).drop("source")
    inside = W.partitionBy("source", "bucket").orderBy("turn", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.select("*", (F.sum("size").over(inside) - F.col("size")).alias("start"))
    placed = placed.join(parts, placed["source"].eqNullSafe(parts["p_source"]) & (placed["bucket"] == parts["p_bucket"]))
    start, size = F.col("offset") + F.col("start"), F.col("size")
    goal = F.round("target").cast("long")
    clip = lambda x: F.greatest(F.lit(0), F.least(x, size))
    once, twice = clip(goal - start), clip(goal - F.col("source_size") - start)
    kind = F.col("nth") % len(schedules)

    def at(demand: Column) -> Column:
        out = inverse(demand, schedules[-1])
        for k in range(len(schedules) - 2, -1, -1):
            out = F.when(kind == k, inverse(demand, schedules[k])).otherwise(out)
        return out

    position = F.when(once > 0, at(start / F.col("target")))
    again = F.when(twice > 0, at((start + F.col("source_size")) / F.col("target")))
    out = placed.select(
        "doc_id", "source", "size", "source_size", "target", (once + twice).alias("taken"), position.alias("position"), again.alias("again"), once.alias("once"), twice.alias("twice")
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as the mix takes it, ordered by position.

    Texts stay whole: of a copy that the target cuts, the row comes if at least half of its words are taken. Documents
    without words are no burden on any target and come once, at the end.
    """
    plan = mix(docs, **options)
    whole = lambda x: (F.col(x) * 2 >= F.col("size")) & (F.col(x) > 0)
    at = F.filter(F.array(F.when(whole("once"), F.col("position")), F.when(whole("twice"), F.col("again"))), lambda x: x.isNotNull())
    at = F.when(F.col("size") == 0, F.array(F.lit(1.0))).otherwise(at)
    names = {n: unused(docs, f"_{n}") for n in ("id", "no_id", "source", "size", "at", "turn")}
    parts = lambda f, size: [F.coalesce(f["doc_id"], F.lit(0)).alias(names["id"]), f["doc_id"].isNull().alias(names["no_id"]), f["source"].alias(names["source"]), size.alias(names["size"])]
    keys = [names[n] for n in ("id", "no_id", "source", "size")]
    # rows that repeat all of these are cut alike: each gets the turns of one of them
    turns = plan.select(*parts(plan, F.col("size")), at.alias(names["at"])).groupBy(*keys).agg(F.max(names["at"]).alias(names["at"]))
    turns = turns.withColumnsRenamed({k: f"{k}_of_turn" for k in keys})
    marked = docs.select("*", *parts(docs, n_words(docs)))
    same = [marked[k].eqNullSafe(turns[f"{k}_of_turn"]) for k in keys]
    dealt = marked.join(turns, same).select(*(marked[c] for c in docs.columns), F.explode(names["at"]).alias(names["turn"]), marked[names["id"]])
    return dealt.orderBy(names["turn"], names["id"]).select(*docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position", "again")


OP5_SQL = r"""
with p as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as turn
  from documents
), s as (
  select *, [3.0::double, 1.0::double, 2.0::double][nth % 3 + 1] as weight from (
    select source, source_size, row_number() over (order by source nulls last) - 1 as nth
    from (select source, sum(size)::bigint as source_size from p group by source))
), l as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / weight, nth rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by 2.0::double * source_size / weight, nth rows between current row and unbounded following) as level
  from s
), t as (
  select source, source_size, nth, least(2.0::double * source_size,
           weight * coalesce(max(case when 2.0::double * source_size >= level * weight then level end) over (), 0)) as target
  from l
), r as (
  select p.doc_id, p.size, t.source_size, t.target, round(t.target)::bigint as goal, t.nth % 3 as kind,
         sum(p.size) over (partition by p.source order by p.turn, p.size rows unbounded preceding) - p.size as start
  from p join t on p.source is not distinct from t.source
), c as (
  select *, greatest(0, least(goal - start, size)) as once, greatest(0, least(goal - source_size - start, size)) as twice from r
), d as (  -- demand: the share of the source's target used before each copy
  select *, case when once > 0 then start::double / target end as demand, case when twice > 0 then (start + source_size)::double / target end as more from c
)
-- weights fall from 1.5 to 0.5, stay at 1, or rise from 0.5 to 1.5 over the training; the time at which their integral reaches the demand
select doc_id, size::bigint as size, source_size, target, (once + twice)::bigint as taken,
       case when demand is null then null else least(1.0::double, greatest(0.0::double, case kind
         when 0 then (sqrt(greatest(0.0::double, 2.25::double + -2.0::double * demand)) - 1.5::double) / -1.0::double
         when 1 then demand
         else sqrt(greatest(0.0::double, 0.25::double + 2.0::double * demand)) - 0.5::double end)) end as position,
       case when more is null then null else least(1.0::double, greatest(0.0::double, case kind
         when 0 then (sqrt(greatest(0.0::double, 2.25::double + -2.0::double * more)) - 1.5::double) / -1.0::double
         when 1 then more
         else sqrt(greatest(0.0::double, 0.25::double + 2.0::double * more)) - 0.5::double end)) end as again
from d
"""
