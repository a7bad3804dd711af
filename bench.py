"""Times of the engine's headline queries: the query catalogue over the test data, and seven queries over a generated
table of people and cities. Prints one line of JSON."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import catalogue
from tarnlake.cluster import distributed_query
from tarnlake.session import EngineSession, LocalScheduler
from tarnlake.sources.report import write_modes, write_report

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SAMPLES = int(os.environ.get("BENCH_SAMPLES", "3"))
PEOPLE = int(os.environ.get("BENCH_PEOPLE", "500000"))

#: The baseline's queries.
GENERATED = {
    "filter_projection": "select name from people where age >= 12",
    "wide_projection": "select id, name, age, city, score from people where age >= 20 and score >= 5000 order by score",
    "join": "select name, city_name from people join cities on city_id = id order by name",
    "join_filter": "select name, city_name from people join cities on city_id = id where age >= 25 and score >= 5000 order by name",
    "aggregate": "select city, count(*) from people group by city order by city",
    "aggregate_filter": "select city, count(*) from people where score >= 2500 group by city order by city",
    "star_projection": "select * from people where age >= 30 order by score",
}
#: Their result rows at 500,000 people.
ROWS = {"filter_projection": 480_000, "wide_projection": 200_000, "join": 500_000, "join_filter": 175_000, "aggregate": 2, "aggregate_filter": 2, "star_projection": 300_000}


def people(spark: SparkSession, n: int) -> DataFrame:
    i, even = F.col("i"), F.col("i") % 2 == 0
    return spark.range(n).withColumnRenamed("id", "i").select(
        (i + 1).alias("id"),
        F.concat(F.lit("name-"), i).alias("name"),
        (10 + i % 50).alias("age"),
        F.when(even, 100).otherwise(200).cast("long").alias("city_id"),
        F.when(even, "seattle").otherwise("vancouver").alias("city"),
        (17 * i % 10_000).alias("score"),
        F.concat(F.lit("segment-"), i % 8).alias("segment"),
    )


def seconds(make) -> float:
    """Median time of a query, made anew and computed in full each time, after one run to warm up."""
    took = []
    for _ in range(SAMPLES + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return round(median(took[1:]), 4)


def modes(session: EngineSession) -> dict[str, dict[str, float]]:
    """The generated queries in four ways: to rows in the driver, in one task at a time, in parallel, and in a fixed order."""
    one = EngineSession(session.spark, scheduler=LocalScheduler(1))
    one.tables = session.tables

    def rows(sql: str) -> float:
        began = time.perf_counter()
        session.rows(sql)
        return time.perf_counter() - began

    return {
        name: {
            "rows": round(median(rows(sql) for _ in range(SAMPLES)), 4),
            "sequential": seconds(lambda sql=sql: one.sql(sql)),
            "parallel": seconds(lambda sql=sql: session.sql(sql)),
            "distributed": seconds(lambda sql=sql: distributed_query(session, sql)),
        }
        for name, sql in GENERATED.items()
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    session = EngineSession(spark)
    # the generated table lies in memory, as the baseline's does
    session.register("people", people(spark, PEOPLE).cache()).count()
    session.register("cities", [{"id": 100, "city_name": "seattle"}, {"id": 200, "city_name": "vancouver"}])
    for name, sql in GENERATED.items():
        if PEOPLE == 500_000:
            assert session.sql(sql).count() == ROWS[name], name
        times[f"people_{name}"] = seconds(lambda sql=sql: session.sql(sql))
    if out := os.environ.get("BENCH_OUT"):
        write_modes(modes(session), out, f"Modes, {PEOPLE} people, {CPUS} cores")
    for name, query in catalogue.QUERIES.items():
        times[name] = seconds(lambda query=query: query(spark, SF_DIR))
    spark.stop()
    if out:
        write_report(times, out, f"{len(times)} queries, {CPUS} cores, {os.path.basename(SF_DIR)}")
    print(json.dumps({"metric": "total seconds of all queries, median of samples", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
