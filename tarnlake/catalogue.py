"""Queries of the engine over the test data, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cluster import Shards, distributed_count, distributed_join, distributed_query
from .operators import exchange
from .plans.logical import Join, Projection, Scan
from .plans.syntax import BinaryExpression, Identifier, Literal, Query, SelectItem, TableRef
from .session import EngineSession
from .sources import files

#: name: (query in the dialect, SQL for DuckDB if it differs)
TEXTS: dict[str, tuple[str, str | None]] = {
    "scan_table": ("select * from nation", None),
    "project_columns": ("select o_orderkey, o_totalprice from orders", None),
    "project_literal": ("select o_orderkey, 1 from orders", "select o_orderkey, 1 as literal from orders"),
    "filter_eq_string": ("select o_orderkey from orders where o_orderstatus = 'F'", None),
    "filter_lt": ("select l_orderkey, l_linenumber from lineitem where l_quantity < 5", None),
    "filter_gt": ("select l_orderkey, l_linenumber from lineitem where l_quantity > 45", None),
    "filter_le": ("select p_partkey from part where p_size <= 10", None),
    "filter_ge": ("select p_partkey from part where p_size >= 40", None),
    "filter_and_or": ("select l_orderkey from lineitem where l_quantity >= 45 and l_returnflag = 'R' or l_linenumber = 1", None),
    "filter_const_fold": ("select n_name from nation where 1 = 1 and 2 = 2", None),
    "filter_const_false": ("select n_name from nation where 1 = 2", None),
    "join_broadcast": ("select c_name, n_name from customer join nation on c_nationkey = n_nationkey", None),
    "join_sort_merge": ("select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey", None),
    "join_theta": ("select s_suppkey, n_nationkey from supplier join nation on s_suppkey < n_nationkey", None),
    "join_compound": ("select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey and s_acctbal > c_acctbal", None),
    "join_literal_cond": ("select n_name, r_name from nation join region on r_regionkey = 1", None),
    "join_multiway": ("select c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", None),
    "join_filter_sort": ("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice >= 200000 order by o_orderkey", None),
    "agg_count_star": ("select o_orderstatus, count(*) from orders group by o_orderstatus", "select o_orderstatus, count(*) as count from orders group by o_orderstatus"),
    "agg_count_col": ("select o_orderstatus, count(o_totalprice) from orders group by o_orderstatus", "select o_orderstatus, count(*) as count from orders group by o_orderstatus"),
    "agg_sum_int": ("select l_returnflag, sum(l_linenumber) from lineitem group by l_returnflag", "select l_returnflag, cast(sum(l_linenumber) as bigint) as sum from lineitem group by l_returnflag"),
    "agg_sum_double": (
        "select l_returnflag, sum(l_quantity) from lineitem group by l_returnflag",
        "select l_returnflag, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum from lineitem group by l_returnflag",
    ),
    "agg_min": ("select o_orderpriority, min(o_totalprice) from orders group by o_orderpriority", "select o_orderpriority, min(o_totalprice) as min from orders group by o_orderpriority"),
    "agg_max": ("select o_orderpriority, max(o_orderdate) from orders group by o_orderpriority", "select o_orderpriority, max(o_orderdate) as max from orders group by o_orderpriority"),
    "agg_multi_key": (
        "select l_returnflag, l_linestatus, count(*) from lineitem group by l_returnflag, l_linestatus",
        "select l_returnflag, l_linestatus, count(*) as count from lineitem group by l_returnflag, l_linestatus",
    ),
    "agg_key_not_selected": ("select count(*) from orders group by o_orderstatus", "select o_orderstatus, count(*) as count from orders group by o_orderstatus"),
    "agg_global": ("select count(*), min(o_totalprice), max(o_totalprice) from orders", "select count(*) as count, min(o_totalprice) as min, max(o_totalprice) as max from orders"),
    "agg_global_empty": ("select count(*) from orders where 1 = 2", "select count(*) as count from orders where 1 = 2 having count(*) > 0"),
    "agg_no_function": ("select p_brand from part group by p_brand", None),
    "agg_filter": (
        "select o_orderstatus, count(*) from orders where o_totalprice >= 100000 group by o_orderstatus",
        "select o_orderstatus, count(*) as count from orders where o_totalprice >= 100000 group by o_orderstatus",
    ),
    "agg_over_join": (
        "select n_name, count(*) from customer join nation on c_nationkey = n_nationkey group by n_name order by n_name",
        "select n_name, count(*) as count from customer join nation on c_nationkey = n_nationkey group by n_name order by n_name",
    ),
    "sort_asc": ("select p_partkey, p_size from part order by p_size, p_partkey", None),
    "sort_desc": ("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey asc", None),
    "cte_single": ("with big as (select o_orderkey, o_custkey from orders where o_totalprice >= 200000) select o_orderkey from big", None),
    "cte_chain": (
        "with a as (select c_custkey, c_nationkey from customer where c_acctbal > 0), b as (select c_nationkey, count(*) from a group by c_nationkey) select n_name, count from b join nation on c_nationkey = n_nationkey",
        "with a as (select c_custkey, c_nationkey from customer where c_acctbal > 0), b as (select c_nationkey, count(*) as count from a group by c_nationkey) select n_name, count from b join nation on c_nationkey = n_nationkey",
    ),
    "cte_nested": ("with x as (with y as (select p_partkey, p_size from part where p_size > 20) select p_partkey from y) select p_partkey from x", None),
    "cte_shadow": ("with nation as (select n_name, n_regionkey from nation where n_regionkey = 1) select n_name from nation", None),
    "events_count": (
        "select event_type, count(*) from events where value >= 100 group by event_type order by event_type",
        "select event_type, count(*) as count from events where value >= 100 group by event_type order by event_type",
    ),
}
#: Queries whose join strategy comes from statistics.
ANALYZED = {"join_broadcast": ("customer", "nation"), "join_sort_merge": ("orders", "lineitem")}


def session(spark: SparkSession, sf_dir: str) -> EngineSession:
    """A session whose tables are read on first use."""
    out = EngineSession(spark)
    out.tables = _Folder(spark, sf_dir)
    return out


class _Folder(dict):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name: object) -> bool:
        return name in files.NAMES

    def __missing__(self, name: str) -> DataFrame:
        self[name] = files.parquet(self.spark, self.sf_dir, name)
        return self[name]

    def __iter__(self):
        return iter(files.NAMES)


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir).analyze(*ANALYZED.get(name, ())).sql(TEXTS[name][0])

    return run


def filter_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialect has no sign for it; the syntax tree has."""
    differs = BinaryExpression(Identifier("o_orderstatus"), "!=", Literal("F"))
    return session(spark, sf_dir).sql(Query((SelectItem(Identifier("o_orderkey")),), TableRef("orders"), where=differs))


def join_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy that the plan itself demands."""
    keys = BinaryExpression(Identifier("o_custkey"), "=", Identifier("c_custkey"))
    joined = Join(Scan("orders"), Scan("customer"), keys, "hash", forced=True)
    return session(spark, sf_dir).execute(Projection(joined, tuple(SelectItem(Identifier(n)) for n in ("o_orderkey", "c_name"))))


def dist_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole query with join, filter and columns, in a fixed order."""
    return distributed_query(session(spark, sf_dir), "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal >= 5000")


def agg_bare_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are no keys, without a column that orders rows."""
    return session(spark, sf_dir).sql("select p_brand, p_size, p_retailprice, count(*) from part group by p_brand")


def agg_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("select o_custkey, o_totalprice, count(*) from orders group by o_custkey", first_by="o_orderkey")


def dist_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributed_count(files.parquet(spark, sf_dir, "orders"), "o_orderstatus")


def dist_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = (files.parquet(spark, sf_dir, t) for t in ("customer", "nation"))
    return distributed_join(customer, nation, "c_nationkey", "n_nationkey").select("c_name", "n_name")


def shuffle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.materialize(exchange.partition(files.parquet(spark, sf_dir, "customer"), "c_nationkey", 8))


def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{exchange.shared_folder(spark)}/partitions-{uuid.uuid4().hex}"
    exchange.checkpoint(exchange.partition(files.parquet(spark, sf_dir, "customer"), "c_nationkey", 8), path)
    return exchange.materialize(exchange.restore(spark, path))


def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = (files.parquet(spark, sf_dir, t) for t in ("customer", "nation"))
    shards = Shards(EngineSession(spark), replicated=["nation"])
    for k in range(2):
        shards.register(f"worker-{k}", {"customer": customer.filter(customer["c_custkey"] % 2 == k), "nation": nation})
    return shards.query("select n_name, count(*) from customer join nation on c_nationkey = n_nationkey group by n_name order by n_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _text(name) for name in TEXTS} | {
    "filter_ne": filter_ne,
    "join_hash": join_hash,
    "agg_first_value": agg_first_value,
    "agg_bare_column": agg_bare_column,
    "dist_query": dist_query,
    "dist_count": dist_count,
    "dist_join": dist_join,
    "shuffle_roundtrip": shuffle_roundtrip,
    "checkpoint_roundtrip": checkpoint_roundtrip,
    "shard_union": shard_union,
}

SQL: dict[str, str] = {name: oracle or text for name, (text, oracle) in TEXTS.items()} | {
    "filter_ne": "select o_orderkey from orders where o_orderstatus <> 'F'",
    "join_hash": "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey",
    "agg_bare_column": "select p_brand, least.a as p_size, least.b as p_retailprice, count from (select p_brand, min({'a': p_size, 'b': p_retailprice}) as least, count(*) as count from part group by p_brand)",
    "dist_query": "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal >= 5000 order by c_custkey, n_name",
    "agg_first_value": "select o_custkey, min_by(o_totalprice, o_orderkey) as o_totalprice, count(*) as count from orders group by o_custkey",
    "dist_count": "select o_orderstatus, count(*) as count from orders group by o_orderstatus",
    "dist_join": "select c_name, n_name from customer join nation on c_nationkey = n_nationkey",
    "shuffle_roundtrip": "select * from customer",
    "checkpoint_roundtrip": "select * from customer",
    "shard_union": "select n_name, count(*) as count from customer join nation on c_nationkey = n_nationkey group by n_name order by n_name",
}
