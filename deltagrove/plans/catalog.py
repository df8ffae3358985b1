"""The named queries of the library over the shared tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The event log of the fixtures, in SQL: user keys, event numbers as sequence, errors as deletions.
LOG_SQL = """log as (select printf('user:%06d', user_id) as k, event_id + 1 as seq,
  case when event_type = 'error' then 1 else 0 end as op, case when event_type <> 'error' then props end as v from events),
top as (select * from (select *, row_number() over (partition by k order by seq desc, op desc) as n from log) where n = 1),
live as (select k, seq, v from top where op = 0)"""
FILES_SQL = LOG_SQL + """,
files as (select (seq - 1) // 1000 + 1 as file_num, sum(17 + length(k) + coalesce(length(v), 0))::bigint as size, min(k) as min_key,
  max(k) as max_key, min(seq) as min_seq, max(seq) as max_seq, count(*) as num_keys from log group by 1)"""


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select(F.format_string("user:%06d", "user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), gone.cast("tinyint").alias("op"), F.when(~gone, F.col("props")).alias("value"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.format_string("order:%010d", "o_orderkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(0).cast("tinyint").alias("op"), F.col("o_orderpriority").alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scan(event_log(spark, sf_dir), prefix="user:0000").select("key", "seq", "value").orderBy("key")


def queries() -> dict[str, Query]:
    from . import admin_queries, command_queries, file_queries, log_queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
