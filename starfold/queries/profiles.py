"""Profile numbers of the data set."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.operators import base_rate, coverage, distinct_ids
from starfold.queries.registry import query
from starfold.sources import table


@query(
    "base_rate_profile",
    """select count(*) as rows, count(*) filter (where quality = 1) as positives,
              (count(*) filter (where quality = 1))::double / count(*) as positive_rate from labels""",
)
def base_rate_profile(spark, sf):
    return base_rate(table(spark, sf, "labels"), "quality")


@query(
    "coverage",
    """with a as (select count(distinct user_id) as child_ids from events),
            b as (select count(distinct c_custkey) as ids from customer)
       select child_ids, ids, child_ids::double / ids as coverage from a, b""",
)
def child_coverage(spark, sf):
    return coverage(table(spark, sf, "events"), "user_id", table(spark, sf, "customer"), "c_custkey")


@query(
    "distinct_ids",
    """select count(*) as ids from (select user_id as EID from events union
       select o_custkey from orders)""",
)
def all_ids(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("EID"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("EID"))
    return distinct_ids([events, orders], "EID")


@query(
    "distinct_values",
    "select count(distinct o_orderpriority) as kinds, count(distinct o_custkey) as ids from orders",
)
def distinct_values(spark, sf):
    return table(spark, sf, "orders").agg(
        F.count_distinct("o_orderpriority").alias("kinds"),
        F.count_distinct("o_custkey").alias("ids"),
    )
