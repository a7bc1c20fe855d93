"""Scans, projections, filters, null fills and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import (
    fill_truncated_mean,
    fill_truncated_min,
    log_scale,
    matching,
    scale_by_max,
)
from starfold.plans import bindings
from starfold.queries.registry import query, rounded
from starfold.sources import reject_count, table

CAPITAL_SQL = "case when c_nationkey <> 7 then c_acctbal end"


def _capital(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("EID"),
        F.when(F.col("c_nationkey") != 7, F.col("c_acctbal")).alias("ZCZB"),
    )


@query(
    "scan_project_rename",
    "select c_custkey as EID, c_acctbal as ZCZB, c_mktsegment as ETYPE from customer",
)
def scan_project_rename(spark, sf):
    c = table(spark, sf, "customer").drop("c_name", "c_nationkey")
    names = {"c_custkey": "EID", "c_acctbal": "ZCZB", "c_mktsegment": "ETYPE"}
    return c.withColumnsRenamed(names)


@query(
    "filter_threshold",
    f"""select EID, ZCZB from (select c_custkey as EID, {CAPITAL_SQL} as ZCZB from customer)
        where ZCZB < 5000""",
)
def filter_threshold(spark, sf):
    return _capital(spark, sf).where(F.col("ZCZB") < 5000)


@query("filter_label", "select doc_id as EID, quality as TARGET from labels where quality = 1")
def filter_label(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.where(F.col("quality") == 1).select(
        F.col("doc_id").alias("EID"), F.col("quality").alias("TARGET")
    )


@query(
    "filter_not_null",
    """select event_id, user_id as EID, FBDATE from
       (select event_id, user_id, nullif(event_type, 'error') as FBDATE from events)
       where FBDATE is not null""",
)
def filter_not_null(spark, sf):
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    events = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("EID"), kind.alias("FBDATE")
    )
    return events.where(F.col("FBDATE").isNotNull())


@query(
    "filter_semi",
    """select o_orderkey, o_custkey as EID, o_totalprice from orders
       where o_custkey in (select user_id from events)""",
)
def filter_semi(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("EID"), "o_totalprice"
    )
    users = table(spark, sf, "events").select(F.col("user_id").alias("EID"))
    return matching(orders, users, "EID")


@query(
    "diff_and_indicator",
    """select l_orderkey, l_linenumber, l_extendedprice - l_quantity as amount_gap,
              cast(l_discount > 0.05 as int) as discounted,
              cast(l_returnflag <> 'N' as int) as flagged,
              cast(trunc(l_quantity) as int) as quantity
       from lineitem""",
)
def diff_and_indicator(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") - F.col("l_quantity")).alias("amount_gap"),
        fn.flag(F.col("l_discount") > 0.05).alias("discounted"),
        fn.flag(F.col("l_returnflag") != "N").alias("flagged"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


@query(
    "fill_constant",
    """select event_id, coalesce(case when event_type <> 'view' then value end, 0) as LAWAMOUNT,
              coalesce(case when event_type <> 'click' then user_id end, -1) as user_id
       from events""",
)
def fill_constant(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "view", F.col("value")).alias("LAWAMOUNT"),
        F.when(F.col("event_type") != "click", F.col("user_id")).alias("user_id"),
    )
    return fn.fill_numeric(
        events.withColumn("LAWAMOUNT", fn.fill_constant("LAWAMOUNT", 0.0)), -1, skip=["event_id"]
    )


@query(
    "fill_from_column",
    """select o_orderkey, year(o_orderdate)::int as BTYEAR,
              coalesce(case when o_orderpriority = '1-URGENT' then year(o_orderdate) + 1 end,
                       year(o_orderdate))::int as BTENDYEAR
       from orders""",
)
def fill_from_column(spark, sf):
    year = F.year("o_orderdate")
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        year.alias("BTYEAR"),
        F.when(F.col("o_orderpriority") == "1-URGENT", year + 1).alias("BTENDYEAR"),
    )
    return orders.withColumn("BTENDYEAR", fn.fill_from("BTENDYEAR", "BTYEAR"))


@query(
    "fill_trunc_mean",
    f"""with c as (select c_custkey as EID, {CAPITAL_SQL} as ZCZB from customer),
        m as (select trunc(avg(ZCZB)) as v from c)
        select EID, coalesce(ZCZB, (select v from m)) as ZCZB from c""",
)
def fill_trunc_mean(spark, sf):
    return fill_truncated_mean(_capital(spark, sf), "ZCZB")


@query(
    "fill_trunc_min",
    f"""with c as (select c_custkey as EID, {CAPITAL_SQL} as ZCZB from customer)
        select EID, coalesce(ZCZB, (select trunc(min(ZCZB)) from c)) as ZCZB from c""",
)
def fill_trunc_min(spark, sf):
    return fill_truncated_min(_capital(spark, sf), "ZCZB")


@query(
    "replace_value",
    """select l_orderkey, l_linenumber, case when l_tax = 0 then -1 else l_tax end as l_tax
       from lineitem""",
)
def replace_value(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", fn.replace_value("l_tax", 0.0, -1.0).alias("l_tax")
    )


AMOUNT_TEXT_SQL = """case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2))::varchar || '万元'
  when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2))::varchar
  when o_orderpriority = '2-HIGH' then 'unknown' end"""


@query(
    "parse_unit_amount",
    f"""select row_id, try_cast(regexp_replace(ALTBE, '万元$', '') as double) as amount
        from (select o_orderkey as row_id, {AMOUNT_TEXT_SQL} as ALTBE from orders)""",
)
def parse_unit_amount(spark, sf):
    alter = bindings.alter(table(spark, sf, "orders"))
    return alter.select("row_id", fn.parse_amount("ALTBE").alias("amount"))


@query(
    "parse_rejects",
    f"""select count(*) filter (where ALTBE is not null
               and try_cast(regexp_replace(ALTBE, '万元$', '') as double) is null) as rejects
        from (select {AMOUNT_TEXT_SQL} as ALTBE from orders)""",
)
def parse_rejects(spark, sf):
    alter = bindings.alter(table(spark, sf, "orders"))
    return reject_count(alter, "ALTBE", fn.parse_amount("ALTBE"))


@query(
    "scale_by_max",
    """select c_custkey as EID, c_acctbal / (select max(c_acctbal) from customer) as scaled
       from customer""",
)
def scale_max(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("EID"), "c_acctbal")
    return scale_by_max(customer, "c_acctbal", "scaled").drop("c_acctbal")


@query(
    "log1p_scale",
    f"""with c as (select c_custkey as EID, {CAPITAL_SQL} as x from customer),
        l as (select EID, case when x > -1 then ln(1 + x) end as v from c)
        select EID, round(v, 6) as logged,
               round(coalesce(v, (select trunc(avg(v)) from l)) / (select max(v) from l), 6) as ZCZB
        from l""",
)
def log1p_scale(spark, sf):
    return rounded(log_scale(_capital(spark, sf), "ZCZB", fill="mean", log_out="logged"))


@query(
    "log_bin",
    "select o_orderkey, cast(trunc(ln(1 + o_totalprice)) as int) as price_bin from orders",
)
def log_bin(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.log_bin("o_totalprice").alias("price_bin"))


@query(
    "date_parts_split",
    """with o as (select o_orderkey as row_id, strftime(o_orderdate, '%Y-%m-%d') as a,
                         strftime(o_orderdate, '%Y/%m') as b, strftime(o_orderdate, '%Y') as c from orders)
       select row_id, split_part(a, '-', 1)::int as y, split_part(a, '-', 2)::int as m,
              split_part(b, '/', 1)::int as slash_y,
              try_cast(split_part(c, '-', 2) as int) as absent
       from o""",
)
def date_parts_split(spark, sf):
    day = F.col("o_orderdate").cast("date").cast("string")
    dates = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        day.alias("a"),
        F.translate(F.substring(day, 1, 7), "-", "/").alias("b"),
        F.substring(day, 1, 4).alias("c"),
    )
    return dates.select(
        "row_id",
        fn.date_piece("a", 1).alias("y"),
        fn.date_piece("a", 2).alias("m"),
        fn.date_piece("b", 1, "/").alias("slash_y"),
        fn.date_piece("c", 2).alias("absent"),
    )


@query(
    "round_threshold_string",
    """with s as (select event_id, round_even(value / 700000, 8) as p from events)
       select event_id, p, cast(p > 0.000222 as int) as FORTARGET, cast(p as varchar) as PROB from s""",
)
def round_threshold_string(spark, sf):
    score = F.col("value") / 700000
    events = table(spark, sf, "events").select("event_id", fn.round_half_even(score).alias("p"))
    return events.select(
        "event_id",
        "p",
        fn.decision("p", 0.000222).alias("FORTARGET"),
        fn.probability_text("p").alias("PROB"),
    )


@query(
    "safe_ratio",
    """select event_id, user_id / nullif(value, 0) as share, value / 10000 as small from events""",
)
def safe_ratio(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        fn.ratio("user_id", "value").alias("share"),
        fn.scaled_down("value", 10000).alias("small"),
    )
