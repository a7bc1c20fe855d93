"""Joins, unions and the small star."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import (
    FeatureBlock,
    align,
    anti,
    assemble,
    attach_spread,
    log_scale,
    one_hot,
    stack_rows,
    unique_rows,
)
from starfold.queries.registry import query, rounded
from starfold.sources import bucketed, store_bucketed, table

STATUSES = ("F", "O", "P")


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("EID"), "c_acctbal")


def _event_counts(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "EID")
    features = {"n": fn.row_count(), "amount": fn.total_of("value")}
    return rounded(FeatureBlock("events", events, features).build())


EVENT_COUNTS_SQL = """(select user_id as EID, count(*) as n,
  round(sum(value), 6) as amount from events group by 1)"""


@query(
    "inner_join",
    f"""select c_custkey as EID, c_acctbal, n, amount from customer
        join {EVENT_COUNTS_SQL} e on c_custkey = e.EID""",
)
def inner_join(spark, sf):
    return _customers(spark, sf).join(_event_counts(spark, sf), "EID", "inner")


@query(
    "left_join_fill",
    f"""select c_custkey as EID, c_acctbal, coalesce(n, -999) as n, coalesce(amount, -999) as amount
        from customer left join {EVENT_COUNTS_SQL} e on c_custkey = e.EID""",
)
def left_join_fill(spark, sf):
    return assemble(_customers(spark, sf), [_event_counts(spark, sf)], fill=-999)


@query(
    "anti_join",
    """select c_custkey as EID, c_acctbal from customer
       where not exists (select 1 from events where user_id = c_custkey)""",
)
def anti_join(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("EID"))
    return anti(_customers(spark, sf), events, "EID")


@query(
    "full_align",
    f"""select EID, n, amount, orders, n / nullif(orders, 0) as per_order from {EVENT_COUNTS_SQL}
        full join (select o_custkey as EID, count(*) as orders from orders group by 1) using (EID)""",
)
def full_align(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "EID")
    counts = FeatureBlock("orders", orders, {"orders": fn.row_count()}).build()
    both = align(_event_counts(spark, sf), counts, "EID")
    return both.withColumn("per_order", fn.ratio("n", "orders"))


@query("unique_rows", "select c_custkey as EID, c_acctbal from customer")
def unique_entities(spark, sf):
    return unique_rows(_customers(spark, sf), "EID")


@query(
    "union_all_split",
    """select doc_id as EID, quality as TARGET, 1 as labelled from labels
       union all
       select d.doc_id, null, 0 from documents d
       where not exists (select 1 from labels l where l.doc_id = d.doc_id)""",
)
def union_all_split(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("EID"), F.col("quality").alias("TARGET"), F.lit(1).alias("labelled")
    )
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("EID"))
    return stack_rows(labels, anti(documents, labels, "EID").withColumn("labelled", F.lit(0)))


def _dummy_counts(column, prefix, values):
    return ", ".join(
        f"count(*) filter (where {column} = '{v}') as \"{prefix}_{v}\"" for v in values
    )


STAR_SQL = f"""
with o as (
  select o_custkey as EID, count(*) as order_n,
         round(sum(o_totalprice), 6) as order_sum, round(avg(o_totalprice), 6) as order_mean,
         round(avg((o_orderstatus = 'F')::int), 6) as order_done_rate,
         min(year(o_orderdate))::int as order_first_year, max(year(o_orderdate))::int as order_last_year,
         arg_max(o_totalprice, row(year(o_orderdate), month(o_orderdate), o_orderkey)) as order_last_price,
         {_dummy_counts('o_orderstatus', 'STATUS', STATUSES)}
  from orders group by 1),
l as (
  select o_custkey as EID, count(*) as line_n, round(sum(l_extendedprice), 6) as line_sum,
         round((count(*) filter (where l_returnflag = 'R'))::double / count(*), 6) as line_return_rate,
         max(l_quantity) as line_top_quantity
  from lineitem join orders on l_orderkey = o_orderkey group by 1),
e as (
  select user_id as EID, count(*) as event_n, round(sum(value), 6) as event_sum,
         max(value) as event_top
  from events group by 1)
select c_custkey as EID,
       round(case when c_acctbal > -1 then ln(1 + c_acctbal) end
             / (select max(ln(1 + c_acctbal)) from customer where c_acctbal > -1), 6) as capital,
       (c_mktsegment = 'BUILDING')::int as ETYPE_BUILDING,
       (c_mktsegment = 'MACHINERY')::int as ETYPE_MACHINERY,
       o.* exclude (EID), l.* exclude (EID), e.* exclude (EID)
from customer left join o on c_custkey = o.EID left join l on c_custkey = l.EID
     left join e on c_custkey = e.EID"""

_STAR_FILLED = ("capital", "event_n", "event_sum", "event_top", "order_n", "order_sum", "order_mean",
                "order_done_rate", "order_first_year", "order_last_year", "order_last_price",
                "STATUS_F", "STATUS_O", "STATUS_P", "line_n", "line_sum", "line_return_rate",
                "line_top_quantity")


STAR_SHOWN_SQL = f"""select EID, ETYPE_BUILDING, ETYPE_MACHINERY,
        {', '.join(f'coalesce({c}, -999) as {c}' for c in _STAR_FILLED)} from ({STAR_SQL})"""


def _star_spine(customer):
    companies = customer.select(
        F.col("c_custkey").alias("EID"), F.col("c_acctbal").alias("capital"), "c_mktsegment"
    )
    scaled = log_scale(companies, "capital")
    return one_hot(scaled, "c_mktsegment", values=["BUILDING", "MACHINERY"], prefix="ETYPE")


def _order_block(orders):
    dated = orders.withColumnsRenamed({"o_custkey": "EID"}).withColumns(
        {"y": F.year("o_orderdate"), "m": F.month("o_orderdate")}
    )
    return FeatureBlock(
        "orders",
        dated,
        {
            "order_n": fn.row_count(),
            "order_sum": fn.total_of("o_totalprice"),
            "order_mean": fn.mean_of("o_totalprice"),
            "order_done_rate": fn.flag_rate(fn.flag(F.col("o_orderstatus") == "F")),
            "order_first_year": fn.earliest("y"),
            "order_last_year": fn.latest("y"),
            "order_last_price": fn.carry_latest(
                "o_totalprice", fn.order_key("y", "m", "o_orderkey")
            ),
        }
        | fn.category_counts("o_orderstatus", STATUSES, "STATUS"),
    )


def _event_block(events):
    return FeatureBlock(
        "events",
        events.withColumnRenamed("user_id", "EID"),
        {
            "event_n": fn.row_count(),
            "event_sum": fn.total_of("value"),
            "event_top": fn.biggest("value"),
        },
    )


@query("star_assembly", STAR_SHOWN_SQL)
def star_assembly(spark, sf):
    """Customers with one block each from orders, order lines and events: the flagship."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    lineitem, events = table(spark, sf, "lineitem"), table(spark, sf, "events")

    # Order lines are added up per order before the join, so an order with very many lines, or a
    # customer with very many orders, leaves each map task as one row.
    per_order = FeatureBlock(
        "lines of an order",
        lineitem.withColumnRenamed("l_orderkey", "o_orderkey"),
        {
            "lines": fn.row_count(),
            "returned": F.count_if(F.col("l_returnflag") == "R"),
            "price": F.sum("l_extendedprice"),
            "top": fn.biggest("l_quantity"),
        },
        key="o_orderkey",
    ).build()
    owners = orders.select("o_orderkey", F.col("o_custkey").alias("EID"))
    line_block = FeatureBlock(
        "lineitem",
        per_order.join(owners, "o_orderkey"),
        {
            "line_n": F.sum("lines"),
            "line_sum": F.sum("price").cast("double"),
            "line_return_rate": fn.ratio(F.sum("returned"), F.sum("lines")),
            "line_top_quantity": fn.biggest("top"),
        },
    )
    blocks = [b.build() for b in (_order_block(orders), line_block, _event_block(events))]
    return rounded(assemble(_star_spine(customer), blocks, fill=-999))


BUCKETS = 8


@query("star_bucketed", STAR_SHOWN_SQL)
def star_bucketed(spark, sf):
    """The same star from tables stored in buckets of the company: no child row is shuffled again."""
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_extendedprice", "l_quantity"
    )
    owned = lines.join(orders.select("o_orderkey", F.col("o_custkey").alias("EID")), "o_orderkey")
    stored = {
        "customer": (table(spark, sf, "customer"), "c_custkey"),
        "orders": (orders, "o_custkey"),
        "lines": (owned, "EID"),
        "events": (table(spark, sf, "events").select("user_id", "value"), "user_id"),
    }
    kept = {name: bucketed(spark, store_bucketed(rows, key, BUCKETS)) for name, (rows, key) in stored.items()}
    line_block = FeatureBlock(
        "lines",
        kept["lines"],
        {
            "line_n": fn.row_count(),
            "line_sum": fn.total_of("l_extendedprice"),
            "line_return_rate": fn.share_where(F.col("l_returnflag") == "R"),
            "line_top_quantity": fn.biggest("l_quantity"),
        },
    )
    blocks = [b.build() for b in (_order_block(kept["orders"]), line_block, _event_block(kept["events"]))]
    return rounded(assemble(_star_spine(kept["customer"]), blocks, fill=-999))


@query(
    "hot_lookup",
    """with l as (select l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then 1 else l_partkey end as part,
                         l_quantity from lineitem)
       select l_orderkey, l_linenumber, part, l_quantity, p_name, p_retailprice
       from l left join part on part = p_partkey""",
)
def hot_lookup(spark, sf):
    """Order lines with their part, half of them with the same one; the parts are not broadcast."""
    part = F.when(F.col("l_orderkey") % 2 == 0, F.lit(1).cast("long")).otherwise(F.col("l_partkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", part.alias("part"), "l_quantity")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_retailprice")
    return attach_spread(lines, parts, "part")
