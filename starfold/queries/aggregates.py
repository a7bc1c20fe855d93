"""Per-entity aggregates and keep-first operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import FeatureBlock, align
from starfold.queries.registry import query, rounded
from starfold.sources import table


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumnRenamed("o_custkey", "EID")


def _events(spark, sf):
    return table(spark, sf, "events").withColumnRenamed("user_id", "EID")


def _dated(spark, sf):
    """Orders with year and month cut out of a date string."""
    day = F.col("o_orderdate").cast("date").cast("string")
    return _orders(spark, sf).withColumns(
        {"y": fn.date_piece(day, 1), "m": fn.date_piece(day, 2)}
    )


DATED_SQL = """(select *, o_custkey as EID, split_part(strftime(o_orderdate, '%Y-%m-%d'), '-', 1)::int as y,
  split_part(strftime(o_orderdate, '%Y-%m-%d'), '-', 2)::int as m from orders)"""


@query(
    "group_sum_count",
    """select EID, round(coalesce(sum(v), 0), 6) as total, count(v) as n
       from (select user_id as EID, case when event_type = 'purchase' then value end as v from events)
       group by 1""",
)
def group_sum_count(spark, sf):
    events = _events(spark, sf).withColumn(
        "v", F.when(F.col("event_type") == "purchase", F.col("value"))
    )
    return rounded(FeatureBlock("e", events, {"total": fn.total_of("v"), "n": fn.present("v")}).build())


@query(
    "sum_many_decimals",
    """select user_id as EID, round(sum(value / 7), 6) as total, round(avg(value / 7), 6) as average,
              round(sum(value / 7 * 1e9) / 1e9, 6) as large
       from events group by 1""",
)
def sum_many_decimals(spark, sf):
    """Sums of a column with more digits than any scale keeps, small and large."""
    events = _events(spark, sf).withColumn("v", F.col("value") / 7)
    features = {
        "total": fn.total_of("v"),
        "average": fn.mean_of("v"),
        "large": fn.total_of(F.col("v") * 1e9) / 1e9,
    }
    return rounded(FeatureBlock("e", events, features).build())


@query(
    "group_rate",
    """select EID, round(avg(home), 6) as home_rate, round(avg(price), 6) as price_mean
       from (select o_custkey as EID,
                    case when o_orderpriority <> '5-LOW' then (o_orderstatus = 'F')::int end as home,
                    case when o_orderstatus <> 'P' then o_totalprice end as price from orders)
       group by 1""",
)
def group_rate(spark, sf):
    orders = _orders(spark, sf).withColumns(
        {
            "home": F.when(
                F.col("o_orderpriority") != "5-LOW", (F.col("o_orderstatus") == "F").cast("int")
            ),
            "price": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
        }
    )
    features = {"home_rate": fn.flag_rate("home"), "price_mean": fn.mean_of("price")}
    return rounded(FeatureBlock("o", orders, features).build())


@query(
    "group_mean_trunc",
    f"""select EID, avg(y) as year_mean, cast(trunc(avg(y)) as int) as year_int,
        cast(trunc(avg(m)) as int) as month_int from {DATED_SQL} group by 1""",
)
def group_mean_trunc(spark, sf):
    features = {
        "year_mean": fn.mean_of("y"),
        "year_int": fn.truncated_mean("y"),
        "month_int": fn.truncated_mean("m"),
    }
    return FeatureBlock("o", _dated(spark, sf), features).build()


@query("group_max", "select user_id as EID, max(value) as top from events group by 1")
def group_max(spark, sf):
    return FeatureBlock("e", _events(spark, sf), {"top": fn.biggest("value")}).build()


@query(
    "conditional_share",
    """select o_custkey as EID, (count(*) filter (where o_orderstatus = 'F'))::double / count(*) as share
       from orders group by 1""",
)
def conditional_share(spark, sf):
    share = fn.share_where(F.col("o_orderstatus") == "F")
    return FeatureBlock("o", _orders(spark, sf), {"share": share}).build()


@query(
    "count_scaled",
    """with c as (select o_custkey as EID, count(nullif(o_orderstatus, 'P')) as n from orders group by 1)
       select EID, n, n::double / (select max(n) from c) as n_scaled,
              cast(trunc(ln(1 + n)) as int) as n_bin from c""",
)
def count_scaled(spark, sf):
    code = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return FeatureBlock(
        "o", _orders(spark, sf), {"n": fn.present(code)}, scaled={"n_scaled": "n"},
        derived={"n_bin": fn.log_bin("n")},
    ).build()


@query(
    "cross_table_ratio",
    """with a as (select user_id as EID, sum(value) as amount from events group by 1),
            b as (select c_custkey as EID, max(c_acctbal) as capital from customer group by 1)
       select EID, round(amount / nullif(capital, 0) / 10000, 9) as money_BL,
              round(case when amount > -1 then ln(1 + amount) end / nullif(capital, 0), 9) as money_log
       from a full join b using (EID)""",
)
def cross_ratio(spark, sf):
    claims = FeatureBlock("e", _events(spark, sf), {"amount": fn.total_of("value")}).build()
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "EID")
    capital = FeatureBlock("c", customers, {"capital": fn.biggest("c_acctbal")}).build()
    both = align(claims, capital, "EID")
    return rounded(
        both.select(
            "EID",
            fn.scaled_down(fn.ratio("amount", "capital"), 10000).alias("money_BL"),
            fn.ratio(fn.log1p_or_null("amount"), "capital").alias("money_log"),
        ),
        9,
    )


@query("latest_value", f"select EID, max(y) as last_year from {DATED_SQL} group by 1")
def latest_value(spark, sf):
    return FeatureBlock("o", _dated(spark, sf), {"last_year": fn.latest("y")}).build()


@query(
    "earliest_value",
    f"""select EID, min(y) as first_year, arg_min(m, row(y, m)) as first_month
        from {DATED_SQL} group by 1""",
)
def earliest_value(spark, sf):
    features = {
        "first_year": fn.earliest("y"),
        "first_month": fn.carry_first("m", F.col("y") * 100 + F.col("m")),
    }
    return FeatureBlock("o", _dated(spark, sf), features).build()


@query(
    "latest_row_carry",
    f"""select EID, arg_max(o_totalprice, row(y, m, o_orderkey)) as price,
        arg_max(m, row(y, m, o_orderkey)) as last_month from {DATED_SQL} group by 1""",
)
def latest_row_carry(spark, sf):
    place = fn.order_key("y", "m", "o_orderkey")
    features = {
        "price": fn.carry_latest("o_totalprice", place),
        "last_month": fn.carry_latest("m", place),
    }
    return FeatureBlock("o", _dated(spark, sf), features).build()


@query("max_month", f"select EID, max(m) as top_month from {DATED_SQL} group by 1")
def max_month(spark, sf):
    return FeatureBlock("o", _dated(spark, sf), {"top_month": fn.biggest("m")}).build()


@query(
    "first_row",
    "select o_custkey as EID, arg_min(o_totalprice, o_orderkey) as price from orders group by 1",
)
def first_row(spark, sf):
    first = fn.carry_first("o_totalprice", "o_orderkey")
    return FeatureBlock("o", _orders(spark, sf), {"price": first}).build()


@query("year_span", f"select EID, max(y) - min(y) as year_sub from {DATED_SQL} group by 1")
def year_span(spark, sf):
    return FeatureBlock("o", _dated(spark, sf), {"year_sub": fn.year_span("y")}).build()
