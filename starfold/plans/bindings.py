"""The test tables seen as the company star.

Customers are the companies; orders, order lines and events stand in for the child tables. Some
values are turned into NULL or text so that every cleaning step has something to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.sources import table


SOURCES = {
    "spine": ("customer",),
    "entbase": ("customer",),
    "alter": ("orders",),
    "branch": ("lineitem", "orders"),
    "invest": ("orders",),
    "right": ("events",),
    "project": ("orders",),
    "lawsuit": ("events",),
    "breakfaith": ("events",),
    "recruit": ("orders",),
}


def company_table(spark: SparkSession, folder: str, role: str) -> DataFrame:
    return globals()[role](*[table(spark, folder, name) for name in SOURCES[role]])


def company_star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {role: company_table(spark, folder, role) for role in SOURCES}


def spine(customer: DataFrame) -> DataFrame:
    target = F.when(F.col("c_nationkey") < 18, (F.col("c_acctbal") > 5000).cast("int"))
    return customer.select(F.col("c_custkey").alias("EID"), target.alias("TARGET"))


def entbase(customer: DataFrame) -> DataFrame:
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    kind = (
        F.when(segment == "AUTOMOBILE", 1.0)
        .when(segment == "BUILDING", 2.0)
        .when(segment == "FURNITURE", 3.0)
        .when(segment == "HOUSEHOLD", 4.0)
    )
    return customer.select(
        F.col("c_custkey").alias("EID"),
        F.when(nation != 7, F.col("c_acctbal") * 15).alias("ZCZB"),
        kind.alias("ETYPE"),
        F.when(nation != 3, F.col("c_acctbal") / 2).alias("FINZB"),
        nation.cast("double").alias("TZINUM"),
        F.pmod(nation, F.lit(5)).cast("double").alias("HY"),
    )


def _money_text(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def alter(orders: DataFrame) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.col("o_totalprice")
    before = (
        F.when(status == "F", F.concat(_money_text(price), F.lit("万元")))
        .when(status == "O", _money_text(price))
        .when(priority == "2-HIGH", F.lit("unknown"))
    )
    after = F.when(priority != "1-URGENT", F.concat(_money_text(price * 8), F.lit("万元")))
    return orders.select(
        F.col("o_custkey").alias("EID"),
        F.col("o_orderkey").alias("row_id"),
        F.nullif(priority, F.lit("5-LOW")).alias("ALTERNO"),
        _day("o_orderdate").alias("ALTDATE"),
        before.alias("ALTBE"),
        after.alias("ALTAF"),
    )


def branch(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    # Order lines repeat (order, line number); with part and supplier the number is unique.
    line = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("decimal(15,0)")
    part = line * F.lit("1000000000000").cast("decimal(13,0)") + F.col("l_partkey").cast("decimal(12,0)")
    row_id = part.cast("decimal(27,0)") * F.lit("10000000000").cast("decimal(11,0)") + F.col(
        "l_suppkey"
    ).cast("decimal(10,0)")
    flag = F.col("l_returnflag")
    lines = lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        row_id.alias("row_id"),
        F.nullif(flag, F.lit("N")).alias("TYPECODE"),
        F.when(F.col("l_quantity") > 5, (F.col("l_linestatus") == "F").cast("int")).alias("IFHOME"),
        F.when(flag != "R", F.year("l_shipdate")).alias("B_ENDYEAR"),
    )
    owners = orders.select(
        "o_orderkey", F.col("o_custkey").alias("EID"), F.year("o_orderdate").alias("B_REYEAR")
    )
    return lines.join(owners, "o_orderkey").drop("o_orderkey")


def invest(orders: DataFrame) -> DataFrame:
    status, priority, year = F.col("o_orderstatus"), F.col("o_orderpriority"), F.year("o_orderdate")
    return orders.select(
        F.col("o_custkey").alias("EID"),
        F.when(status != "P", F.col("o_totalprice")).alias("BTBL"),
        F.when(priority != "3-MEDIUM", (status == "F").cast("int")).alias("IFHOME"),
        year.alias("BTYEAR"),
        F.when(priority == "1-URGENT", year + 1).when(priority == "2-HIGH", year).alias("BTENDYEAR"),
    )


def _day(c: str) -> Column:
    return F.col(c).cast("date").cast("string")


def _later() -> Column:
    """A date some years after the event: its value, three days to the unit."""
    days = F.floor(F.col("value") * 3).cast("int")
    return F.date_add(F.col("ts").cast("date"), days).cast("string")


def _slashed(c: Column) -> Column:
    return F.translate(c, "-", "/")


def right(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    code = F.when(kind == "click", 11).when(kind == "view", 12).when(kind == "purchase", 20)
    return events.select(
        F.col("user_id").alias("EID"),
        code.when(kind == "signup", 30).alias("RIGHTTYPE"),
        kind.alias("TYPECODE"),
        _later().alias("ASKDATE"),
        F.when(F.col("value") > 20, _day("ts")).alias("FBDATE"),
    )


def project(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_custkey").alias("EID"),
        _day("o_orderdate").alias("DJDATE"),
        (F.col("o_orderstatus") == "O").cast("int").alias("IFHOME"),
    )


def lawsuit(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("EID"),
        _later().alias("LAWDATE"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("LAWAMOUNT"),
    )


def breakfaith(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("EID"),
        _slashed(_later()).alias("FBDATE"),
        F.when(F.col("event_type") != "click", _slashed(_day("ts"))).alias("SXENDDATE"),
    )


def recruit(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_custkey").alias("EID"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("WZCODE"),
        _day("o_orderdate").alias("RECDATE"),
        F.when(F.col("o_orderstatus") != "F", F.floor(F.col("o_totalprice") / 10000).cast("double"))
        .alias("RECRNUM"),
    )
