"""What later data needs: mergeable states, rejects, observed counts, sketches, versioned results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.functions import states as st
from starfold.operators import StateBlock, StateStore, distinct_sketches, estimates, merge_sketches, observed
from starfold.queries.learning import SUBMISSION_SQL, fixed_scores
from starfold.queries.registry import query, rounded
from starfold.session import materialize, scratch_path
from starfold.sources import (
    committed_path,
    read_csv,
    read_csv_checked,
    table,
    write_scored,
    write_scored_atomic,
)

SLICES = 4
STATUSES = ("F", "O", "P")


def order_states() -> StateBlock:
    """Every kind of aggregate over the orders of a company."""
    place = fn.order_key("y", "m", "o_orderkey")
    return StateBlock(
        "orders",
        {
            "total": st.total_of("price"),
            "n": st.row_count(),
            "priced": st.present("price"),
            "mean": st.mean_of("price"),
            "whole_mean": st.truncated_mean("price"),
            "done": st.flag_rate(fn.flag(F.col("o_orderstatus") == "F")),
            "urgent": st.share_where(F.col("o_orderpriority") == "1-URGENT"),
            "top": st.biggest("price"),
            "first_year": st.earliest("y"),
            "last_year": st.latest("y"),
            "years": st.year_span("y"),
            "last_price": st.carry_latest("price", place),
            "first_price": st.carry_first("price", "o_orderkey"),
        }
        | st.category_counts("o_orderstatus", STATUSES, "STATUS"),
        scaled={"share": "n"},
        derived={"bin": fn.log_bin("n")},
    )


def order_rows(spark, sf):
    price = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("EID"), "o_orderkey", "o_orderstatus", "o_orderpriority", price.alias("price"),
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"),
    )


MERGE_SQL = """with o as (
      select o_custkey as EID, o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate)::int as y,
             month(o_orderdate)::int as m, case when o_orderpriority <> '5-LOW' then o_totalprice end as price from orders),
    g as (
      select EID, round(coalesce(sum(price), 0), 6) as total, count(*) as n, count(price) as priced, round(avg(price), 6) as mean,
             trunc(avg(price))::int as whole_mean, round(avg((o_orderstatus = 'F')::int), 6) as done,
             round(avg((o_orderpriority = '1-URGENT')::int), 6) as urgent, max(price) as top, min(y) as first_year,
             max(y) as last_year, max(y) - min(y) as years, arg_max_null(price, row(y, m, o_orderkey)) as last_price,
             arg_min_null(price, o_orderkey) as first_price,
             count(*) filter (where o_orderstatus = 'F') as STATUS_F, count(*) filter (where o_orderstatus = 'O') as STATUS_O,
             count(*) filter (where o_orderstatus = 'P') as STATUS_P
      from o group by 1)
    select *, round(n::double / max(n) over (), 6) as share, trunc(ln(1 + n))::int as bin from g"""


@query("block_merge", MERGE_SQL)
def block_merge(spark, sf):
    """Order features from the stored states of four slices, two of them compacted, one replaced."""
    rows = order_rows(spark, sf)
    store = StateStore(spark, scratch_path(spark, "states"), order_states())
    for i in range(SLICES):
        if i == 2:
            store.compact()
        part = rows.where(F.pmod("o_orderkey", F.lit(SLICES)) == i)
        if i == SLICES - 1:
            store.put(f"s{i}", part.limit(100))
        store.put(f"s{i}", part)
    return rounded(store.features())


LINES_SQL = """select c_custkey as EID,
     case when c_custkey % 7 = 0 then 'n/a' when c_custkey % 5 = 0 then null else c_nationkey::varchar end as nation,
     case when c_custkey % 9 = 0 then 'x' || c_custkey::varchar when c_custkey % 4 = 0 then c_custkey::varchar || '万元'
          else c_custkey::varchar end as amount,
     c_mktsegment || case when c_custkey % 11 = 0 then ',more' else '' end as segment from customer"""


@query(
    "csv_rejects",
    f"""with l as ({LINES_SQL}), r as (
          select EID, null as "column", EID::varchar || ',' || coalesce(nation, '') || ',' || amount || ',' || segment as text
          from l where EID % 11 = 0
          union all select EID, 'nation', nation from l where nation = 'n/a' and EID % 11 <> 0
          union all select EID, 'amount', amount from l where amount like 'x%' and EID % 11 <> 0)
        select 'reject' as kind, null as EID, "column", text, null as nation, null as segment from r
        union all select 'accepted', EID, null, amount, nation::int, segment from l where EID not in (select EID from r)""",
)
def csv_rejects(spark, sf):
    """Companies as CSV with planted faults: typed rows on one side, column and text of each fault on the other."""
    key = F.col("c_custkey")
    text = key.cast("string")
    nation = F.when(key % 7 == 0, "n/a").when(key % 5 != 0, F.col("c_nationkey").cast("string"))
    amount = F.when(key % 9 == 0, F.concat(F.lit("x"), text)).when(key % 4 == 0, F.concat(text, F.lit("万元"))).otherwise(text)
    segment = F.concat("c_mktsegment", F.when(key % 11 == 0, F.lit(",more")).otherwise(F.lit("")))
    line = F.concat_ws(",", key, F.coalesce(nation, F.lit("")), amount, segment)
    lines = table(spark, sf, "customer").repartition(3, "c_custkey").select(line.alias("EID,nation,amount,segment"))
    path = scratch_path(spark, "faulty")
    # One column under another separator: the commas of the lines are written as they are.
    lines.write.option("sep", "\u0001").csv(path, header=True)
    kinds = "EID long, nation int, amount string, segment string"
    read = read_csv_checked(spark, path, kinds, {"amount": fn.parse_amount("amount")})
    rejects = read.rejects.select(F.lit("reject").alias("kind"), "column", "text")
    good = read.accepted.select(F.lit("accepted").alias("kind"), "EID", F.col("amount").alias("text"), "nation", "segment")
    return good.unionByName(rejects, allowMissingColumns=True)


@query(
    "observed_profile",
    f"""with s as ({SUBMISSION_SQL})
        select count(*) as rows, count(*) filter (where FORTARGET = 1) as positives,
               (count(*) filter (where FORTARGET = 1))::double / count(*) as positive_rate from s""",
)
def observed_profile(spark, sf):
    """Rows, positives and their share of a submission, counted while it is written."""
    positive = F.col("FORTARGET") == 1
    path = scratch_path(spark, "observed")
    seen = observed(
        fixed_scores(spark, sf),
        lambda df: write_scored(df, path),
        rows=F.count(F.lit(1)),
        positives=F.count_if(positive),
    )
    rate = seen["positives"] / seen["rows"] if seen["rows"] else None
    return spark.createDataFrame([(seen["rows"], seen["positives"], rate)], "rows long, positives long, positive_rate double")


@query(
    "distinct_sketch",
    """select event_type, count(distinct user_id) as users, 1 as close, 1 as merged_alike from events group by 1""",
)
def distinct_sketch(spark, sf):
    """Users by kind of event from sketches of every hour: near the exact number, alike in any order of merging."""
    events = table(spark, sf, "events").select("event_type", "user_id", F.hour("ts").alias("slice"))
    slices = materialize(distinct_sketches(events, ["event_type", "slice"], "user_id"), "sketches")
    at_once = estimates(merge_sketches(slices, ["event_type"]), out="at_once")
    halves = merge_sketches(slices.withColumn("half", F.col("slice") % 2), ["event_type", "half"])
    in_steps = estimates(merge_sketches(halves, ["event_type"]), out="in_steps")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    both = reduce(lambda a, b: a.join(b, "event_type"), [exact, at_once.select("event_type", "at_once"), in_steps.select("event_type", "in_steps")])
    close = F.abs(F.col("at_once") - F.col("users")) <= 0.03 * F.col("users")
    return both.select(
        "event_type", "users", fn.flag(close).alias("close"), fn.flag(F.col("at_once") == F.col("in_steps")).alias("merged_alike")
    )


@query("write_scored_atomic", SUBMISSION_SQL)
def scored_versions(spark, sf):
    """A submission written over an earlier one; the folder shows the last whole version."""
    folder = scratch_path(spark, "versions")
    scores = fixed_scores(spark, sf)
    write_scored_atomic(scores.withColumn("FORTARGET", 1 - F.col("FORTARGET")), folder)
    write_scored_atomic(scores, folder)
    return read_csv(spark, committed_path(spark, folder), "EID long, FORTARGET int, PROB string")
