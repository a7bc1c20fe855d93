"""One-hot, dictionary and per-entity category encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import (
    FeatureBlock,
    append_codes,
    category_counts_long,
    category_vectors,
    codebook,
    dictionary_encode,
    one_hot,
    vocabulary,
    wide_category_counts,
)
from starfold.operators.sparse import as_vectors, sparse_counts, sparse_parts, stored_vector, vector_entries
from starfold.queries.registry import query
from starfold.session import materialize
from starfold.sources import table

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
KINDS = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _dummies_sql(column, prefix, values):
    return ", ".join(
        f"coalesce({column} = '{v}', false)::int as \"{prefix}_{v}\"" for v in values
    )


def _counts_sql(column, prefix, values):
    return ", ".join(
        f"count(*) filter (where {column} = '{v}') as \"{prefix}_{v}\"" for v in values
    )


def _companies(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("EID"),
        F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment")).alias("ETYPE"),
    )


COMPANIES_SQL = """(select c_custkey as EID,
    case when c_nationkey <> 7 then c_mktsegment end as ETYPE from customer)"""


@query("one_hot", f"select EID, {_dummies_sql('ETYPE', 'ETYPE', SEGMENTS)} from {COMPANIES_SQL}")
def one_hot_columns(spark, sf):
    return one_hot(_companies(spark, sf), "ETYPE")


@query(
    "one_hot_drop",
    f"""select EID, {_dummies_sql('ETYPE', 'ETYPE', [s for s in SEGMENTS if s != 'BUILDING'])},
        (ETYPE is null)::int as ETYPE_none from {COMPANIES_SQL}""",
)
def one_hot_drop(spark, sf):
    return one_hot(
        _companies(spark, sf), "ETYPE", without=("BUILDING",), null_category="none"
    )


FIRST_SEEN_SQL = """with e as (select event_id, nullif(event_type, 'error') as ALTERNO from events),
  b as (select ALTERNO, row_number() over (order by min(event_id)) - 1 as code from e group by ALTERNO)
  select e.event_id, b.code from e join b on e.ALTERNO is not distinct from b.ALTERNO"""


def _codes(spark, sf):
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    return table(spark, sf, "events").select("event_id", kind.alias("ALTERNO"))


@query("dictionary_first_seen", FIRST_SEEN_SQL)
def dictionary_first_seen(spark, sf):
    coded = dictionary_encode(_codes(spark, sf), "ALTERNO", order="event_id", out="code")
    return coded.select("event_id", "code")


@query(
    "dictionary_by_value",
    """with b as (select o_custkey, row_number() over (order by o_custkey) - 1 as code
                  from orders group by o_custkey)
       select o.o_orderkey, b.code from orders o join b using (o_custkey)""",
)
def dictionary_by_value(spark, sf):
    """A wide dictionary: one code per customer, numbered without a single-task ranking."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    coded = dictionary_encode(orders, "o_custkey", out="code", small_rows=100)
    return coded.select("o_orderkey", "code")


@query(
    "category_counts",
    f"""select o_custkey as EID, {_counts_sql('o_orderpriority', 'PRIO', PRIORITIES)}
        from orders group by 1""",
)
def category_counts(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "EID")
    values = vocabulary(orders, "o_orderpriority")
    features = fn.category_counts("o_orderpriority", values, "PRIO")
    return FeatureBlock("orders", orders, features).build()


@query(
    "category_counts_wide",
    f"""select o_custkey as EID, {_counts_sql('o_orderpriority', 'PRIO', PRIORITIES)}
        from orders group by 1""",
)
def category_counts_wide(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "EID")
    values = vocabulary(orders, "o_orderpriority")
    return wide_category_counts(orders, "EID", "o_orderpriority", values, "PRIO")


@query(
    "category_share",
    "select user_id as EID, "
    + ", ".join(
        f"(count(*) filter (where event_type = '{k}'))::double / count(*) as \"KIND_{k}\"" for k in KINDS
    )
    + " from events group by 1",
)
def category_share(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "EID")
    features = fn.category_shares("event_type", vocabulary(events, "event_type"), "KIND")
    return FeatureBlock("events", events, features).build()


@query(
    "category_rows",
    "select user_id as EID, count(*) as rows from events group by 1",
)
def category_rows(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "EID")
    return FeatureBlock("events", events, {"rows": fn.row_count()}).build()


PARTS_SQL = """(select o_custkey as EID, l_partkey as part, count(*) as n
  from lineitem join orders on l_orderkey = o_orderkey group by all)"""


def _parts(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"))
    owners = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("EID"))
    return lines.join(owners, "o_orderkey").select("EID", "part")


@query("category_counts_long", f"select EID, part, n from {PARTS_SQL}")
def counts_long(spark, sf):
    """Counts per company and part: as many values as there are parts, none of them a column."""
    return category_counts_long(_parts(spark, sf), "EID", "part")


@query(
    "category_vectors",
    f"""with b as (select part, row_number() over (order by part) - 1 as code
                   from (select distinct part from {PARTS_SQL}))
        select EID, string_agg(code::varchar || ':' || n::varchar, ' ' order by code) as vector
        from {PARTS_SQL} join b using (part) group by 1""",
)
def count_vectors(spark, sf):
    """The same counts as one sparse vector per company, shown as code:count pairs."""
    vectors = category_vectors(_parts(spark, sf), "EID", "part")
    shown = F.transform(F.arrays_zip("codes", "counts"), lambda p: F.concat_ws(":", p["codes"], p["counts"]))
    return vectors.select("EID", F.array_join(shown, " ").alias("vector"))


@query(
    "sparse_matrix",
    f"""with b as (select part, row_number() over (order by part) - 1 as code
                   from (select distinct part from {PARTS_SQL}))
        select EID, code::int as index, n::double as value from {PARTS_SQL} join b using (part)""",
)
def sparse_matrix(spark, sf):
    """One sparse vector per company over all parts, shown by its entries."""
    parts = _parts(spark, sf)
    book = materialize(codebook(parts, "part")[0], "codebook")
    rows = sparse_parts(sparse_counts(parts, "EID", "part", book), "EID")
    vectors = rows.select("EID", stored_vector(book.count(), F.col("indices"), F.col("values")).alias("features"))
    return vector_entries(as_vectors(vectors), "EID", "features")


@query(
    "codebook_append",
    """with h as (select (min(event_id) + max(event_id)) // 2 as half from events),
            f as (select user_id, min(event_id) as first,
                         coalesce(min(event_id) filter (where event_id <= half) is not null, false) as early
                  from events, h group by 1)
       select user_id, row_number() over (order by not early, first) - 1 as code from f""",
)
def codebook_append(spark, sf):
    """Users numbered from the first half of the events; the whole table appends the others."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    early = events.where(F.col("event_id") <= (low + high) // 2)
    book = materialize(codebook(early, "user_id", "event_id")[0], "codebook")
    return append_codes(book, events, "user_id", "event_id", small_rows=10)
